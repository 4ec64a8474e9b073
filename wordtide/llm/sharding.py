"""Sharding by jump consistent hashing, in DataFrame functions only.

Lamping and Veach's jump hash needs no ring table: a key jumps forward through growing
shard counts, each jump drawn from a pseudo-random stream seeded by the key, and stops at
its last jump below the shard count.  Appending one shard moves a row only into that shard.
The stream here is ``xxhash64(key, step)``.

Defined results: the key alone (``doc_id``) decides the shard, so rows of equal text may lie
apart and repeated rows lie together; a null key is a key like any other; null text has no
bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that one slot-numbering task is to hold.
ROWS_A_BUCKET = 200_000


def jump_hash(key: Column, shards: int) -> Column:
    """The shard from 0 to ``shards`` - 1 of ``key``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    draw = lambda step: (F.shiftrightunsigned(F.xxhash64(key, step), 33).cast("double") + 1) / F.lit(float(1 << 31))  # noqa: E731  in (0, 1]
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    # the walk has at most `shards` jumps, as each goes forward by one at least
    jump = lambda s, step: F.when(s["next"] < shards, F.struct(s["next"].alias("at"), F.floor((s["next"] + 1) / draw(step)).alias("next"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["at"].cast("int"))


def sharded(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard) and grown_shard (with one shard more).

    Slots: each shard is cut into buckets by a hash of the key; a bucket's rows are numbered
    in a window of its own and follow those of the buckets before it.  So no window holds a
    whole shard, and the one per shard runs over one row for each bucket.
    """
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    n = docs.count()
    buckets = max(16, -(-n // (shards * ROWS_A_BUCKET)))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("bucket"), key, F.crc32(text)), F.lit(buckets)).alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")).cast("long") - 1
    return rows.withColumn("own", own).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("own") + F.col("before")).alias("slot"), "grown_shard")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """``documents`` in 24 shards under the law ``key``."""
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
