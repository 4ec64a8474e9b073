"""Exact dedup by heavy-hitter split, in DataFrame functions only.

Misra-Gries (``freqItems``, Karp, Shenker and Papadimitriou) names at most ``1 / support``
candidate digests in one pass.  Their true counts are then taken, and the verified winners,
whose number is bounded by ``1 / support``, are broadcast: rows of the largest groups meet
their answer map-side and are never shuffled.  All other digests use an ordinary shuffle,
so no group in it holds more than ``support`` of the rows.

Defined results: null text counts as empty; one row of each group stays, of repeated rows
(same doc_id) too; a null doc_id never stays unless its whole group has none; an empty table
gives an empty result; columns of the input beside the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions, stored

#: Most digests that are broadcast, whatever the number of partitions.
MOST_HEAVY = 100_000


def support_of(spark) -> float:
    """Share of the rows from which a digest counts as a heavy hitter: a quarter of a shuffle partition's, so that no group
    left to the shuffle makes a partition much larger than its neighbours. Its inverse bounds the broadcast."""
    return 1 / min(MOST_HEAVY, max(500, 4 * shuffle_partitions(spark)))


def normalised(text):
    """Runs of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def heavy_hitters(digests: DataFrame, support: float) -> DataFrame:
    """Digests that hold at least ``support`` of the rows, with their exact size and smallest doc_id."""
    spark = digests.sparkSession
    if "row" not in digests.columns:
        digests = digests.withColumn("row", F.lit(0).cast("long"))
    found = digests.stat.freqItems(["digest"], support).first()[0] or []
    candidates = spark.createDataFrame([(x,) for x in set(found)], "digest string")
    least = F.lit(support * digests.count())
    return digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*size_and_first()).where(F.col("group_size") >= least).withColumn("keep_id", F.col("first.doc_id"))


def size_and_first():
    """Size of a group and its first row: the smallest doc_id, null ones last, and of equal ones the first in the stored digests."""
    return F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float | None = None) -> DataFrame:
    """One row per input row: doc_id, digest (SHA-256 in hex of the normalised text), keep_id, group_size, kept."""
    digests = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"))
    digests = stored(digests.withColumn("row", F.monotonically_increasing_id()))
    winners = stored(heavy_hitters(digests, support or support_of(docs.sparkSession)))
    heavy = digests.join(F.broadcast(winners.drop("keep_id")), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(*size_and_first())
    return heavy.unionByName(rest.join(groups, "digest")).select("doc_id", "digest", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts of ``documents``; see the module for the method."""
    out = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
