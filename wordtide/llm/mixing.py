"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a pseudo-random order of their ids, form blocks of ``block_rows``.
With weight w out of W, block i of a source may go out from slot floor(i * W / w) on and must
be out by slot ceil((i + 1) * W / w).  Earliest deadline first over these windows fills every
slot, and after any number of slots each source is less than one block off its target share.

Weights are scaled to integers in exactly their proportions.  These repeat the schedule every
W slots, so the driver computes one period, or no more than the input's blocks where that is
less, and every row finds its slot by arithmetic from its number within its source.  When a
source has no blocks left, the rest start a new phase with their weights among themselves:
every row goes out exactly once.

Defined results: a null source is a source like any other; a source without a weight gets
``default_weight``; rows of equal id follow each other by a hash of all their columns (in op10
id and source); an empty table gives an empty result; columns of the input pass through, but for those of the reserved prefix
``wordtide_``; a source's last block may be short.
"""

from __future__ import annotations

import array
import bisect
import heapq
import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .shared import shuffle_partitions, stored, unreserved

BLOCK_ROWS = 16
ROWS_A_RANGE = 20_000
#: Target weights of op10 and of the pipeline; other sources have weight 1.
WEIGHTS = {"src0": 6.0, "src1": 3.0, "src2": 3.0, "src3": 2.0, "src4": 2.0}


def whole_weights(weights: dict) -> dict:
    """The smallest integers in the proportions of ``weights``; a float counts as the decimal it is written as."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {k: int(w * scale) for k, w in exact.items()}
    common = math.gcd(*whole.values())
    return {k: w // common for k, w in whole.items()}


def dealt(first, after: list, whole: list, total: int):
    """The source of each slot, without end: earliest deadline first among released blocks.

    Sources are numbers by falling weight, linked from ``first`` on by ``after``; None ends them.
    First blocks are all released at once and due in this order, so none is touched before its turn.
    """
    waiting: list = []
    ready: list = []
    for slot in itertools.count():
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // whole[k]), k, i))
        if first is not None and (not ready or -(-total // whole[first]) <= ready[0][0]):
            deadline, k, i = -(-total // whole[first]), first, 0
            first = after[first]
        else:
            deadline, k, i = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        yield k
        heapq.heappush(waiting, ((i + 1) * total // whole[k], k, i + 1))


def ranked(weights: dict) -> list:
    """Sources by falling weight, then name."""
    return sorted(weights, key=lambda k: (-weights[k], k is not None, str(k)))


def period(weights: dict) -> dict[object, list[int]]:
    """The slots of each source in one period of integer weights."""
    names, total = ranked(weights), sum(weights.values())
    slots: dict = {k: [] for k in names}
    after = [*range(1, len(names)), None]
    for slot, k in enumerate(itertools.islice(dealt(0, after, [weights[k] for k in names], total), total)):
        slots[names[k]].append(slot)
    return slots


def phases(blocks: dict, weights: dict) -> dict[object, list[tuple]]:
    """For each source the phases in which it sends (first block, end block, first slot, slots a period, slots of the source in it).

    A phase is dealt to the end of its first period or to the first source's last block,
    whichever is sooner; all phases together are dealt over no more slots than there are blocks.
    """
    left = {k: n for k, n in blocks.items() if n}
    if not left:
        return {}
    by_name = whole_weights({k: weights[k] for k in left})
    names = ranked(by_name)
    whole, n = [by_name[k] for k in names], [left[k] for k in names]
    after, ahead = [*range(1, len(names)), None], [None, *range(len(names) - 1)]
    first, alive, total, start = 0, len(names), sum(whole), 0
    done = [0] * len(names)
    out: dict = {k: [] for k in names}

    def linked():
        k = first
        while k is not None:
            yield k
            k = after[k]

    while alive:
        slots: dict = {}
        span, length, common = total, None, 1
        for slot, k in enumerate(dealt(first, after, whole, total)):
            if slot == alive:  # paid for by the slots so far
                common = math.gcd(*(whole[x] for x in linked()))
                span = total // common
            if slot == span:
                break
            slots.setdefault(k, array.array("q")).append(slot)
            if len(slots[k]) == n[k]:
                length = slot + 1
                break
        if length is None:
            length = 1 + min((n[k] - 1) // len(at) * span + at[(n[k] - 1) % len(at)] for k, at in slots.items())
        for k, at in slots.items():
            sent = length // span * len(at) + bisect.bisect_left(at, length % span) if length >= span else len(at)
            out[names[k]].append((done[k], done[k] + sent, start, span if length > span else 0, at))
            done[k] += sent
            n[k] -= sent
            if not n[k]:
                alive, total = alive - 1, total - whole[k]
                if ahead[k] is None:
                    first = after[k]
                else:
                    after[ahead[k]] = after[k]
                if after[k] is not None:
                    ahead[after[k]] = ahead[k]
        start += length
    return out


def keyed(docs: DataFrame, id_col: str, source_col: str, ranges: int) -> DataFrame:
    """``docs`` with the place of every row in the order of its source: ``wordtide_range`` of the id's hash,
    ``wordtide_hash`` and, for rows of one id, ``wordtide_tie``, a hash of all columns; rows equal in all are alike."""
    whole = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))))
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col(id_col)), 1)
    rows = docs.withColumn("wordtide_source", F.col(source_col).cast("string")).withColumn("wordtide_hash", hashed).withColumn("wordtide_tie", whole)
    return rows.withColumn("wordtide_range", F.floor(F.col("wordtide_hash").cast("double") / float(1 << 63) * ranges))


def numbered(rows: DataFrame, place) -> DataFrame:
    """``rows`` of ``keyed`` with ``wordtide_number`` from 0 in each source: ``place`` is ``row_number`` or ``rank``.

    Each range of a source is numbered in a window of its own; a source's own window runs over one row for each range.
    """
    counts = rows.groupBy("wordtide_source", "wordtide_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("wordtide_source").orderBy("wordtide_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    before = counts.select(F.col("wordtide_source").alias("wordtide_group"), F.col("wordtide_range").alias("wordtide_at"), before.alias("wordtide_before"))
    own = place().over(W.partitionBy("wordtide_source", "wordtide_range").orderBy("wordtide_hash", "wordtide_tie")).cast("long") - 1
    rows = rows.withColumn("wordtide_own", own)
    out = rows.join(before, rows["wordtide_source"].eqNullSafe(before["wordtide_group"]) & (rows["wordtide_range"] == before["wordtide_at"]))
    return out.withColumn("wordtide_number", F.col("wordtide_own") + F.col("wordtide_before"))


def lookup(blocks: dict, weights: dict) -> tuple:
    """The schedule, flat: the number of each source's first block among all sources' blocks; by that number, for each
    phase of each source, the first block, blocks a period, first slot, slots a period and place in the last array; slots.
    """
    names = list(blocks)
    base = np.cumsum([0, *blocks.values()])[: len(names)]
    at = dict(zip(names, base.tolist(), strict=True))
    parts, slots = array.array("q"), array.array("q")
    dealt_out = phases(blocks, weights)
    for k in names:
        for first, _, start, span, own in dealt_out.pop(k, ()):
            parts.extend((at[k] + first, len(own), start, span, len(slots)))
            slots.extend(own)
    table = np.array(parts, np.int64).reshape(-1, 5).T
    return at, *np.ascontiguousarray(table), np.array(slots, np.int64)


def slots_of(source: pa.Array, block: pa.Array, plan: tuple) -> pa.Array:
    """The slot of each row's block."""
    at, first, each, start, span, place, slots = plan
    coded = source.dictionary_encode()
    base = np.array([*(at[k] for k in coded.dictionary.to_pylist()), at.get(None, 0)], np.int64)
    number = block.to_numpy(zero_copy_only=False) + base[coded.indices.fill_null(len(base) - 1).to_numpy(zero_copy_only=False)]
    part = np.searchsorted(first, number, "right") - 1
    periods, ahead = np.divmod(number - first[part], each[part])
    return pa.array(start[part] + periods * span[part] + slots[place[part] + ahead], pa.int64())


def planned(docs: DataFrame, weights: dict | None, default_weight: float, block_rows: int, source_col: str):
    """The slot of a (source, number), the number of slots in all and the ranges that a source is numbered in."""
    spark = docs.sparkSession
    counted = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["source"]: r["n"] for r in counted}
    blocks = {k: -(-n // block_rows) for k, n in counts.items()}
    sent = spark.sparkContext.broadcast(lookup(blocks, {k: (weights or {}).get(k, default_weight) for k in counts}))

    @F.arrow_udf("long")
    def slot(source: pa.Array, block: pa.Array) -> pa.Array:
        return slots_of(source, block, sent.value)

    return lambda source, number: slot(source, F.floor(number / block_rows)), sum(blocks.values()), max(64, -(-sum(counts.values()) // ROWS_A_RANGE))


def schedule(docs: DataFrame, weights: dict | None = None, default_weight: float = 1.0, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of ``docs``, and ``wordtide_slot`` (of the row's block in the mix) and ``wordtide_place`` (in the block)."""
    docs = unreserved(docs)
    slot, _, ranges = planned(docs, weights, default_weight, block_rows, source_col)
    rows = numbered(keyed(docs, id_col, source_col, ranges), F.row_number)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), slot("wordtide_source", F.col("wordtide_number")).alias("wordtide_slot"), (F.col("wordtide_number") % block_rows).alias("wordtide_place"))


def mixed_order(docs: DataFrame, weights: dict | None = None, default_weight: float = 1.0, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows and columns of ``docs`` in the order of the mix: partitions are ranges of it, sorted.

    Keys alone are numbered. Within a source, slots rise with the keys, so a range of slots is a range of keys: the first
    key and number of each output partition in each source (``cuts``) tell every whole row its partition, and its
    number is counted there. So whole rows are shuffled once.
    """
    spark, docs = docs.sparkSession, unreserved(docs)
    slot, slots, ranges = planned(docs, weights, default_weight, block_rows, source_col)
    parts = shuffle_partitions(spark)
    rows = keyed(docs, id_col, source_col, ranges)
    key = F.struct("wordtide_hash", "wordtide_tie")
    keys = numbered(rows.select("wordtide_source", "wordtide_range", "wordtide_hash", "wordtide_tie"), F.rank)
    part = F.floor(slot("wordtide_source", F.col("wordtide_number")) * parts / max(slots, 1))
    firsts = keys.groupBy("wordtide_source", "wordtide_range", part.alias("part")).agg(F.min(key).alias("key"), F.min("wordtide_number").alias("number"))
    cuts = firsts.groupBy("wordtide_source", "wordtide_range").agg(F.array_sort(F.collect_list(F.struct("key", "part", "number"))).alias("cuts"))  # `parts` at most in each
    cuts = stored(cuts.withColumnsRenamed({"wordtide_source": "wordtide_group", "wordtide_range": "wordtide_at"}))
    whole = rows.join(cuts, rows["wordtide_source"].eqNullSafe(cuts["wordtide_group"]) & (rows["wordtide_range"] == cuts["wordtide_at"]))
    cut = F.element_at(F.filter("cuts", lambda x: x["key"] <= key), -1)
    whole = whole.withColumn("wordtide_cut", cut).withColumn("wordtide_part", F.col("wordtide_cut.part")).withColumn("wordtide_first", F.col("wordtide_cut.number"))
    whole = whole.select(*(F.col(f"`{c}`") for c in docs.columns), "wordtide_source", "wordtide_range", "wordtide_hash", "wordtide_tie", "wordtide_part", "wordtide_first")
    dealt = whole.repartitionByRange(parts, "wordtide_part")
    own = F.row_number().over(W.partitionBy("wordtide_part", "wordtide_source", "wordtide_range").orderBy("wordtide_hash", "wordtide_tie")) - 1
    out = dealt.withColumn("wordtide_number", F.col("wordtide_first") + own)
    at = [slot("wordtide_source", F.col("wordtide_number")).alias("wordtide_slot"), (F.col("wordtide_number") % block_rows).alias("wordtide_place")]
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns), *at).sortWithinPartitions("wordtide_slot", "wordtide_place")
    return out.drop("wordtide_slot", "wordtide_place")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """``documents`` interleaved to the weights ``WEIGHTS``: each row's block slot and place in the block."""
    out = schedule(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), WEIGHTS)
    return out.select("doc_id", "source", F.col("wordtide_slot").alias("slot"), F.col("wordtide_place").alias("place"))
