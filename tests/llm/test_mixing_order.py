"""The mix as a query and as an order of whole rows, against a schedule by plain loops."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wordtide.llm import mixing


def by_hand(counts, weights):
    """The source of every block, earliest deadline first over Pfair windows (of equal ones, a period's first block of a
    source goes first); a source that is out starts a new phase."""
    left, out = dict(counts), []
    while left:
        whole = mixing.whole_weights({k: weights.get(k, 1.0) for k in left})
        total, since, sent = sum(whole.values()), len(out), dict.fromkeys(left, 0)
        while all(left.values()):
            t = len(out) - since
            free = [k for k in left if sent[k] * total // whole[k] <= t]
            k = min(free, key=lambda k: (-(-(sent[k] + 1) * total // whole[k]), sent[k] % whole[k] > 0, mixing.ranked(whole).index(k)))
            out.append(k)
            sent[k] += 1
            left[k] -= 1
        left = {k: n for k, n in left.items() if n}
    return out


@pytest.fixture(scope="module")
def many(spark):
    own = F.when(F.col("id") % 10 < 5, "src0").when(F.col("id") % 10 < 7, "src1").when(F.col("id") % 10 < 8, "src3").when(F.col("id") % 10 < 9, "other")
    return spark.range(0, 3000).select(F.col("id").alias("doc_id"), own.alias("source"), F.concat(F.lit("text "), "id").alias("text"), F.lit("x").alias("slot"), F.map_from_arrays(F.array(F.lit(1)), F.array("id")).alias("m"))


def test_op10_against_plain_loops(spark, many, tmp_path):
    many.drop("m").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op10_mixing(spark, str(tmp_path)).collect()
    ranks = {}
    for r in many.select("source", "doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 1).alias("h")).collect():
        ranks.setdefault(r["source"], []).append((r["h"], r["doc_id"]))
    dealt = by_hand({k: -(-len(v) // mixing.BLOCK_ROWS) for k, v in ranks.items()}, mixing.WEIGHTS)
    next_block, want = dict.fromkeys(ranks, 0), set()
    for slot, k in enumerate(dealt):
        block = sorted(ranks[k])[next_block[k] * mixing.BLOCK_ROWS :][: mixing.BLOCK_ROWS]
        next_block[k] += 1
        want |= {(i, k, slot, place) for place, (_, i) in enumerate(block)}
    assert {tuple(r) for r in got} == want and len(got) == 3000


def test_stated_weights_hold_over_many_blocks():
    weights = {f"src{i}": mixing.WEIGHTS.get(f"src{i}", 1.0) for i in range(5)}
    slots = mixing.period(mixing.whole_weights(weights))
    total, assigned = sum(len(x) for x in slots.values()), {s: k for k, x in slots.items() for s in x}
    assert total == 16
    sent = dict.fromkeys(weights, 0)
    for t in range(100_000):
        sent[assigned[t % total]] += 1
        if t % 977 == 0:
            assert all(abs(n - Fraction(t + 1) * Fraction(weights[k]) / 16) < 1 for k, n in sent.items())


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_order_of_whole_rows(spark, many, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = many.union(many.where("doc_id < 40")).union(many.where("doc_id = 7"))  # repeated rows
        got = mixing.mixed_order(rows, mixing.WEIGHTS)
        assert got.columns == rows.columns
        want = sorted((r["wordtide_slot"], r["wordtide_place"], r["doc_id"], r["text"], r["slot"]) for r in mixing.schedule(rows, mixing.WEIGHTS).collect())
        assert [(r["doc_id"], r["text"], r["slot"]) for r in got.collect()] == [x[2:] for x in want]
        assert mixing.mixed_order(rows.where("false"), mixing.WEIGHTS).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_whole_rows_are_shuffled_once(many):
    plan = mixing.mixed_order(many, mixing.WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 0 and "BroadcastHashJoin" in plan
