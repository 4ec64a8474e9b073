"""Roll-ups of activity events, judge scores, queues and toggles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text

KINDS = ["view", "click", "purchase", "signup", "error"]


def with_action(events: DataFrame) -> DataFrame:
    """Events with ``action``, the ``k`` of their properties."""
    return events.withColumn("action", F.get_json_object("props", "$.k"))


def by_user(events: DataFrame) -> DataFrame:
    """Counters of every user, and the last action."""
    kinds = [F.count_if(F.col("event_type") == k).alias(f"{k}_count") for k in KINDS]
    last = F.max_by(F.concat_ws(":", "event_type", "action"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events_total"), *kinds, last.alias("last_action"))


def top(events: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of ``key``, ties by value."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def recent(events: DataFrame, k: int = fixed.RECENT_USER) -> DataFrame:
    """Every user's last ``k`` events; the window's group limit runs before the shuffle."""
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def spans(events: DataFrame) -> DataFrame:
    """First and last time of every user and the time between, in words."""
    out = events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return out.withColumn("lifetime", text.span(F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")))


def active(events: DataFrame) -> DataFrame:
    """Users of the last day and the last week before the latest event."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("seen"))
    now = F.lit(events.agg(F.max("ts")).first()[0])
    within = lambda d: F.count_if(F.col("seen") >= now - F.expr(f"INTERVAL {d} DAYS"))
    return last.agg(within(1).alias("active_day"), within(7).alias("active_week"), F.count(F.lit(1)).alias("users"))


def pairs(events: DataFrame, start: str, finish: str) -> DataFrame:
    """Runs: each ``start`` of a user whose next start or finish is a ``finish``, with its microseconds."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    seen = events.where(F.col("event_type").isin(start, finish))
    seen = seen.withColumn("then", F.lead("event_type").over(order)).withColumn("until", F.lead("ts").over(order))
    return seen.where((F.col("event_type") == start) & (F.col("then") == finish)).withColumn("us", F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))


def toggled(events: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand after an odd number of toggles."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("toggles")).where("toggles % 2 = 1")


def round_robin(shows: DataFrame) -> DataFrame:
    """(show_pos, name, episodes) as jobs: episode 1 of all shows, then episode 2, and so on."""
    return shows.select("show_pos", "name", F.explode(F.sequence(F.lit(1), "episodes")).alias("episode")).withColumn("order_key", F.struct("episode", "show_pos"))


def interleaved(queues: DataFrame) -> DataFrame:
    """(queue, pos, item) with ``turn``: ordered by (turn, queue), the queues are drained in turn."""
    return queues.withColumn("turn", F.row_number().over(W.partitionBy("queue").orderBy("pos")) - 1)


def batched(items: DataFrame, size: int, *order: str) -> DataFrame:
    """Items with the number of their batch within each key ``grp``."""
    return items.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("grp").orderBy(*order)) - 1) / size))


def capped(items: DataFrame, used: int, cap: int, *order: str) -> DataFrame:
    """The first items that the day's budget still allows: a limit is the feature."""
    return items.orderBy(*order).limit(max(0, cap - used))


def until_streak(results: DataFrame, streak: int = fixed.FAILURE_STREAK) -> DataFrame:
    """Of each run (grp, pos, ok) the rows up to and with the ``streak``-th failure in a row."""
    order = W.partitionBy("grp").orderBy("pos")
    block = F.sum(F.col("ok").cast("int")).over(order)
    failed = results.withColumn("block", F.coalesce(block, F.lit(0)))
    failed = failed.withColumn("row", F.sum(F.when(~F.col("ok"), 1).otherwise(0)).over(W.partitionBy("grp", "block").orderBy("pos")))
    stop = F.min(F.when((F.col("row") == streak) & ~F.col("ok"), F.col("pos"))).over(W.partitionBy("grp"))
    return failed.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))).drop("block", "row", "stop")


def judge_rollup(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean score, and counts of scored and skipped rows; a null score is skipped."""
    s = F.col("score")
    return scores.groupBy(*keys).agg((F.sum(s) / F.count(s)).alias("mean_score"), F.count(s).alias("scored"), F.count_if(s.isNull()).alias("skipped"))


def assembled(phrases: DataFrame, *tables: DataFrame) -> DataFrame:
    """Phrases with the columns of each table by phrase; what is missing is ``N/A`` or null."""
    for t in tables:
        phrases = phrases.join(t, "phrase", "left")
    return phrases.fillna("N/A")


def reconciled(words: DataFrame, answers: DataFrame) -> DataFrame:
    """word, gloss: an answer keyed exactly, else one keyed in another case."""
    exact = answers.select("word", F.col("gloss").alias("exact"))
    other = answers.groupBy(F.lower("word").alias("low")).agg(F.min("gloss").alias("other"))
    return words.withColumn("low", F.lower("word")).join(exact, "word", "left").join(other, "low", "left").select("word", F.coalesce("exact", "other").alias("gloss"))


def reused(words: DataFrame, cache: DataFrame) -> DataFrame:
    """word, gloss, to_translate: glosses at hand; bad ones are to be made."""
    out = words.join(cache.select("word", "gloss"), "word", "left")
    bad = text.bad_gloss(F.col("gloss"))
    return out.select("word", F.when(~bad, F.col("gloss")).alias("gloss"), bad.alias("to_translate"))
