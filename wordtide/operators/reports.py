"""Judge summaries, artefact checks, daily plans and monitoring reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import activity


def judge_summary(parts: DataFrame, *keys: str) -> DataFrame:
    """Of each part of episodes that are ``ok``: mean score (unrounded), counts of skipped rows and of errors."""
    ok = parts.where("status = 'ok'")
    skipped, error = F.coalesce("skipped", F.lit(False)), F.col("error").isNotNull()
    counted = F.when(~skipped & ~error, F.col("overall_score"))
    return ok.groupBy(*keys).agg((F.sum(counted) / F.count(counted)).alias("mean_score"), F.count(counted).alias("scored"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped & error).alias("errors"))


def overall_score(overall: Column, *criteria: Column) -> Column:
    """The overall score, else the mean of the criteria that are there, else 0."""
    given = F.filter(F.array(*criteria), lambda x: x.isNotNull())
    mean = F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.size(given)
    return F.coalesce(overall, F.when(F.size(given) > 0, mean), F.lit(0.0))


def compared_runs(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Scores of two runs side by side by ``key``, and what the second gained; a row of one run alone has no gain."""
    a, b = one.select(key, F.col("score").alias("before")), two.select(key, F.col("score").alias("after"))
    return a.join(b, key, "full").withColumn("gain", F.col("after") - F.col("before"))


def missing_parts(present: DataFrame) -> DataFrame:
    """folder, part, missing of every folder of ``present`` (folder, file): the files that each part lacks; none: complete."""
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(names).alias("names")) for p, names in fixed.PART_FILES.items()))).alias("w")
    held = present.groupBy("folder").agg(F.collect_set(F.when(F.col("file").isin(*(x for v in fixed.PART_FILES.values() for x in v)), F.col("file"))).alias("held"))  # a fixed list of names
    return held.select("folder", "held", wanted).select("folder", "w.part", F.array_join(F.array_except("w.names", "held"), ", ").alias("missing"))


def verified(phrases: DataFrame, answers: DataFrame) -> DataFrame:
    """Phrases that an annotator's answer repeats exactly."""
    return phrases.join(answers.select("phrase").distinct(), "phrase", "left_semi")


def reuse_counts(words: DataFrame, *keys: str) -> DataFrame:
    """Of each group of (keys, gloss) rows: words, glosses at hand and those to make."""
    bad = text.bad_gloss(F.col("gloss"))
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"), F.count_if(~bad).alias("reused"), F.count_if(bad).alias("to_translate"))


def alternatives(found: DataFrame, k: int = 2) -> DataFrame:
    """Of each query's candidates (query, id, score, place) those after the winner that have an id: the first ``k``."""
    rest = found.where("id IS NOT NULL")
    order = W.partitionBy("query").orderBy("place", "id")
    won = F.row_number().over(order)
    return rest.withColumn("rank", won - 1).where((F.col("rank") >= 1) & (F.col("rank") <= k))


def relevance(match: Column, downloads: Column) -> Column:
    """Seven parts match, three parts popularity."""
    return match * 0.7 + text.popularity(downloads) * 0.3


def daily_state(state: DataFrame, today: Column) -> DataFrame:
    """day, used: the stored count if it is of ``today``, else 0."""
    used = F.when(F.col("date") == today, F.coalesce("new_downloads_today", F.lit(0))).otherwise(0)
    return state.select(today.alias("day"), used.alias("used"))


def daily_plan(shows: DataFrame, films: DataFrame, used: int, cap: int = fixed.DAILY_DOWNLOADS) -> DataFrame:
    """The day's jobs: episodes of all ``shows`` (show_pos, name, episodes) in turn, interleaved with ``films`` (pos, name);
    as many as the budget allows. ``place`` counts from 1. A day's titles are a short list, ordered as a whole."""
    series = activity.round_robin(shows).select(F.lit(0).alias("queue"), F.col("order_key").alias("key"), "name", "episode")
    movies = films.select(F.lit(1).alias("queue"), F.struct(F.lit(0).alias("episode"), F.col("pos").cast("int").alias("show_pos")).alias("key"), "name", F.lit(None).cast("int").alias("episode"))
    series = series.withColumn("key", F.struct(F.col("key.episode").alias("episode"), F.col("key.show_pos").cast("int").alias("show_pos")))
    turns = series.unionByName(movies).withColumn("turn", F.row_number().over(W.partitionBy("queue").orderBy("key")))
    jobs = activity.capped(turns, used, cap, "turn", "queue")
    return jobs.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("turn", "queue"))).select("place", "name", "episode")


def monitoring(events: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` users last seen, the latest first, with their counters and span; a top list is the feature."""
    seen = activity.by_user(events).join(activity.spans(events), "user_id")
    return seen.orderBy(F.desc("last_seen"), "user_id").limit(k)


def pipeline_totals(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs, their whole time and its mean in seconds, of each group and, with null keys, of all."""
    return runs.rollup(*keys).agg(F.count(F.lit(1)).alias("runs"), F.floor(F.sum("us") / 1000).alias("total_ms"), (F.sum("us") / F.count(F.lit(1)) / 1e6).alias("avg_seconds"))


def latest_of_all(events: DataFrame, k: int = fixed.RECENT_ALL) -> DataFrame:
    """The last ``k`` events of all users."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def sorted_payload(names: Column, values: Column) -> Column:
    """JSON of names and values, the names in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.arrays_zip(names.alias("k"), values.alias("v")))))


def answer_fields(answer: Column, *keys: str) -> Column:
    """The first of ``keys`` that a model's JSON answer (in a Markdown fence or not) has, as text."""
    plain = text.unfenced(answer)
    return F.coalesce(*(F.get_json_object(plain, f"$.{k}") for k in keys))
