"""Writers. Each is one Spark job; files are cut by partition columns, not by loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import tiers


def write_tiers(rows: DataFrame, path: str) -> None:
    """Tier tables, one folder for each tier; ``filter_reason`` is empty outside tier 5."""
    out = rows.select("tier", "word", F.col("n").alias("series_frequency"), "english_frequency", "vocabulary_level", "filter_reason")
    out.sortWithinPartitions("tier", F.desc("series_frequency"), "word").write.mode("overwrite").partitionBy("tier").option("header", True).csv(path)


def write_rare(rows: DataFrame, path: str) -> None:
    """The two cuts of tier 4."""
    out = tiers.rare_split(rows).select("rare", "word", F.col("n").alias("series_frequency"), "english_frequency", "vocabulary_level")
    out.write.mode("overwrite").partitionBy("rare").option("header", True).csv(path)


def write_info(rows: DataFrame, path: str, *keys: str) -> None:
    """One JSON row for each group: its word counts by tier."""
    counts = tiers.tier_counts(rows, *keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "n_words")))).alias("word_counts"))
    counts.write.mode("overwrite").json(path)


def write_phrases(rows: DataFrame, path: str) -> None:
    """Phrase tables, the most frequent first; what is missing is ``N/A``."""
    rows.fillna("N/A").orderBy(F.desc("n"), "phrase").write.mode("overwrite").option("header", True).csv(path)


def write_words(rows: DataFrame, path: str, *order: Column) -> None:
    """A word list as CSV in the given order."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", True).csv(path)


def write_translations(rows: DataFrame, path: str) -> None:
    """word, gloss and example of each list (``band``), the most frequent first, one folder for each; and how many glosses
    each list has and lacks, as JSON in ``path``/info."""
    out = rows.select("band", "word", F.coalesce("gloss", F.lit("")).alias("translation"), F.coalesce("example", F.lit("")).alias("example_en"), "n")
    out.sortWithinPartitions("band", F.desc("n"), "word").drop("n").write.mode("overwrite").partitionBy("band").option("header", True).csv(f"{path}/lists")
    bad = text.bad_gloss(F.col("gloss"))
    rows.groupBy("band").agg(F.count(F.lit(1)).alias("words"), F.count_if(~bad).alias("translated"), F.count_if(bad).alias("missing")).write.mode("overwrite").json(f"{path}/info")


def augmented(rows: DataFrame, glosses: DataFrame, tags: DataFrame) -> DataFrame:
    """A tier table with its words' gloss, example and tag; the caller writes it beside the old one and swaps."""
    out = rows.join(glosses.select("word", "gloss", "example"), "word", "left").join(tags.select("word", "tag"), "word", "left")
    return out.fillna("", ["gloss", "example", "tag"])


def upserted(state: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """A keyed state (user dictionaries, link index, monitoring) with ``changes`` in place of the rows of the same key; a change
    whose ``deleted`` is true takes the row away. The caller writes it beside the old one and swaps."""
    kept = state.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes.where("NOT coalesce(deleted, false)").drop("deleted"))


def write_json(rows: DataFrame, path: str) -> None:
    """State, plan or report rows as JSON lines, in place of what was there."""
    rows.write.mode("overwrite").json(path)


def write_markdown(rows: DataFrame, path: str) -> None:
    """A judge's summary (part, mean_score, scored, skipped, errors) as a Markdown table; a row for each part, a small table."""
    cells = F.concat_ws(" | ", "part", F.coalesce(F.format_number("mean_score", 2), F.lit("-")), "scored", "skipped", "errors")
    lines = rows.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"), F.col("part").alias("key"), F.lit(1).alias("k"))
    head = rows.sparkSession.createDataFrame([("| part | mean | scored | skipped | errors |", "0", 0), ("| --- | --- | --- | --- | --- |", "1", 0)], "value string, key string, k int")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("k", "key").select("value").write.mode("overwrite").text(path)


def write_manifest(files: DataFrame, path: str, version: int = 1) -> None:
    """path, size, mtime and version of analysed files: what ``sources.changed_files`` compares with."""
    files.select("path", "size", "mtime", F.lit(version).alias("version")).write.mode("overwrite").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    """Records added as files of their own."""
    rows.write.mode("append").json(path)


def rewritten(rows: DataFrame, words: DataFrame) -> tuple[DataFrame, int]:
    """A tier table without ``words`` of any case, and how many rows went; the caller writes it beside the old one and swaps."""
    out = rows.join(words.select(F.lower("word").alias("gone")).distinct(), F.lower(rows["word"]) == F.col("gone"), "left_anti")
    return out, rows.count() - out.count()


def episode_path(kind: Column, root: Column, title: Column, season: Column, episode: Column) -> Column:
    """The folder of an artefact: movies by title, series by season and episode."""
    return F.concat_ws("/", root, title, F.when(kind == "series", F.concat(F.lit("Season "), season.cast("string"))), F.when(kind == "series", episode.cast("string")))


def move_plan(files: DataFrame, wanted: Column) -> DataFrame:
    """source, target, action of every file: a plan; nothing is moved or deleted."""
    return files.select(F.col("path").alias("source"), wanted.alias("target"), F.when(F.col("path") == wanted, "keep").otherwise("move").alias("action"))
