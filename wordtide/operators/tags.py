"""Tags of words (name, simple, normal), and the rows that a user is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

NAME, NORMAL = "name/fantasy entity", "normal word"
FAILED = "[Translation failed]"


def name_tag(word: Column, listed: Column, tag: Column, excluded: Column, english: Column) -> Column:
    """Name lists win, then the model's tag (``normal word`` loses to a frequency of 0), then its excluded set, then a frequency of 0."""
    said, rare = F.lower(F.coalesce(tag, F.lit(""))), F.coalesce(english, F.lit(0)) == 0
    proper = F.lit(f"{NAME} (zero frequency - likely proper noun)")
    from_model = F.concat(F.lit(f"{NAME} (ChatGPT: "), tag, F.lit(")"))
    return (
        F.when(listed, F.concat(F.lit(f"{NAME} (name filter: "), word, F.lit(")")))
        .when(said.contains(NAME), from_model)
        .when(said.contains(NORMAL) & rare, proper)
        .when(said.contains(NORMAL), NORMAL)
        .when((said != "") & excluded, from_model)
        .when(said != "", NORMAL)
        .when(excluded, f"{NAME} (ChatGPT: no tag provided)")
        .when(rare, proper)
        .otherwise("")
    )


def simple_tag(word: Column, tag: Column, level: Column, easy: Column, english: Column, limit: int = fixed.SIMPLE_WORD_FREQ) -> Column:
    """``tag``, or why a word that is no name is too simple to gloss; the first reason that holds."""
    low, lv, freq = F.lower(word), F.upper(level), F.format_number(english, 0)
    reason = (
        F.when(lv.isin("A1", "A2"), F.concat(F.lit("vocabulary level: "), lv))
        .when(easy, "easy_words filter")
        .when((lv == "N/A") & (english > limit), F.concat(F.lit("high frequency: "), freq, F.lit(", not in vocabulary list")))
        .when(low.rlike(r"(.)\1{2,}"), "informal/non-standard spelling")
        .when((F.length(low) <= 4) & (english > limit), F.concat(F.lit("short word with high frequency: "), freq))
    )
    free = (F.trim(tag) == "") | F.lower(tag).contains(NORMAL)
    return F.when(free & reason.isNotNull(), F.concat(F.lit("simple word ("), reason, F.lit(")"))).otherwise(tag)


def failed_tag(tag: Column, gloss: Column, english: Column) -> Column:
    """``tag``, or a name's where a normal word of no frequency could not be translated."""
    name = (F.trim(gloss) == FAILED) & F.lower(tag).contains(NORMAL) & (F.coalesce(english, F.lit(0)) == 0)
    return F.when(name, f"{NAME} (translation failed - zero frequency, likely proper noun)").otherwise(tag)


def shown(rows: DataFrame, user_level: str) -> DataFrame:
    """Untagged rows of the levels that a user of level A, B or C sees."""
    levels = fixed.SHOWN_LEVELS.get(user_level.upper())
    out = rows.where(F.trim(F.coalesce("tag", F.lit(""))) == "")
    return out.where(F.upper(F.coalesce("vocabulary_level", F.lit("N/A"))).isin(*levels)) if levels else out


def bypass(rows: DataFrame) -> DataFrame:
    """``rows`` with ``passes_names`` (no name, or of a level that names pass with) and ``passes`` (of an allowed level too)."""
    tag, level = F.trim(F.coalesce("tag", F.lit(""))), F.upper(F.coalesce("vocabulary_level", F.lit("N/A")))
    names = (tag == "") | F.lower(tag).contains(NORMAL) | level.isin(*fixed.BYPASS_LEVELS)
    return rows.withColumn("passes_names", names).withColumn("passes", names & level.isin(*fixed.ALLOWED_LEVELS))


def bypass_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each group: rows, those that the name filter and the level filter take, and what is left."""
    left, names = F.count_if("passes"), F.count_if("passes_names")
    return bypass(rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("original_count"), (F.count(F.lit(1)) - names).alias("name_filtered"), (names - left).alias("vocab_filtered"), left.alias("final_count"))


def tag_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each group: words, words of no frequency (tagged as names, or normal), failed glosses and those tagged as normal."""
    rare, failed, tag = F.col("english_frequency") == 0, F.trim("gloss") == FAILED, F.lower("tag")
    n = {"total_words": F.lit(True), "zero_frequency": rare, "names_tagged": rare & tag.contains(NAME), "normal_zero": rare & tag.contains(NORMAL), "failed": failed, "names_missed": failed & tag.contains(NORMAL)}
    return rows.groupBy(*keys).agg(*(F.count_if(v).alias(k) for k, v in n.items()))


def needs_english(rows: DataFrame, *keys: str, first: int = 12) -> DataFrame:
    """Groups whose first ``first`` glosses (by ``place``) are Cyrillic in a third or more: they are to be made again."""
    few = rows.where(F.col("place") <= first).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gloss").rlike(r"[Ѐ-ӿ]")).alias("cyrillic"))
    return few.withColumn("refresh", F.col("cyrillic") >= F.greatest(F.lit(1), F.floor(F.col("n") / 3)))


def entry_line(place: Column, word: Column, gloss: Column, saved: Column) -> Column:
    """A line of a shown list."""
    name = F.when(saved, F.concat(word, F.lit(" 📚"))).otherwise(word)
    marked = lambda c: F.regexp_replace(c, r"([_*`\[])", r"\\$1")
    return F.concat(place.cast("string"), F.lit(". *"), marked(name), F.lit("* → "), marked(gloss))


def preview(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` rows of each group (by ``place``) with the group's ``total`` and whether it is ``truncated``: the cut is the feature."""
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return rows.where(F.col("place") <= k).join(total, list(keys)).withColumn("truncated", F.col("total") > k)


def merged_lists(one: DataFrame, two: DataFrame) -> DataFrame:
    """Both lists (word, gloss, place), the first one's rows first; an entry of any case only once."""
    rows = one.withColumn("at", F.struct(F.lit(0), F.col("place"))).unionByName(two.withColumn("at", F.struct(F.lit(1), F.col("place"))))
    key = [F.lower(F.trim("word")).alias("w"), F.lower(F.trim("gloss")).alias("g")]
    return rows.groupBy(*key).agg(F.min_by(F.struct("word", "gloss"), "at").alias("first"), F.min("at").alias("at")).select("first.*", "at")
