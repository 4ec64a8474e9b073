"""Tier assignment, tier filters and level operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.scratch import stored

#: Words whose dimensions are broadcast.
MOST_HOT = 1 << 17


def with_dimensions(counts: DataFrame, english: DataFrame, levels: DataFrame | Column, lists: DataFrame) -> DataFrame:
    """(…, word, n) with english_frequency (0), vocabulary_level (N/A), easy and oxford flags; ``levels`` is a table or follows from the word.

    The dimensions are joined with each other first. Those of the ``MOST_HOT`` most frequent words at most are broadcast; the rows of
    the other words alone are shuffled to theirs. ``counts`` is read three times.
    """
    flags = lists.groupBy("word").agg(F.bool_or(F.col("filter_class") == "easy").alias("easy"), F.bool_or(F.col("filter_class") == "oxford").alias("oxford"))
    sizes = counts.groupBy("word").agg(F.count(F.lit(1)).alias("size"))
    words = sizes.join(english, "word", "left").join(flags, "word", "left")
    words = words.withColumn("vocabulary_level", levels) if isinstance(levels, Column) else words.join(levels.select("word", F.col("level").alias("vocabulary_level")), "word", "left")
    words = stored(words.withColumn("step", F.floor(F.log2("size") * 4)))
    held, bound = 0, None
    for r in sorted(words.groupBy("step").count().collect(), reverse=True):  # some hundred at most
        held += r["count"]
        if held > MOST_HOT:
            break
        bound = r["step"]
    hot = F.col("step") >= bound if bound is not None else F.lit(False)
    often, rest = F.broadcast(words.where(hot).drop("size", "step")), words.where(~hot).drop("size", "step")
    out = counts.join(often, "word").unionByName(counts.join(F.broadcast(words.where(hot).select("word")), "word", "left_anti").join(rest, "word", "left"))
    return out.fillna({"english_frequency": 0, "vocabulary_level": "N/A", "easy": False, "oxford": False})


def with_limits(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of ``with_dimensions`` with their group's series_threshold and english_threshold, as ``frequency.thresholds`` has them.

    A group's rows meet once and are counted by value, so nothing is written or joined again. The place min(2n div 3, n - 1) from 0 is the
    last that a share just above two thirds reaches, for up to 10**8 rows of a group.
    """
    own = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)})"
    at = lambda value: F.coalesce(F.expr(f"percentile_disc({2 / 3 + 1e-9!r}D) WITHIN GROUP (ORDER BY {value}) {own}").cast("long"), F.lit(1).cast("long"))
    return rows.dropna(subset=list(keys)).withColumns({"series_threshold": at("n"), "english_threshold": at("CASE WHEN english_frequency > 0 THEN english_frequency END")})


def tier_and_reason(min_count: int | None = fixed.MIN_EPISODE_COUNT, max_english: int = fixed.MAX_ENGLISH_FREQ) -> tuple[Column, Column]:
    """The tier of a row, and why tier 5 took it; the first rule that holds decides."""
    level, english = F.upper(F.trim("vocabulary_level")), F.col("english_frequency")
    high_series, high_english = F.col("n") >= F.col("series_threshold"), english >= F.col("english_threshold")
    few = (F.col("n") < min_count) if min_count else F.lit(False)
    reason = (
        F.when(high_english | few, F.lit(None))
        .when(F.col("easy"), "Easy word (easy_words.csv)")
        .when(F.col("oxford"), "Oxford 3000")
        .when(english > max_english, F.concat(F.lit("High English frequency ("), F.format_number(english, 0), F.lit(f" > {max_english:,})")))
        .when(level.isin("A1", "A2"), F.concat(F.lit("Vocabulary level below C ("), level, F.lit(")")))
    )
    tier = (
        F.when(~high_english & few, "tier_2_random")
        .when(reason.isNotNull(), "tier_5_filtered")
        .when(~high_english & (level == "B1"), "tier_b1_words")
        .when(~high_english & (level == "B2"), "tier_b2_words")
        .when(~high_english & high_series, "tier_1_hard_usable")
        .when(~high_english, "tier_2_random")
        .when(high_series, "tier_3_common")
        .otherwise("tier_4_rare_in_series")
    )
    return tier, reason


def tiered(rows: DataFrame, **options) -> DataFrame:
    """``rows`` of ``with_limits`` with tier and filter_reason."""
    tier, reason = tier_and_reason(**options)
    return rows.withColumn("tier", tier).withColumn("filter_reason", reason)


def kept(rows: DataFrame, excluded: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rows that are written out: no excluded name; in tier 1 none rated ``low``; in tiers 1 to 4 no level below C."""
    low = ratings.where(F.lower("rating") == "low").select(F.lower("word").alias("word"), F.lit(True).alias("low"))
    names = stored(excluded.select(F.lower("word").alias("word")).distinct())  # written, so that small ones are known to be small
    level = F.upper(F.trim("vocabulary_level"))
    out = rows.join(names, "word", "left_anti").join(stored(low.distinct()), "word", "left")
    below = F.col("tier").isin(*fixed.TIERS[:4]) & level.isin("A1", "A2", "B1", "B2")
    return out.where(~((F.col("tier") == fixed.TIERS[0]) & F.coalesce("low", F.lit(False))) & ~below).drop("low")


def rare_split(rows: DataFrame) -> DataFrame:
    """Tier-4 rows as ``rare_c`` (C levels) and ``rare_b`` (B levels); other levels go."""
    level = F.upper(F.trim("vocabulary_level"))
    part = F.when(level.isin("C1", "C2"), "rare_c").when(level.isin("B1", "B2"), "rare_b")
    return rows.where(F.col("tier") == fixed.TIERS[3]).withColumn("rare", part).where("rare IS NOT NULL")


def tier_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """n_words of every tier of each group, zeros too."""
    n = rows.groupBy(*keys).agg(*(F.count_if(F.col("tier") == t).alias(t) for t in fixed.TIERS))
    one = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.col(t).alias("n_words")) for t in fixed.TIERS))).alias("one")
    return n.select(*keys, one).select(*keys, "one.*")


def level_rank(level: Column) -> Column:
    """0 for A1 to 5 for C2, null for anything else."""
    found = F.array_position(F.lit(fixed.LEVELS), F.upper(F.trim(level)))
    return F.when(found > 0, (found - 1).cast("int"))


def one_level(listed: DataFrame, highest: bool = False) -> DataFrame:
    """word, level: of a word's several levels the lowest or the highest."""
    rank = level_rank(F.col("level"))
    pick = F.max_by if highest else F.min_by
    return listed.where(rank.isNotNull()).groupBy("word").agg(pick(F.upper(F.trim("level")), rank).alias("level"))


def coarse_level(label: Column) -> Column:
    label = F.lower(F.trim(label))
    return F.when(label == "c", "C1").when(label == "b", "B2").when(label == "a", "A2").otherwise("N/A")


def overlaid(listed: DataFrame, labels: DataFrame) -> DataFrame:
    """word, level: labels win over listed levels."""
    return listed.select("word", F.col("level").alias("listed")).join(labels.select("word", F.col("level").alias("label")), "word", "full").select("word", F.coalesce("label", "listed").alias("level"))


def labelled(words: DataFrame, levels: DataFrame) -> DataFrame:
    """words with the level of the word, else of its singular, else UNKNOWN."""
    one, two = levels.select("word", F.col("level").alias("own")), levels.select(F.col("word").alias("base"), F.col("level").alias("based"))
    out = words.withColumn("base", text.singular_for_levels(F.col("word"))).join(one, "word", "left").join(two, "base", "left")
    return out.withColumn("level", F.coalesce("own", "based", F.lit("UNKNOWN"))).drop("base", "own", "based")


def above_level(rows: DataFrame, levels: DataFrame, english: DataFrame, user_level: str, gap: int = 1, max_english: int | None = None) -> DataFrame:
    """Words at least ``gap`` levels above the user's and not too frequent; a word without a frequency has its singular's."""
    if user_level not in fixed.LEVELS:
        raise ValueError(f"not a level: {user_level}")
    out = labelled(rows, levels).where(level_rank(F.col("level")) - fixed.LEVELS.index(user_level) >= gap)
    out = out.join(english, "word", "left").withColumn("base", text.singular_for_levels(F.col("word")))
    out = out.join(english.select(F.col("word").alias("base"), F.col("english_frequency").alias("based")), "base", "left")
    own = F.coalesce("english_frequency", F.lit(0))
    out = out.withColumn("english_frequency", F.when(own > 0, own).otherwise(F.coalesce("based", F.lit(0))))
    return (out.where(F.col("english_frequency") <= max_english) if max_english else out).drop("base", "based")


def needs_level(rows: DataFrame, min_count: int = fixed.MIN_EPISODE_COUNT) -> DataFrame:
    """Low-English words without a level, often enough and on no list: those to ask an annotator about."""
    low = F.col("english_frequency") < F.col("english_threshold")
    return rows.where(low & (F.col("n") >= min_count) & ~F.col("easy") & ~F.col("oxford") & (level_rank(F.col("vocabulary_level")).isNull()))
