"""Composite plans: what a user runs, put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..annotate.base import Annotator, annotated, annotated_again
from ..functions import fixed, names, text
from ..functions.scratch import stored
from ..operators import activity, frequency, phrases, reports, tiers, titles
from ..sinks import tables
from ..sources import files


def tier_lists(counts: DataFrame, english: DataFrame, levels: DataFrame | Column, lists: DataFrame, *keys: str, **options) -> DataFrame:
    """Tiers of every word of every episode (``keys``) from word counts (keys, word, n), which are read three times: dimensions, thresholds, rules."""
    own = frequency.without(counts, lists.where("filter_class = 'basic'").select("word").distinct())
    return tiers.tiered(tiers.with_limits(tiers.with_dimensions(frequency.long_enough(own), english, levels, lists), *keys), **options)


def idioms(docs: DataFrame, k: int = fixed.NGRAM_CANDIDATES) -> DataFrame:
    """Idiom candidates: repeated n-grams, filtered, the top of each document, none part of another."""
    found = phrases.repeated_ngrams(docs)
    return phrases.unsubsumed(stored(phrases.top_phrases(found.where(phrases.is_candidate(F.col("phrase"))), k).drop("place")))


def phrasal(docs: DataFrame) -> DataFrame:
    """Phrasal-verb candidates."""
    return phrases.phrasal_candidates(phrases.phrasal_verbs(docs))


def glossed(words: DataFrame, cache: DataFrame, annotator: Annotator) -> DataFrame:
    """word, gloss: glosses at hand are used again, the others asked for."""
    known = activity.reused(words, cache)
    asked = annotated(known.where("to_translate").select("word"), annotator)
    return known.where("NOT to_translate").select("word", "gloss").unionByName(asked.select("word", F.col("label").alias("gloss")))


def rated_idioms(found: DataFrame, ratings: DataFrame, gate: int = fixed.IDIOM_GATE) -> DataFrame:
    """Candidates whose rating passes the gate; a missing rating does not."""
    return found.join(ratings.select("phrase", text.whole_score(F.col("rating")).alias("rating")), "phrase").where(F.col("rating") >= gate)


def served(rows: DataFrame, glosses: DataFrame, saved: DataFrame, k: int = 25) -> DataFrame:
    """The first ``k`` rows of a list, the most frequent first, with gloss, link token and saved flag: a preview is the feature."""
    marks = saved.select(F.lower("word").alias("w"), F.lower("gloss").alias("g"), F.lit(True).alias("saved")).distinct()
    out = rows.join(glosses, "word").withColumn("token", text.link_token(F.col("word"), F.col("gloss")))
    out = out.join(marks, (F.lower("word") == F.col("w")) & (F.lower("gloss") == F.col("g")), "left").drop("w", "g").fillna(False, ["saved"])
    return out.orderBy(F.desc("n"), "word").limit(k)


def confirmed(found: DataFrame, verifier: Annotator) -> DataFrame:
    """Rows whose phrase the annotator labels ``yes``; each phrase is asked about once, those left out once more."""
    asked = annotated_again(found.select(F.col("phrase").alias("word")).distinct(), verifier)
    return reports.verified(found, asked.where("label = 'yes'").select(F.col("word").alias("phrase")))


def scored(phrases_: DataFrame, rater: Annotator, *fields: str) -> DataFrame:
    """Phrases with the ``fields`` of the annotator's JSON answer."""
    asked = annotated_again(phrases_.select(F.col("phrase").alias("word")).distinct(), rater).withColumnRenamed("word", "phrase")
    return phrases_.join(asked, "phrase", "left").select(*phrases_.columns, *(reports.answer_fields(F.col("label"), f).alias(f) for f in fields))


def phrasal_list(docs: DataFrame, verifier: Annotator, rater: Annotator) -> DataFrame:
    """doc_id, phrase, n, gloss, idiomaticity, literality, example: verified phrasal verbs that pass both gates, the first example."""
    found = scored(confirmed(phrasal(docs), verifier), rater, "gloss", "idiomaticity", "literality")
    whole = found.withColumns({c: text.whole_score(F.col(c)) for c in ("idiomaticity", "literality")}).where(phrases.passes_gates(F.col("idiomaticity"), F.col("literality")))
    return _with_example(docs, stored(whole))


def idiom_list(docs: DataFrame, verifier: Annotator, rater: Annotator, gate: int = fixed.IDIOM_GATE) -> DataFrame:
    """doc_id, phrase, n, gloss, rating, example: verified idioms rated ``gate`` or more, the first example."""
    found = scored(confirmed(idioms(docs), verifier), rater, "gloss", "rating").withColumn("rating", text.whole_score(F.col("rating")))
    return _with_example(docs, stored(found.where(F.col("rating") >= gate)))


def _with_example(docs: DataFrame, found: DataFrame) -> DataFrame:
    first = phrases.phrase_examples(docs, found.select("doc_id", "phrase"), k=1).select("doc_id", "phrase", F.col("sentence").alias("example"))
    return found.join(first, ["doc_id", "phrase"], "left").fillna("N/A", ["gloss", "example"])


def glossed_tiers(rows: DataFrame, lines: DataFrame, cache: DataFrame, annotator: Annotator) -> DataFrame:
    """Tier rows (word, tier, n, …) with gloss and the first example line; glosses at hand are used again."""
    words = stored(rows.select("word").distinct())
    example = phrases.word_examples(lines, words, k=1).select("word", F.col("line").alias("example"))
    return rows.join(glossed(words, cache, annotator), "word", "left").join(example, "word", "left").fillna("N/A", ["gloss"])


#: Kinds of lists that are served, and the tiers or rare cuts whose words they show.
SERVED = {"frequent_c": ("tier", [fixed.TIERS[0]]), "frequent_b": ("tier", fixed.TIERS[5:]), "rare_c": ("rare", ["rare_c"]), "rare_b": ("rare", ["rare_b"])}


def served_list(kind: str, rows: DataFrame, saved: DataFrame, k: int = 80) -> DataFrame:
    """The first ``k`` rows of a word list (rows with gloss) or of a phrase list, with place, total, truncated and saved."""
    if kind in SERVED:
        column, values = SERVED[kind]
        shown = (tiers.rare_split(rows) if column == "rare" else rows).where(F.col(column).isin(*values))
    elif kind in ("phrasal", "idioms"):
        shown = rows.withColumnRenamed("phrase", "word")
    else:
        raise ValueError(f"unknown list kind: {kind}")
    marks = saved.select(F.lower("word").alias("w"), F.lower("gloss").alias("g"), F.lit(True).alias("saved")).distinct()
    shown = shown.join(marks, (F.lower("word") == F.col("w")) & (F.lower("gloss") == F.col("g")), "left").drop("w", "g").fillna(False, ["saved"])
    total = shown.count()
    top = shown.orderBy(F.desc("n"), "word").limit(k)
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "word"))  # ``k`` rows
    return top.withColumn("place", place).withColumn("total", F.lit(total)).withColumn("truncated", F.lit(total > k))


def without_names(rows: DataFrame, annotator: Annotator) -> DataFrame:
    """Saved tier rows without the words that an annotator calls names."""
    asked = annotated_again(rows.select("word").distinct(), annotator).where("lower(label) IN ('name', 'fantasy')")
    return rows.join(asked.select("word"), "word", "left_anti")


def stale_folders(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """Folders with tiers but without the rare cuts that came later: to be run again."""
    return files.existing_artefacts(listing, folders).where("has_tiers AND NOT has_rare").select("folder")


def reorganised(listing: DataFrame, root: str) -> DataFrame:
    """Where each subtitle belongs by its release name: source, target, action; files without an episode stay."""
    info = listing.select("path", names.release_info(F.col("path")).alias("i")).select("path", "i.*")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    wanted = F.when(F.col("season").isNotNull(), F.concat_ws("/", F.lit(root), "series", F.concat(F.lit("Season "), F.col("season").cast("string")), name)).otherwise(F.col("path"))
    return tables.move_plan(info, wanted)


def resolved_titles(messages: DataFrame, movies: DataFrame, shows: DataFrame, k: int = 4) -> DataFrame:
    """id, media, title, catalogue_id, year, season, episode, score, gap, confidence, issue, alternatives: what each message means.

    ``messages``: id, raw, mode (``movie`` or another); ``movies``: title, year, catalogue_id; ``shows``: title, catalogue_id, episodes (a
    map of season to their number). A message's cues or year tell the kind of title; a bare title is looked up in both lists
    and the clear winner's kind is taken, the movie's where neither wins. Of equal titles one of the asked year wins, then the smaller
    catalogue_id. Alternatives are the next candidates that the catalogue knows, for bare titles the best of the other list first.
    """
    intent = F.when(F.col("mode") == "movie", "movie").otherwise(text.media_intent(F.col("raw")))
    movie, series = names.movie_input(F.col("raw")), names.series_input(F.col("raw"))
    asked = messages.where("raw IS NOT NULL AND trim(raw) != ''").select("id", intent.alias("intent"), movie["movie"].alias("movie"), movie["year"].alias("year"), series["series"].alias("series"), series["season"].alias("season"), series["episode"].alias("episode"))
    asked = stored(asked)

    def candidates(query: str, kinds: tuple, listed: DataFrame, own: str):
        mine = asked.where(F.col("intent").isin(*kinds))
        best = titles.ranked(mine.select(F.col(query).alias("query")), listed.select("title").distinct(), k)
        found = best.join(listed, "title")
        met = mine.join(found.withColumnRenamed("query", query).withColumnRenamed("year", "found_year") if own == "movie" else found.withColumnRenamed("query", query).withColumn("found_year", F.lit(0)), query, "left")
        order = W.partitionBy("id").orderBy(F.desc("score"), F.desc(F.col("found_year") == F.col("year")), "title", F.col("catalogue_id").asc_nulls_last())
        met = met.withColumn("rank", F.row_number().over(order)).withColumn("lead", F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))).withColumn("others", F.lead("title").over(order).isNotNull())
        return met.where(F.col("rank") <= k).withColumn("media", F.lit(own))

    films = candidates("movie", ("movie", "ambiguous"), movies, "movie")
    series_ = candidates("series", ("tv", "ambiguous"), shows, "tv")
    score, gap = F.coalesce("score", F.lit(0.0)), F.coalesce("lead", F.lit(0.0))
    confidence, issue = titles.movie_decision(score, gap, F.col("year"), F.coalesce("found_year", F.lit(0)), F.col("others"), F.col("catalogue_id").isNotNull())
    columns = ["id", "intent", "media", "rank", "title", "catalogue_id", "score", "lead"]
    films = films.select(*columns, F.coalesce("found_year", F.lit(0)).alias("year"), F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"), confidence.alias("confidence"), issue.alias("issue"))
    held = F.coalesce(F.element_at("episodes", F.col("season")), F.lit(0))
    confidence, issue = titles.tv_decision(score, gap, F.col("episode"), held, F.col("others"))
    series_ = series_.select(*columns, F.lit(0).alias("year"), "season", "episode", confidence.alias("confidence"), issue.alias("issue"))
    every = stored(films.unionByName(series_))

    first = every.where("rank = 1")
    score_of = lambda media: F.coalesce(F.max(F.when(F.col("media") == media, F.col("score"))), F.lit(0.0))
    won = first.groupBy("id", "intent").agg(titles.bare_title(score_of("movie"), score_of("tv")).alias("bare"), F.bool_or(F.col("media") == "movie").alias("film"))
    won = won.select("id", F.when(F.col("intent") == "ambiguous", F.when(F.col("bare") == "tv", "tv").otherwise("movie")).otherwise(F.col("intent")).alias("media"), ((F.col("intent") == "ambiguous") & (F.col("bare") == "ambiguous")).alias("unclear"))
    top = first.join(won, ["id", "media"])
    others = every.join(won.withColumnRenamed("media", "winner"), "id").where("catalogue_id IS NOT NULL AND NOT (media = winner AND rank = 1)")
    other_list = F.when(F.col("media") != F.col("winner"), 0).otherwise(1)
    by_place = others.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct(other_list.alias("list"), "rank", "media", "title", "catalogue_id"))), 1, 2).alias("found"))  # ``k`` rows of two lists
    out = top.join(by_place, "id", "left")
    alternatives = F.coalesce(F.transform("found", lambda a: F.struct(a["media"].alias("media"), a["title"].alias("title"), a["catalogue_id"].alias("catalogue_id"))), F.array().cast("array<struct<media:string,title:string,catalogue_id:bigint>>"))
    return out.select("id", "media", "title", F.col("catalogue_id").cast("long"), "year", "season", "episode", "score", F.col("lead").alias("gap"), F.when(F.col("unclear"), "low").otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("unclear"), "ambiguous").otherwise(F.col("issue")).alias("issue"), alternatives.alias("alternatives"))
