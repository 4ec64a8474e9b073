"""Repeated n-grams, phrasal verbs and example lines. Phrases meet texts by equality of tokens or in one pass of an automaton, never by scans of all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.matching import Phrases
from ..functions.python import Tokens, token_slices
from ..functions.scratch import stored

#: Phrases of a list that one automaton holds.
MOST_LISTED = 200_000
#: Example lines that a task holds.
MOST_HELD = 100_000


def grams(tokens: Column, least: int, most: int) -> Column:
    """All n-grams of an array of tokens, joined by spaces, in order of n, then position."""
    of = lambda n: F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(of(n) for n in range(least, most + 1)))


def repeated_ngrams(docs: DataFrame, least: int = fixed.NGRAM_LEAST, most: int = fixed.NGRAM_MOST, occurrences: int = fixed.NGRAM_OCCURRENCES) -> DataFrame:
    """doc_id, phrase, n, n_tokens of n-grams that a document (one row) repeats: counted within the row, without a shuffle."""

    def count(batches):
        for batch in token_slices(batches, 1):
            tokens = Tokens(batch.column(1))
            for at, size, n in tokens.repeated(least, most, occurrences):
                if len(at):
                    ids = batch.column(0).take(pa.array(tokens.row[at]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(tokens.joined(at, size), pa.string()), pa.array(n), pa.array(np.full(len(at), size, np.int32))], ["doc_id", "phrase", "n", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), text.tokens(F.col("text")).alias("t")).mapInArrow(count, "doc_id long, phrase string, n long, n_tokens int")


def stop_words_in(phrase: Column) -> Column:
    return F.size(F.filter(F.split(phrase, " "), lambda x: x.isin(fixed.STOP_WORDS)))


def is_candidate(phrase: Column, ratio: float = fixed.STOP_RATIO) -> Column:
    """N-grams worth a look: no boilerplate, no contraction or cut-off ends, not mostly stop words."""
    parts, n = F.split(phrase, " "), F.size(F.split(phrase, " "))
    cut_off = (n >= 4) & F.element_at(parts, -1).isin(fixed.TRAILING_JUNK)
    return (n >= 2) & ~phrase.isin(fixed.BORING_NGRAMS) & ~parts[0].isin(fixed.FRAGMENTS) & ~cut_off & (stop_words_in(phrase) / n <= ratio)


def top_phrases(phrases: DataFrame, k: int = fixed.NGRAM_CANDIDATES) -> DataFrame:
    """The ``k`` most frequent phrases of each document, longer ones first among equals."""
    order = W.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("n_tokens"), "phrase")
    return phrases.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def unsubsumed(phrases: DataFrame) -> DataFrame:
    """Phrases that are no consecutive part of a longer phrase of the same document."""
    tokens = F.split("phrase", " ")
    inner = F.filter(grams(tokens, 1, fixed.NGRAM_MOST), lambda x: x != F.col("phrase"))
    parts = phrases.select("doc_id", F.explode(inner).alias("phrase")).distinct()
    return phrases.join(parts, ["doc_id", "phrase"], "left_anti")


def to_phrase(phrase: Column) -> Column:
    """Phrases with ``to`` as a word, which the heuristics drop."""
    return phrase.contains(" to ") | phrase.endswith(" to") | phrase.startswith("to ")


def phrasal_counts(docs: DataFrame) -> DataFrame:
    """doc_id, phrase, n, size: occurrences in each document (one row), from one pass over its tokens.

    size 0: listed phrases, tokens parted by one space; 2: unlisted pairs of a word and a particle; 3: such pairs with a
    third word. Particles and lists choose the positions before any phrase is put together.
    """
    times = Counter(fixed.PHRASAL_VERBS)
    particles, thirds = fixed.PARTICLES, fixed.THIRD_WORDS

    def count(batches):
        for batch in token_slices(batches, 1):
            found = []
            spaced, plain = Tokens(batch.column(2)), Tokens(batch.column(1))
            for size in (2, 3):
                asked = [x.split(" ") for x in times if x.count(" ") == size - 1]
                at = spaced.starts(size)
                for k in range(size):
                    at = at[spaced.among(x[k] for x in asked)[at + k]]
                found.append((spaced, at, size, 0))
                at = plain.starts(size)
                at = at[plain.among(particles)[at + 1]]
                found.append((plain, at if size == 2 else at[plain.among(thirds)[at + 2]], size, size))
            for tokens, at, size, kind in found:
                if not len(at):
                    continue
                first, _, n = tokens.counted(at, size)
                words = tokens.joined(first, size)
                weight = np.array([times[x] if not kind else x not in times and (kind == 2 or x.rsplit(" ", 1)[0] not in times) for x in words], np.int64)
                keep = np.flatnonzero(weight)
                ids = batch.column(0).take(pa.array(tokens.row[first[keep]]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.string()).take(pa.array(keep)), pa.array((n * weight)[keep]), pa.array(np.full(len(keep), kind, np.int32))], ["doc_id", "phrase", "n", "size"])

    both = docs.select(F.col("doc_id").cast("long"), text.tokens(F.col("text")).alias("t"), text.spaced_tokens(F.col("text")).alias("s"))
    return both.mapInArrow(count, "doc_id long, phrase string, n long, size int")


def listed_counts(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """doc_id, phrase, n: how often each phrase of ``listed`` (phrase, lower case) stands in each document (one row) at word bounds,
    occurrences that overlap another of the same phrase left out; a phrase listed twice counts twice.

    An automaton over the list reads every text once.  A list of over ``MOST_LISTED`` phrases is cut by hash, and the
    texts are read once for each cut, so no task holds more.
    """
    times = stored(listed.where("phrase IS NOT NULL AND phrase != ''").groupBy("phrase").agg(F.count(F.lit(1)).alias("times")))
    cuts = -(-times.count() // MOST_LISTED)
    lower = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))

    def of(cut: int) -> DataFrame:
        known = {r["phrase"]: r["times"] for r in times.where(F.pmod(F.xxhash64("phrase"), F.lit(cuts)) == cut).collect()}  # about MOST_LISTED
        sent = docs.sparkSession.sparkContext.broadcast(known)

        def count(batches):
            times = sent.value
            matcher = Phrases(list(times))
            for batch in batches:
                rows = [(i, p, n * times[p]) for i, x in enumerate(batch.column(1).to_pylist()) if x for p, n in matcher.counts(x).items()]
                at, found, n = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["doc_id", "phrase", "n"])

        return lower.mapInArrow(count, "doc_id long, phrase string, n long")

    out = of(0) if cuts else lower.select("doc_id", F.lit("").alias("phrase"), F.lit(0).cast("long").alias("n")).where("false")
    for cut in range(1, cuts):
        out = out.unionByName(of(cut))
    return out


def dictionary_counts(docs: DataFrame) -> DataFrame:
    """doc_id, phrase, n: occurrences of listed phrases without ``to``."""
    return phrasal_counts(docs).where((F.col("size") == 0) & ~to_phrase(F.col("phrase"))).drop("size")


def dynamic_counts(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, phrase, n: unlisted word + particle pairs (size 2) without ``to``, and those followed by a third word (size 3)."""
    out = phrasal_counts(docs).where(F.col("size") == size).drop("size")
    return out.where(~to_phrase(F.col("phrase"))) if size == 2 else out


def phrasal_verbs(docs: DataFrame) -> DataFrame:
    """doc_id, phrase, n, from_dictionary: listed and dynamic counts together, none with ``to``."""
    parts = phrasal_counts(docs).where(~to_phrase(F.col("phrase")))
    return parts.groupBy("doc_id", "phrase").agg(F.sum("n").alias("n"), F.bool_or(F.col("size") == 0).alias("from_dictionary"))


def phrasal_candidates(phrases: DataFrame) -> DataFrame:
    """Listed phrases, and dynamic ones whose head is a word."""
    head = F.split("phrase", " ")[0]
    return phrases.where(F.col("from_dictionary") | (~head.isin(fixed.FRAGMENTS) & (F.length(head) >= 2)))


def passes_gates(idiom: Column, literal: Column) -> Column:
    return F.coalesce((idiom >= fixed.PHRASAL_IDIOM_GATE) & (literal <= fixed.PHRASAL_LITERAL_GATE), F.lit(False))


def word_examples(lines: DataFrame, words: DataFrame, k: int = 2, least: int = 10, most: int = 200) -> DataFrame:
    """word, place, line: for each word the first ``k`` distinct lines (at, line) that hold it as a whole word.

    A line is exploded to its distinct tokens and meets the words by equality; the group limit of the
    window is applied before the shuffle, so a word that stands in every line stays small.
    """
    shown = lines.where(F.length("line") >= least)
    tokens = shown.select("at", F.substring("line", 1, most).alias("line"), F.explode(F.array_distinct(text.tokens(F.col("line")))).alias("word"))
    first = tokens.join(words.select("word").distinct(), "word").groupBy("word", "line").agg(F.min("at").alias("at"))
    order = W.partitionBy("word").orderBy("at", "line")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("word", "place", "line")


def phrase_examples(docs: DataFrame, phrases: DataFrame, k: int = 2, least: int = 10, most: int = 260) -> DataFrame:
    """doc_id, phrase, place, sentence: sentences with the phrase at word bounds first, then such as hold it anyhow.

    A document's phrases (doc_id, phrase, of two words or more) come to its row, and one automaton over them reads its sentences, so
    neither sentences nor phrases are multiplied.
    """
    asked = phrases.where(F.size(F.split("phrase", " ")) > 1).groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases"))  # of one document
    told = text.sentences(F.col("text"), least, most)
    joined = F.transform("told", lambda x: F.concat(F.lit(" "), F.array_join(text.joined_tokens(x), " "), F.lit(" ")))
    rows = docs.join(asked, "doc_id").select(F.col("doc_id").cast("long"), "phrases", told.alias("told")).select("*", joined.alias("joined"), F.transform("told", F.lower).alias("lower"))

    def search(batches):
        for batch in batches:
            out: list[tuple] = []
            for row, (names, told, joined, lower) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)):
                whole, loose, found = Phrases([f" {p} " for p in names]), Phrases(names), {}
                for at, (sentence, one, low) in enumerate(zip(told, joined, lower, strict=True)):
                    bounded = {p[1:-1] for _, p in whole.found(one)}
                    for p in bounded | {p for _, p in loose.found(low)}:
                        own = found.setdefault(p, {})
                        own[sentence] = min(own.get(sentence, (2, 0)), (int(p not in bounded), at))
                for p, own in found.items():
                    out += [(row, p, place, x) for place, x in enumerate(sorted(own, key=own.__getitem__)[:k], 1)]
            at, names, places, told = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(told, pa.string())], ["doc_id", "phrase", "place", "sentence"])

    return rows.mapInArrow(search, "doc_id long, phrase string, place int, sentence string")


def legacy_examples(lines: DataFrame, words: DataFrame, k: int = 3, least: int = 10) -> DataFrame:
    """word, place, line: as ``word_examples`` of whole lines, repeats and all; watermarks go, lines of metadata are left out."""
    clean = F.col("line")
    for pattern in (r"<[^>]+>", r"\[.*?\]", *fixed.WATERMARKS):
        clean = F.regexp_replace(clean, pattern, "")
    shown = lines.select("at", clean.alias("line")).where(~F.col("line").rlike(fixed.METADATA))
    shown = shown.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where(F.length("line") > least)
    tokens = shown.select("at", "line", F.explode(F.array_distinct(text.tokens(F.col("line")))).alias("word"))
    order = W.partitionBy("word").orderBy("at", "line")
    found = tokens.join(words.select("word").distinct(), "word")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("word", "place", "line")


def ordered(value):
    """A key that sorts values, rows and nulls as Spark does."""
    if value is None:
        return (0,)
    return (1, *map(ordered, value.values())) if isinstance(value, dict) else (1, value)


def first_lines(lines: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
    """phrase, line, at: the lines of ``lines`` (at, line, tokens) whose tokens hold a phrase in a row, among them its first ``k`` distinct ones.

    A task reads its lines once and sends a phrase's first ``k`` alone, so neither lines nor their tokens are multiplied or shuffled: a line
    that is among the first of all is among the first of its task. A list of over ``MOST_LISTED`` phrases is cut by hash, and the lines are
    read once for each cut; a task that holds over ``MOST_HELD`` lines sends them and starts anew.
    """
    asked = stored(phrases.where("phrase IS NOT NULL").select("phrase").distinct())
    cuts = -(-asked.count() // MOST_LISTED)
    shape = f"phrase string, line string, at {dict(lines.dtypes)['at']}"

    def of(cut: int) -> DataFrame:
        known = {r["phrase"] for r in asked.where(F.pmod(F.xxhash64("phrase"), F.lit(cuts)) == cut).collect()}  # about MOST_LISTED
        sizes: dict[str, set[int]] = {}
        for p in known:
            sizes.setdefault(p.split(" ")[0], set()).add(p.count(" ") + 1)
        sent = lines.sparkSession.sparkContext.broadcast((known, sizes))

        def search(batches):
            known, sizes = sent.value
            held: dict[str, dict] = {}

            def flushed(kind):
                rows = [(p, line, at) for p, own in held.items() for line, (_, at) in own.items()]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.string(), kind), strict=True)], ["phrase", "line", "at"])

            for batch in batches:
                for at, line, tokens in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    found = {p for i, t in enumerate(tokens) if t in sizes for n in sizes[t] if (p := t if n == 1 else " ".join(tokens[i : i + n])) in known}
                    key = (ordered(at), line)
                    for p in found:
                        own = held.setdefault(p, {})
                        if line in own:
                            own[line] = min(own[line], (key, at), key=lambda x: x[0])
                        elif len(own) < k:
                            own[line] = (key, at)
                        elif key < (last := max(own.values(), key=lambda x: x[0]))[0]:
                            del own[last[0][1]]
                            own[line] = (key, at)
                if len(held) * k > MOST_HELD:
                    yield flushed(batch.column(0).type)
            if held:
                yield flushed(batch.column(0).type)

        return lines.select("at", "line", "tokens").mapInArrow(search, shape)

    out = of(0) if cuts else lines.select(F.lit("").alias("phrase"), "line", "at").where("false")
    for cut in range(1, cuts):
        out = out.unionByName(of(cut))
    return out


def judge_examples(lines: DataFrame, phrases: DataFrame, k: int = 2, least: int = 8, most: int = 220) -> DataFrame:
    """phrase, place, line: for each phrase its first ``k`` distinct lines, cut to ``most``."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"<[^>]+>", ""), r"\[.*?\]", ""), r"\s+", " "))
    shown = lines.select("at", clean.alias("line")).where(F.length("line") >= least)
    spoken = shown.select("at", "line", text.joined_tokens(F.col("line")).alias("tokens"))
    own = first_lines(spoken.select("at", F.substring("line", 1, most).alias("line"), "tokens"), phrases, k)
    first = own.groupBy("phrase", "line").agg(F.min("at").alias("at"))
    order = W.partitionBy("phrase").orderBy("at", "line")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("phrase", "place", "line")


def longest_first(phrases: DataFrame) -> DataFrame:
    """Phrases with their ``place`` in their document: more words first, then more frequent, then by letters."""
    return phrases.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n_tokens"), F.desc("n"), "phrase")))
