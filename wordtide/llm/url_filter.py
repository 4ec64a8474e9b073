"""URL filters: rules first, then naive Bayes over host and path words cut by Viterbi segmentation.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's; the longest wins.  The urls that rules judge are the training examples.  All other
urls are judged by multinomial naive Bayes over their words:

* runs of letters in hosts and paths are cut into words by unigram Viterbi, over word counts
  of all the pages' visible text; a run of digits counts as its length;
* the segmentation hashes all substrings of distinct letter runs that have a word's length, from prefix sums and
  without writing them, and passes on those that a sieve of all words' hashes (``SIEVE_BITS`` bits,
  whatever the vocabulary) lets through; these meet the word counts by a join, so no vocabulary is held in a task; the
  dynamic program sees one run's matches at a time;
* evidence is summed over distinct hosts and distinct path shapes (digits as 0) before it
  meets the pages, so a host with a third of all pages is segmented and scored once.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and gets the prior's verdict; without any judged url every score is 0, which allows; runs and
words of any length are looked up; repeated rows are judged alike and count in training as
often as they stand; null html has no words; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import asc_lower, met, mixed, slices, stored

#: Bits of the sieve of words; with more words it lets more substrings through to the join.
SIEVE_BITS = 1 << 25

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_parts(url):
    """Host (A-Z lower-cased) and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return asc_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def fitting_rule(host, path, rules=RULES):
    """The longest rule that fits, written host and path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """word, n over the visible text of all pages."""
    text = F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def prefix_hashes(run: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial over a run's code points, and the inverse powers that make any substring's hash from two of them."""
    points = np.frombuffer(run.encode("utf-32-le"), "<u4").astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    powers, inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(points), x, np.uint64)), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    return np.append(np.uint64(0), np.cumsum(mixed(points + np.uint64(1)) * powers[:-1], dtype=np.uint64)), inverse


def substring_hashes(sums: np.ndarray, inverse: np.ndarray, size: int) -> np.ndarray:
    """A hash of every substring of ``size`` letters."""
    n = len(sums) - size
    return mixed((sums[size:] - sums[:n]) * inverse[:n] + np.uint64(size))


def word_sieve(counts: DataFrame) -> np.ndarray:
    """A bit for each hash of a word modulo ``SIEVE_BITS``; Spark joins the bits, and 64 of them make a row."""

    def bits(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            sums, inverse = prefix_hashes("".join(words))
            sizes = np.array([len(w) for w in words], np.int64)
            start = np.cumsum(sizes) - sizes
            at = mixed((sums[start + sizes] - sums[start]) * inverse[start] + sizes.astype(np.uint64)) % np.uint64(SIEVE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(64)).astype(np.int32)), pa.array((np.uint64(1) << at % np.uint64(64)).view(np.int64))], ["at", "bits"])

    rows = counts.where("word != ''").select("word").mapInArrow(bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # SIEVE_BITS / 64 rows at most
    sieve = np.zeros(SIEVE_BITS // 64, np.int64)
    sieve[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return sieve.view(np.uint64)


def segmented(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """token, words: the most likely split of each distinct token, of any length, into words; ``counts`` is read several times.

    A token's substrings of the lengths that words have pass the sieve of all words and meet the words by equality.
    """
    total, sizes = counts.agg(F.sum("n"), F.collect_set(F.length("word"))).first()  # one number for each length of a word
    total, sizes = float(total or 1), np.array(sorted(x for x in sizes or [] if x), np.int64)
    runs = tokens.select("token").distinct()
    sent = runs.sparkSession.sparkContext.broadcast(word_sieve(counts))

    def spot(batches):
        sieve = sent.value
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            lengths = np.array([len(t) for t in tokens], np.int64)
            for first, last in slices(np.append(0, np.cumsum(lengths))):
                joined, own = "".join(tokens[first:last]), lengths[first:last]
                ends, owner = np.cumsum(own), np.repeat(np.arange(first, last), own)
                start, until = np.repeat(ends - own, own), np.repeat(ends, own)
                sums, inverse = prefix_hashes(joined)
                for size in sizes[sizes <= own.max(initial=0)].tolist():
                    h = substring_hashes(sums, inverse, size) % np.uint64(SIEVE_BITS)
                    held = sieve[h // np.uint64(64)] >> h % np.uint64(64) & np.uint64(1) != 0
                    at = np.flatnonzero(held & (np.arange(len(h)) + size <= until[: len(h)]))
                    for a in range(0, len(at), most := max(1, 1_000_000 // size)):
                        part = at[a : a + most]
                        of = pa.array(owner[part])
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(of), batch.column(2).take(of), pa.array(part - start[part] + 1, pa.int32()), pa.array([joined[i : i + size] for i in part.tolist()], pa.string())], ["high", "low", "at", "word"])

    named = runs.select("token", F.xxhash64("token").alias("high"), F.xxhash64("token", F.lit("run")).alias("low"))
    spots = stored(named.mapInArrow(spot, "high long, low long, at int, word string"))
    asked = stored(spots.groupBy("word").agg(F.count(F.lit(1)).alias("size")).join(counts, "word"))
    found = met(spots, asked, "word").groupBy("high", "low").agg(F.collect_list(F.struct("at", F.length("word").alias("size"), "n")).alias("found"))  # a token's own matches

    def split(batches):
        for batch in batches:
            words = []
            for token, matches in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [matches.values.field(c).to_numpy() for c in ("at", "size", "n")] if matches.is_valid else [np.zeros(0, np.int64)] * 3
                words.append(viterbi(token, own[0] - 1, own[1], own[2], total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["token", "words"])

    return named.join(found, ["high", "low"], "left").select("token", "found").mapInArrow(split, "token string, words array<string>")


def viterbi(token: str, *found_and_total) -> list[str]:
    """The split of highest unigram probability, from start, size and count of every known word in ``token`` (three arrays, or one list of
    triples) and the ``total`` of all counts.

    An unknown word of k letters has probability 10**-k / (1 + total / 10), so it is never cut in two and its best start
    is known from the running maximum of best[start] + start * log(10): time grows with the letters and matches only.
    """
    *found, total = found_and_total
    starts, sizes, counts = found if len(found) == 3 else np.array(found[0], np.int64).reshape(-1, 3).T
    order = np.lexsort((starts, starts + sizes))
    at, until, chance = starts[order].tolist(), (starts + sizes)[order].tolist(), np.log(counts[order] / total).tolist()
    k, n = 0, len(at)
    new, letter = -math.log1p(total / 10), math.log(10)
    best, back = [0.0], [0]
    open_, opened = 0.0, 0
    for end in range(1, len(token) + 1):
        score, start = open_ + new - end * letter, opened
        while k < n and until[k] == end:
            if (best[at[k]] + chance[k], at[k]) > (score, start):
                score, start = best[at[k]] + chance[k], at[k]
            k += 1
        best.append(score)
        back.append(start)
        if score + end * letter >= open_:
            open_, opened = score + end * letter, end
    out, end = [], len(token)
    while end:
        out.append(token[back[end] : end])
        end = back[end]
    return out[::-1]


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of allow; null where a rule decides)."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.regexp_replace("path", "[0-9]", "0").alias("shape"))

    sides = F.explode(F.array(F.struct(F.lit("host").alias("side"), F.col("host").alias("unit")), F.struct(F.lit("path").alias("side"), F.col("shape").alias("unit")))).alias("u")
    asks = F.count_if(F.col("ruled").isNull()).alias("size")
    units = rows.select("ruled", sides).groupBy("u.side", "u.unit").agg(F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block"), asks)
    units = stored(units)
    tokens = units.select("*", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(r"(\p{L}+|\p{N}+)"), 1)).alias("token"))
    number = F.regexp_like("token", F.lit(r"^\p{N}"))
    numbers = tokens.where(number).select("side", "unit", "allow", "block", F.concat(F.lit("#"), F.length("token")).alias("word"))
    letters = tokens.where(~number)
    met_often = letters.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    splits = stored(segmented(letters, stored(word_counts(pages, html_col))).join(met_often, "token"))
    cut = met(letters, splits, "token").select("side", "unit", "allow", "block", F.explode("words").alias("word"))
    words = stored(cut.unionByName(numbers).groupBy("side", "unit", "word").agg(F.count(F.lit(1)).alias("times"), F.first("allow").alias("allow"), F.first("block").alias("block")))

    seen = words.groupBy("side", "word").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("times") * F.col("allow")).alias("a"), F.sum(F.col("times") * F.col("block")).alias("b"))
    seen = stored(seen)
    a, b, v = seen.agg(F.sum("a"), F.sum("b"), F.count(F.lit(1))).first()
    a, b = a or 0, b or 0
    weight = F.log((F.col("a") + 1) / F.lit(float(a + v + 1))) - F.log((F.col("b") + 1) / F.lit(float(b + v + 1)))
    of = F.concat("side", F.lit(":"), "word")
    weights = stored(seen.select(of.alias("of"), "size", (weight if a + b else F.lit(0.0)).alias("weight")))
    scores = stored(met(words.withColumn("of", of), weights, "of").groupBy("side", "unit").agg(F.sum(F.col("times") * F.col("weight")).alias("score")))
    n = units.where("side = 'host'").agg(F.sum("allow"), F.sum("block")).first()
    prior = math.log(((n[0] or 0) + 1) / ((n[1] or 0) + 1))

    scored = units.where("size > 0").join(scores, ["side", "unit"], "left")
    hosts = stored(scored.where("side = 'host'").select(F.col("unit").alias("host"), F.col("score").alias("host_score"), "size"))
    shapes = stored(scored.where("side = 'path'").select(F.col("unit").alias("shape"), F.col("score").alias("path_score"), "size"))
    open_ = met(met(rows.where("rule IS NULL"), hosts, "host").drop("size"), shapes, "shape").drop("size")
    score = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    open_ = open_.select("page_id", "host", "path", "rule", F.when(score >= 0, "allow").otherwise("block").alias("verdict"), score.alias("score"))
    return rows.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score")).unionByName(open_)


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every url of ``pages``."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
