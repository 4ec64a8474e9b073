"""Periodic runs of words inside documents, by repeated k-gram masking and Main-Lorentz.

A run of period q is a longest stretch of words in which words q apart are equal, of at least
``max(min_length, exponent * q)`` words, q being its smallest period.  Such a stretch of length
m overlaps its own shift by q in m - q words, so every word of it lies in a k-gram that stands
in the document twice, where k is the smallest overlap any period allows
(``least_overlap``: 5 for runs of 6 words and 4 periods).  Words outside such k-grams are masked;
a run can't pass them.  Only the segments that survive are searched: short periods by
comparing the segment with its shifts, longer ones by Main and Lorentz's divide and conquer: a run
across the middle of an interval holds two of its four periods on one side of it, so that the
side's Z-function shows the period, and the run is followed to both its ends.  That is
O(n log n) for a segment of n words, whatever its content.

Documents are searched where they lie: no shuffle, and a task holds one batch of documents
and one document's words.  Defined results: null and empty texts have no words and no runs;
repeated rows are searched each; an empty table gives an empty result; other columns are ignored
but for those named in ``more``.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mixed, small

MIN_LENGTH = 6
EXPONENT = 4
#: Periods up to this are found by shifts of the whole segment.
SHORT = 8
RUN = "array<struct<start: long, length: long, period: long>>"


def least_overlap(min_length: int, exponent: int) -> int:
    """The fewest words that a run has in common with its shift by the period, over all periods."""
    return min(max(min_length, exponent * q) - q for q in range(1, max(2, min_length + 1)))


def segments(words: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The stretches of words that k-grams found twice or more cover; equal hashes of unlike k-grams only cover more."""
    n = len(words) - k + 1
    if n < 2:
        return []
    gram = np.zeros(n, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n].astype(np.uint64)
    gram = mixed(gram)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + k, -1)
    covered = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=np.int8(0))
    return list(zip(np.flatnonzero(covered == 1).tolist(), np.flatnonzero(covered == -1).tolist(), strict=True))


def z_function(s: list[int]) -> list[int]:
    """For each place how many items from there equal the items from the start."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        m = min(right - i, z[i - left]) if i < right else 0
        while i + m < n and s[m] == s[i + m]:
            m += 1
        if i + m > right:
            left, right = i, i + m
        z[i] = m
    return z


def reach(words: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest stretch of period q that holds the words from ``at`` to ``at + q``; both are equal."""

    def steps(same) -> int:
        done, size = 0, 64
        while True:
            part = same(done, size)
            if not part.all():
                return done + int(np.argmin(part))
            if len(part) < size:
                return done + len(part)
            done, size = done + size, 2 * size

    def before(done, size):
        stop = at - done
        start = max(0, stop - size)
        return (words[start:stop] == words[start + q : stop + q])[::-1]

    def after(done, size):
        start = at + done
        stop = min(len(words) - q, start + size)
        return words[start:stop] == words[start + q : stop + q]

    return at - steps(before), at + q + steps(after)


def runs_of_segment(words: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> dict[tuple[int, int], int]:
    """Smallest period of each run's (start, end)."""
    found: dict[tuple[int, int], int] = {}

    def note(start: int, end: int, q: int) -> None:
        if end - start >= max(min_length, exponent * q):
            found[start, end] = min(q, found.get((start, end), q))

    n = len(words)
    for q in range(1, min(SHORT, n // exponent) + 1):
        edge = np.diff((words[q:] == words[:-q]).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        long = end - start >= max(min_length, exponent * q)
        for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
            note(a, b, q)
    begun = sorted(found)
    starts, ends = [a for a, _ in begun], list(itertools.accumulate((b for _, b in begun), max))
    open_ = [(0, n)]
    while open_:
        left, right = open_.pop()
        at = bisect.bisect_right(starts, left) - 1
        if right - left < exponent * (SHORT + 1) or at >= 0 and ends[at] >= right:  # inside a run of a short period no other run of a longer one lies
            continue
        middle = (left + right) // 2
        open_ += [(left, middle), (middle, right)]
        for side, sign in ((words[middle:right], 1), (words[left:middle][::-1], -1)):
            most = len(side) // 2
            near = np.flatnonzero((side[1 : most + 1] == side[0]) & (side[2 : most + 2] == side[1])) + 1 if most > SHORT else ()
            if len(near) == 0 or near[-1] <= SHORT:
                continue
            z, known = z_function(side[: 2 * int(near[-1])].tolist()), 0
            for q in near.tolist():
                if q <= SHORT or z[q] < q or 2 * q <= known:  # within what is known, q is a multiple of a period found
                    continue
                start, end = reach(words, middle if sign > 0 else middle - 1 - q, q)
                known = max(known, end - middle if sign > 0 else middle - start)
                note(start, end, q)
    return found


def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by start, then period; ``words`` are equal numbers for equal words."""
    out = []
    for a, b in segments(words, least_overlap(min_length, exponent)):
        out += [(a + start, end - start, q) for (start, end), q in runs_of_segment(words[a:b], min_length, exponent).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT, more: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, n_words, runs (by start, then period), collapsed (the text with each run cut to one period, words joined by one space) and the columns ``more``."""
    if exponent < 4 or min_length < exponent:
        raise ValueError("a run has four periods at least, so that two of them lie on one side of any middle")
    names = [id_col, "n_words", "runs", "collapsed", *more]
    kinds = dict(docs.dtypes)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches):
        for batch in small(batches):
            n_words, all_runs, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()  # at [\x20\x09-\x0D]+
                number: dict[bytes, int] = {}
                runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64), min_length, exponent) if len(words) >= min_length else []
                if runs:
                    stay = kept_words(len(words), runs)
                    texts.append(b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s]).decode())
                else:
                    texts.append(b" ".join(words).decode())
                n_words.append(len(words))
                all_runs.append([{"start": a, "length": m, "period": q} for a, m, q in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(all_runs, kind), pa.array(texts, pa.string()), *(batch.column(2 + i) for i in range(len(more)))], names)

    schema = f"`{id_col}` {kinds[id_col]}, n_words long, runs {RUN}, collapsed string" + "".join(f", `{c}` {kinds[c]}" for c in more)
    return docs.select(*(F.col(f"`{c}`") for c in (id_col, text_col, *more))).mapInArrow(search, schema)


def strongest(runs: Column | str) -> Column:
    """The run of the greatest length / period; of equal ones that of the smallest start, then period.  Null without runs."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.reduce(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where documents of crc32(doc_id) mod 10 = 0 repeat a stretch of their own words up to their end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.nullif(F.size("words"), F.lit(0)), F.floor(F.col("h") / 10)
    parted = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    parted = parted.withColumns({"a": (g % n), "p": 1 + F.floor((n - g % n) / (3 + g % 8))})
    word = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.try_element_at("words", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")))
    return parted.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them with planted ones: their number, the strongest, and checksums of all runs and of the collapsed text."""
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = strongest("runs")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


CRC32_SQL = r"""
crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
hashed AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc_table)"""

OP13_SQL = (
    "WITH"
    + CRC32_SQL
    + r""",
given AS (SELECT row_number() OVER () AS r, doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM hashed),
placed AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN g % len(ws) END AS a FROM given),
edited AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS ws FROM placed),
words AS (SELECT r, n, unnest(ws) AS w, unnest(range(n)) AS i FROM edited),
grams AS (SELECT r, n, i, hash(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS gram FROM words WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY i <= n - 5),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.r = y.r AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
stretches AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
cuts AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT words.r, string_agg(w, ' ' ORDER BY words.i) AS text FROM words LEFT JOIN cuts ON words.r = cuts.r AND words.i = cuts.i WHERE cuts.r IS NULL GROUP BY words.r),
best AS (SELECT x.* FROM runs x QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS HUGEINT) * 1000000000 // period DESC, start, period) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM edited LEFT JOIN listed ON edited.r = listed.r LEFT JOIN best ON edited.r = best.r LEFT JOIN kept ON edited.r = kept.r
"""
)
