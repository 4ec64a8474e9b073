"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing (Cole and Vishkin; Sahinalp and Vishkin) parses a text into
phrases: runs of equal symbols become one symbol, so neighbours differ; each symbol's label
becomes twice the lowest bit position in which it differs from its left neighbour, plus that
bit, until six labels are left; local maxima start phrases.  A phrase is named by a hash of
its symbols, the names are the symbols of the next level, and so on until one is left.  A
cut depends on a few symbols around it only, so equal substrings get the same phrases in
their interior at whatever offset they stand.

The fingerprint is a one-permutation min-hash of the phrase names of levels two and up (of
texts of few phrases from level one), a name's repeats counted as names of their own: ``SLOTS``
slots of one byte, in hex.  Likeness is the share of agreeing slots less what chance gives.

Everything runs on byte arrays of many texts at once.  Defined results: null counts as the
empty text, whose slots are all zero; equal texts have equal fingerprints; a text of one
symbol is its own phrase; very long texts are parsed whole; an empty table gives an empty
result; rows that repeat a doc_id follow each other in the order of their texts; a null
doc_id comes before all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, kept_by_worker, mixed, shuffle_partitions, slices, small

SLOTS = 128
FIRST_LEVEL = 2
#: Texts of so few phrases at the first level are also told by these.
FEW = 24
#: Ranges of doc_id into which the order is cut; the driver knows one id for each.
MOST_RANGES = 10_000
ROWS_A_RANGE = 10_000

ODD = np.uint64(0x9E3779B97F4A7C15)


class Parser:
    """Fingerprints of slices of texts."""

    BASE = 0xC2B2AE3D27D4EB4F

    def __init__(self) -> None:
        self.value = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F491))
        low = np.array([(x & -x).bit_length() - 1 if x else 0 for x in range(256)], np.uint8)
        label, other = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
        k = low[label ^ other]
        self.toss = (2 * k + ((label >> k) & 1)).astype(np.uint8)  # [own, left]
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def names(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the phrases of every sequence symbols[bounds[i]:bounds[i + 1]], and their bounds."""
        n = len(symbols)
        new = np.ones(n, bool)
        new[1:] = symbols[1:] != symbols[:-1]
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        new[starts] = True
        at = np.flatnonzero(new)
        lengths = np.diff(at, append=n).astype(np.uint64)
        kept = symbols[at]
        bounds = np.searchsorted(at, bounds)
        starts = np.searchsorted(at, starts)
        if kept.dtype == np.uint8:
            values, labels, rounds = self.value[kept] + lengths * ODD, kept, 3
        else:
            left = np.empty_like(kept)
            left[1:] = kept[:-1]
            left[starts] = kept[starts] ^ np.uint64(1)
            lowest = kept ^ left
            lowest &= np.uint64(0) - lowest
            labels = 2 * np.bitwise_count(lowest - np.uint64(1)) + ((kept & lowest) != 0)
            values, rounds = mixed(kept + lengths * ODD), 3
        for _ in range(rounds):
            left = np.empty_like(labels)
            left[1:] = labels[:-1]
            left[starts] = labels[starts] ^ 1
            labels = self.toss[labels, left]
        peak = np.ones(len(at), bool)
        peak[1:] = labels[1:] > labels[:-1]
        peak[:-1] &= labels[:-1] > labels[1:]
        peak[bounds[1:][bounds[1:] > 0] - 1] = False  # a last symbol has no right neighbour yet
        peak[starts] = True
        first = np.flatnonzero(peak)
        end = np.append(first[1:], len(at))
        self.grow(len(at))
        sums = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(at)], dtype=np.uint64, out=sums[1:])
        h = (sums[end] - sums[first]) * self.inverse[first] + (end - first).astype(np.uint64) * ODD
        return mixed(h), np.searchsorted(first, bounds)

    def fingerprints(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of ``SLOTS`` bytes for each text."""
        rows = len(offsets) - 1
        least = np.full(rows * SLOTS, 1 << 32, np.uint64)
        symbols, bounds, row, level = data, offsets, np.arange(rows), 0
        while len(symbols):
            symbols, bounds = self.names(symbols, bounds)
            level += 1
            size = np.diff(bounds)
            used = np.repeat(size <= FEW if level < FIRST_LEVEL else size > 0, size)
            at = np.repeat(row, size)[used]
            names = numbered(symbols[used], at)
            np.minimum.at(least, at * SLOTS + (names >> np.uint64(57)).astype(np.int64), (names >> np.uint64(20)) & np.uint64(0xFFFFFFFF))
            going = size > 1
            symbols = symbols[np.repeat(going, size)]
            row, size = row[going], size[going]
            bounds = np.append(0, np.cumsum(size))
        return densified(least.reshape(rows, SLOTS))


def numbered(names: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The names, those that repeat within a row marked by how often they stood before: likeness counts repeats."""
    key = names ^ (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key)
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    before = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    again = before > 0
    out = names.copy()
    out[order[again]] = mixed(names[order[again]] + before[again].astype(np.uint64) * ODD)
    return out


def densified(least: np.ndarray) -> np.ndarray:
    """An empty slot takes the value of the next filled one, marked by the distance; then one byte of each."""
    filled = least < 1 << 32
    spots = np.where(np.concatenate([filled, filled], 1), np.arange(2 * SLOTS), 1 << 20)
    nearest = np.minimum.accumulate(spots[:, ::-1], 1)[:, ::-1][:, :SLOTS]
    far = (nearest - np.arange(SLOTS)).astype(np.uint64)
    out = mixed(np.take_along_axis(least, nearest % SLOTS, 1) + far * ODD).astype(np.uint8)
    out[~filled.any(1)] = 0
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of rows of fingerprints, the share of the phrases they hold in common, from 0 to 1."""
    agree = (one == two).mean(1)
    return np.clip((agree - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def fingerprint_texts(parser: Parser, texts: list[bytes]) -> np.ndarray:
    offsets = np.append(0, np.cumsum([len(x) for x in texts])).astype(np.int64)
    out = np.zeros((len(texts), SLOTS), np.uint8)
    for i, j in slices(offsets):
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        out[i:j] = parser.fingerprints(data, offsets[i : j + 1] - offsets[i])
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; no shuffle."""

    def scan(batches):
        parser = kept_by_worker(Parser)
        for batch in small(batches):
            prints = fingerprint_texts(parser, [(x or "").encode() for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(scan, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (range, extra, doc_id, text) sorted within partitions that hold whole ranges of doc_id.

    After the rows of each range stands, marked ``extra``, the first row of the range that
    follows, or of the first one: so every row's successor is in its own partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    ranges = int(min(MOST_RANGES, max(4 * shuffle_partitions(spark), n // ROWS_A_RANGE)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    sent = spark.sparkContext.broadcast(np.array(cuts, np.int64))  # MOST_RANGES at most

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sent.value, ids.to_numpy(), "right"), pa.int32())

    rows = rows.select(range_of("doc_id").alias("range"), F.lit(False).alias("extra"), "doc_id", "text")
    heads = sorted(tuple(r) for r in rows.groupBy("range").agg(F.min("doc_id")).collect())  # one row for each range
    after = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    target = spark.createDataFrame(after, "head long, target int")
    extra = rows.join(F.broadcast(target), F.col("doc_id") == F.col("head")).groupBy("target", "doc_id").agg(F.min("text").alias("text"))
    extra = extra.select(F.col("target").alias("range"), F.lit(True).alias("extra"), "doc_id", "text")
    return rows.unionByName(extra).repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range", "extra", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` (rounded down) replaced by the first as many characters of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts, and the likeness to the edited text and the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def scan(batches):
        parser = kept_by_worker(Parser)
        held = None  # the last row, whose successor is in the next batch
        for batch in small(batches):
            where, extra, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts = batch.column(3).to_pylist()
            if held is not None:
                where, extra, ids = (np.concatenate([x, y]) for x, y in zip(held[:3], (where, extra, ids), strict=True))
                texts = [held[3], *texts]
            prints = fingerprint_texts(parser, [x.encode() for x in texts])
            own = np.flatnonzero(~extra[:-1])
            changed = [edited(texts[i], texts[i + 1]).encode() for i in own]
            other = fingerprint_texts(parser, changed)
            if len(own):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[own]),
                        pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
                        pa.array([prints[i].tobytes().hex() for i in own], pa.string()),
                        pa.array([x.tobytes().hex() for x in other], pa.string()),
                        pa.array(likeness(prints[own], other)),
                        pa.array(likeness(prints[own], prints[own + 1])),
                    ],
                    names,
                )
            held = where[-1:], extra[-1:], ids[-1:], texts[-1]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = in_order(docs, "doc_id", "text").mapInArrow(scan, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
