"""Best-fit-decreasing packing of documents into sequences of at most ``capacity`` tokens.

Tokenising tasks cut each document into pieces and number the pieces of one length within
the task.  Best-fit decreasing depends on nothing but how many pieces have each length, a
table of at most ``capacity`` rows whatever the corpus: the driver packs that table with a
segment tree over remaining capacities (the tightest open bin for a piece in logarithmic
time) and gets runs: pieces number a to b of length l fill bins number c onwards from
offset d.  Tasks then look up each piece's run by its number.  The outcome is exactly that
of best-fit decreasing over all pieces, and no text or id passes the driver.

Defined results: null text counts as empty, which is the end token alone; repeated rows are
packed as often as they stand; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import kept_by_worker, small, stored

CAPACITY = 1024
END_ID = 2


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Little-endian 32-bit ids of a text, as the ``tokenizers`` file gives them.

    ``tiktoken`` with the same ranks and split pattern gives the same ids several times as
    fast; texts that hold one of the file's special strings, or a run of white space of ``WHITE_RUN``
    characters or more, which is too much for its regular expressions, go to ``tokenizers`` itself.
    """

    WHITE_RUN = 100_000

    def __init__(self, path: str) -> None:
        import json

        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {}
        spare = 256
        for b in range(256):  # byte-level alphabet: printable bytes stand for themselves, others from 256 on
            plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
            byte_of[chr(b if plain else spare)] = b
            spare += not plain
        self.special = [x["content"] for x in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        white = len(text) >= self.WHITE_RUN and max(map(len, re.findall(r"\s+", text)), default=0) >= self.WHITE_RUN
        if not white and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class OpenBins:
    """Open bins by remaining capacity: a segment tree of counts, and runs of bin numbers at its leaves."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, n: int) -> None:
        at = self.width + left
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.runs[left].append((first, n))
            self._add(left, n)

    def take(self, left: int) -> tuple[int, int]:
        first, n = self.runs[left].pop()
        self._add(left, -n)
        return first, n

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity from ``least`` up that an open bin has."""
        at = self.width + least
        if self.count[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, number of its first piece, first bin, pieces a bin, offset) and the number of bins."""
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            left = bins.tightest(length)
            if left is None:
                left, first, have = capacity, opened, -(-(n - done) // (capacity // length))
                opened += have
            else:
                first, have = bins.take(left)
            each = left // length  # a bin just filled stays the tightest while another piece fits
            full = min(have, (n - done) // each)
            if full:
                runs.append((length, done, first, each, capacity - left))
                bins.put(left - each * length, first, full)
                done += full * each
            if full < have and done < n:  # fewer pieces are left than one bin takes
                runs.append((length, done, first + full, each, capacity - left))
                bins.put(left - (n - done) * length, first + full, 1)
                full, done = full + 1, n
            bins.put(left, first + full, have - full)
    return runs, opened


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, path: str, *more: str) -> DataFrame:
    """One row per piece, with its task and its number among the task's pieces of that length."""

    def cut(batches):
        encoder, seen, part = kept_by_worker(ByteBpe, path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in small(batches):
            rows: list[list[int]] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                start, total = 0, len(ids) // 4
                stop = total % capacity or capacity
                piece = 0
                while start < total:
                    length = stop - start
                    for row, x in zip(rows, (i, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), seen[length]), strict=True):
                        row.append(x)
                    seen[length] += 1
                    piece, start, stop = piece + 1, stop, stop + capacity
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:]), pa.array(np.full(len(at), part, np.int64)), *(batch.column(2 + k).take(at) for k in range(len(more)))], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "own", "part", *more]
    kinds = dict(docs.dtypes)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, own long, part long" + "".join(f", `{c}` {kinds[c]}" for c in more)
    return docs.select(F.col(id_col).cast("long"), text_col, *more).mapInArrow(cut, schema)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and the columns ``more`` of ``docs``."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, id_col, text_col, capacity, end_id, path or vocabulary_path(), *more))
    sizes = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    runs, _ = best_fit_decreasing(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(table)
    before = sizes.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more]

    def place(batches):
        table = sent.value
        keys = table[:, 0] * (1 << 50) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("own").to_numpy() + batch.column("before").to_numpy()
            run = table[np.searchsorted(keys, length * (1 << 50) + number, "right") - 1]
            ahead = number - run[:, 1]
            bin_, offset = run[:, 2] + ahead // run[:, 3], run[:, 4] + ahead % run[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(bin_), pa.array(offset), *(batch.column(c) for c in more)], names)

    kinds = dict(docs.dtypes)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + "".join(f", `{c}` {kinds[c]}" for c in more)
    return ranked.mapInArrow(place, schema)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of 1024 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
