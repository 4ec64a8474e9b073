"""What several operators need: tables in the shared folder, Arrow helpers, word and shingle hashes."""

from __future__ import annotations

import gc
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import forget, remove, stored, written  # noqa: F401

#: Text bytes handled at once by the vectorised scans; a longer text is handled alone.
SLICE_BYTES = 1_000_000

#: Rows of one key that an ordinary join takes at least.
HOT_ROWS = 10_000

#: The bytes that part words: ``[\x20\x09-\x0D]``.
SPACES = [32, 9, 10, 11, 12, 13]


def forget_since(n: int, keep: DataFrame) -> None:
    """Delete the tables that ``stored`` wrote after the first ``n``, but for ``keep``."""
    for spark, path in written[n:]:
        if path != keep.stored_at:
            remove(spark, path)
    written[n:] = [x for x in written[n:] if x[1] == keep.stored_at]


def tables_written() -> int:
    return len(written)


def unreserved(df: DataFrame) -> DataFrame:
    """``df`` without columns of the prefix ``wordtide_``, which the operators use for their own."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("wordtide_")))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of queries that are over; it does so when they are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def met(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to the stored table ``found``: one row for each key, with ``size``, the number of the key's rows.

    Keys with a thousandth of all these rows or more are a thousand at most; they are broadcast and their rows stay
    where they are. All others use an ordinary join."""
    least = max(HOT_ROWS, (found.agg(F.sum("size")).first()[0] or 0) // 1000)
    hot = found.where(F.col("size") >= least)
    if hot.isEmpty():
        return rows.join(found, key, how)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.where(F.col("size") < least), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def asc_lower(col):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ inside tasks


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pa.array([], pa.large_string()) if len(column) == 0 else column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows whose bytes come to about ``most`` at a time."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def small(batches, rows: int = 512):
    """The batches in pieces of a few rows, so that Python objects exist for these alone."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def kept_by_worker(make, *args):
    """``make(*args)``, made once in each Python worker and used again by its later tasks until another one is asked for: a worker
    that serves several stages holds one."""
    state = sys.modules.setdefault("wordtide_worker_state", types.ModuleType("wordtide_worker_state")).__dict__
    key = (make.__name__, args)
    if key not in state:
        for old in [k for k in state if isinstance(k, tuple)]:
            del state[old]
        state[key] = make(*args)
    return state[key]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Scanner:
    """Vectorised hashes of words and shingles over slices of UTF-8 text.

    A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums
    and an inverse power, then mixed; so no Python code runs per word.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, separators=None) -> None:
        self.space = np.zeros(256, bool)
        self.space[SPACES if separators is None else separators] = True
        lower = np.arange(256)
        lower[65:91] += 32
        self.value = mixed(lower.astype(np.uint64) + np.uint64(0x51ED270B))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, SLICE_BYTES)
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row, start and end (exclusive) of every word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
        n = len(data)
        if n == 0:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, none
        self.grow(n)
        solid = ~self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts, ends = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1] | edge[1:n]
        ends[:-1] &= ~solid[1:] | edge[1:n]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.value[data] * self.powers[:n], dtype=np.uint64, out=sums[1:])
        self.sums = sums
        h = mixed((sums[end] - sums[start]) * self.inverse[start])
        return h, np.searchsorted(offsets, start, "right") - 1, start, end

    def shingles(self, data: np.ndarray, offsets: np.ndarray, k: int = 5):
        """For each row the sorted distinct 64-bit hashes of its ``k``-word shingles; a shorter row is one shingle."""
        h, row, _, _ = self.words(data, offsets)
        ends = np.searchsorted(row, np.arange(len(offsets)))
        base = np.uint64(0xD6E8FEB86659FD93)
        total = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for j in range(k):
            total = total * base + h[j : j + len(total)]
        total = mixed(total)
        for i in range(len(offsets) - 1):
            a, b = ends[i], ends[i + 1]
            if b - a >= k:
                yield np.unique(total[a : b - k + 1])
            elif b > a:
                short = np.uint64(b - a)
                for x in h[a:b]:
                    short = np.uint64((int(short) * int(base) + int(x)) & 0xFFFFFFFFFFFFFFFF)
                yield mixed(np.array([short ^ np.uint64(0xA5A5A5A5)]))
            else:
                yield h[:0]
