"""Line dedup by a sharded minimal perfect hash over the hashes of repeated lines.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points that stand in two documents or more lose all
their lines but those of the smallest doc_id that holds them.

1. Map tasks emit each document's distinct 128-bit key hashes; a partial aggregation keeps
   one row per key and task before the shuffle, so a line found everywhere stays small.
2. Hashes that occur in two documents are dealt to shards of about ``KEYS_A_SHARD`` keys.
   A task turns a shard into a minimal perfect hash (levels of bit arrays with ranks), a
   fingerprint array, a count array and an array of owning documents.
3. Documents probe the arrays.  Up to ``BROADCAST_BYTES`` of arrays (their size is summed
   first) are broadcast, and the texts are not shuffled at all.  Beyond that, the probes are
   dealt to the shards, whose arrays stream past them, and the answers return to the
   documents by doc_id.  Both ways give the same rows.

Two repeated keys are told apart by 128 bits of hash; a probe is taken for the key of its slot,
which all 128 bits choose, if 64 of them agree with the fingerprint.  Defined results: null or empty
text is one empty line; rows that repeat a doc_id count as one document; a null doc_id
counts as the largest one; empty tables give empty results; other columns pass through, but
for those of the reserved prefix ``wordtide_``.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shuffle_partitions, small, stored, unreserved

MIN_CHARS = 10
KEYS_A_SHARD = 500_000
BROADCAST_BYTES = 64_000_000
#: Repeated lines of a shard that one task probes.
PROBES_A_TASK = 5_000_000
NO_ID = (1 << 63) - 1


class MinimalHash:
    """A minimal perfect hash of 128-bit keys: at each level, keys alone in their slot are settled there."""

    GAMMA = 1.5

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.levels = []  # (slots, bit words, rank before each word)
        self.n = 0
        level = 0
        while len(high):
            slots = -(-max(64, int(self.GAMMA * len(high))) // 64) * 64
            at = self.slot(high, low, level, slots)
            alone = np.bincount(at, minlength=slots) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((slots, words, self.n + np.cumsum(ones) - ones))
            self.n += int(ones.sum())
            left = ~alone[at]
            high, low, level = high[left], low[left], level + 1

    @staticmethod
    def slot(high: np.ndarray, low: np.ndarray, level: int, slots: int) -> np.ndarray:
        h = low + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        for high_or_none in (high, None):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            if high_or_none is not None:
                h = h ^ high_or_none
        return ((h ^ (h >> np.uint64(32))) % np.uint64(slots)).astype(np.int64)

    def __call__(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The index of every member; a key that is no member gets any index, or -1."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (slots, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = self.slot(high[left], low[left], level, slots)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (ranks[at >> 6] + below)[hit]
            left = left[~hit]
        return out


class LineIndex:
    """One shard: fingerprints, document counts and owners in the order of the minimal hash."""

    def __init__(self, high: np.ndarray, low: np.ndarray, owner: np.ndarray, count: np.ndarray) -> None:
        self.hash = MinimalHash(high, low)
        at = self.hash(high, low)
        self.prints, self.owners, self.counts = np.empty_like(low), np.empty_like(owner), np.empty(len(at), np.uint32)
        self.prints[at], self.owners[at], self.counts[at] = low, owner, np.minimum(count, 0xFFFFFFFF)

    def body(self) -> bytes:
        return pickle.dumps((self.hash.levels, self.hash.n, self.prints, self.owners, self.counts), 5)

    @classmethod
    def opened(cls, body: bytes) -> LineIndex:
        one = cls.__new__(cls)
        one.hash = MinimalHash.__new__(MinimalHash)
        one.hash.levels, one.hash.n, one.prints, one.owners, one.counts = pickle.loads(body)
        return one

    def owner(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The document that keeps each key's lines; -1 for keys that are not repeated."""
        at = self.hash(high, low)
        known = at >= 0
        known[known] = self.prints[at[known]] == low[known]
        out = np.full(len(at), -1, np.int64)
        out[known] = self.owners[at[known]]
        return out

    def known(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        at = self.hash(high, low)
        out = at >= 0
        out[out] = self.prints[at[out]] == low[out]
        return out


def line_hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line its key's 128-bit hash, or None for a key that is too short."""
    out = []
    for key in (text or "").encode().lower().split(b"\n"):  # bytes.lower and bytes.strip act on ASCII alone
        key = key.strip()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """high, low, doc_id: the distinct keys of every document."""

    def emit(batches):
        for batch in small(batches):
            found, ids, counts = [], batch.column(0).to_numpy(zero_copy_only=False), []
            for text in batch.column(1).to_pylist():
                keys = set(line_hashes(text, min_chars))
                keys.discard(None)
                found += keys
                counts.append(len(keys))
            high, low = halves(found)
            yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(np.repeat(ids.astype(np.int64), counts))], ["high", "low", "doc_id"])

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), text_col).mapInArrow(emit, "high long, low long, doc_id long")


def line_index(lines: DataFrame) -> DataFrame:
    """shard, shards, body: the arrays of the ``LineIndex`` of each shard of the repeated keys; load: the sum of their counts."""
    repeated = lines.groupBy("high", "low").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("owner != last")
    repeated = stored(repeated.select("high", "low", "owner", "n"))
    shards = max(1, -(-repeated.count() // KEYS_A_SHARD))

    def build(pdf):
        high, low = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low"))
        index = LineIndex(high, low, pdf["owner"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
        return pdf.head(1)[["shard"]].assign(shards=shards, load=int(pdf["n"].sum()), body=index.body())

    return stored(repeated.withColumn("shard", F.pmod(F.shiftrightunsigned("high", 8), F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, shards long, load long, body binary"))


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The columns of ``docs``, ``text_col`` without its dropped lines (null stays null), and two more:
    ``wordtide_n_lines`` (before dropping) and ``wordtide_n_dropped``."""
    docs = unreserved(docs)
    index = line_index(line_rows(docs, id_col, text_col, min_chars))
    size = index.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if size <= broadcast_bytes:
        return _probed_in_place(docs, index, id_col, text_col, min_chars)
    return _probed_by_shard(docs, index, id_col, text_col, min_chars)


def _outcome(docs: DataFrame, text_col: str, apply) -> DataFrame:
    """Runs ``apply(batch)``, which gives for each row the hashes of its lines and the set of those to drop."""
    names = docs.columns
    at = names.index(text_col)
    kept_names = [n for n in names if n not in ("wordtide_drop", "wordtide_key")]
    schema = T.StructType([f for f in docs.schema if f.name in kept_names]).add("wordtide_n_lines", "long").add("wordtide_n_dropped", "long")
    spots = [names.index(n) for n in kept_names]

    def run(batches):
        for batch in small(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, (hashes, drops) in zip(batch.column(at).to_pylist(), apply(batch), strict=True):
                out = [x not in drops or x is None for x in hashes] if drops else ()
                gone = len(hashes) - sum(out) if drops else 0
                if gone:
                    text = "\n".join(line for line, stays in zip(text.split("\n"), out, strict=True) if stays)
                texts.append(text)
                n_lines.append(len(hashes))
                n_dropped.append(gone)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in spots]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def _probed_in_place(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    bodies = {r["shard"]: bytes(r["body"]) for r in index.select("shard", "body").collect()}
    shards = max(1, (index.agg(F.max("shards")).first()[0] or 1))
    sent = docs.sparkSession.sparkContext.broadcast(bodies)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    opened: dict[int, LineIndex] = {}

    def apply(batch):
        if not opened:
            opened.update({k: LineIndex.opened(v) for k, v in sent.value.items()})
        ids = batch.column(id_at).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        lines = [line_hashes(x, min_chars) for x in batch.column(text_at).to_pylist()]
        flat = [x for row in lines for x in row if x is not None]
        row = np.repeat(np.arange(len(lines)), [sum(x is not None for x in r) for r in lines])
        high, low = halves(flat)
        owner, known = np.full(len(flat), -1, np.int64), np.zeros(len(flat), bool)
        shard = shard_of(high, shards)
        for k, one in opened.items():
            own = np.flatnonzero(shard == k)
            known[own] = one.known(high[own], low[own])
            owner[own] = one.owner(high[own], low[own])
        drops: list[set] = [set() for _ in lines]
        for i in np.flatnonzero(known & (owner != ids[row])):
            drops[row[i]].add(flat[i])
        return zip(lines, drops, strict=True)

    return _outcome(docs, text_col, apply)


def _probed_by_shard(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    spark = docs.sparkSession
    shards = index.agg(F.max("shards")).first()[0]
    n = shuffle_partitions(spark)
    # a shard whose keys stand in many lines is probed in as many tasks; all others have one copy of their arrays
    busy = index.where(F.col("load") > PROBES_A_TASK).select("shard", F.least(F.lit(n), F.ceil(F.col("load") / PROBES_A_TASK)).alias("salts"))
    hashed = line_rows(docs, id_col, text_col, min_chars).withColumn("shard", F.pmod(F.shiftrightunsigned("high", 8), F.lit(shards)))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0))
    probes = hashed.join(F.broadcast(busy), "shard", "left").select("shard", salt.alias("salt"), F.lit(None).cast("binary").alias("body"), "high", "low", "doc_id")  # one short row for each shard
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))
    arrays = index.join(F.broadcast(busy), "shard", "left").select("shard", copies.alias("salt"), "body", *(F.lit(None).cast("long").alias(c) for c in ("high", "low", "doc_id")))
    met = arrays.unionByName(probes).repartition(max(n, shards), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("body").isNull())

    def probe(batches):
        shard, one = None, None
        for batch in batches:
            at, bodies = batch.column(0).to_numpy(), batch.column(2)
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                while a < b and bodies[a].is_valid:
                    shard, one, a = at[a], LineIndex.opened(bodies[a].as_py()), a + 1
                if a >= b or shard != at[a]:
                    continue
                high, low, ids = (batch.column(c).slice(a, b - a).fill_null(0).to_numpy() for c in (3, 4, 5))
                h, w = high.view(np.uint64), low.view(np.uint64)
                gone = one.known(h, w) & (one.owner(h, w) != ids)
                if gone.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[gone]), pa.array([x.tobytes() for x in np.stack([h, w], 1)[gone]], pa.binary())], ["wordtide_key", "key"])

    drops = met.mapInArrow(probe, "wordtide_key long, key binary").groupBy("wordtide_key").agg(F.collect_list("key").alias("wordtide_drop"))
    keyed = docs.withColumn("wordtide_key", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).join(drops, "wordtide_key", "left")
    text_at, drop_at = keyed.columns.index(text_col), keyed.columns.index("wordtide_drop")

    def apply(batch):
        for text, drop in zip(batch.column(text_at).to_pylist(), batch.column(drop_at).to_pylist(), strict=True):
            yield line_hashes(text, min_chars), set(drop or ())

    return _outcome(keyed, text_col, apply)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``documents`` without repeated lines; the hash of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", F.col("wordtide_n_lines").alias("n_lines"), F.col("wordtide_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = MIN_CHARS) -> dict[int, tuple[int, int, str]]:
    """The same by plain loops, for tests: doc_id to (n_lines, n_dropped, hash)."""
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    holders: dict[str, set] = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(strip).translate(lower), set()).add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(strip).translate(lower)) < min_chars or len(holders[k]) < 2 or min(holders[k]) == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
held AS (SELECT key, min(doc_id) AS owner, count(DISTINCT doc_id) AS n FROM lines GROUP BY key),
marked AS (SELECT doc_id, i, line, length(key) >= 10 AND n >= 2 AND owner <> doc_id AS gone FROM lines JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
