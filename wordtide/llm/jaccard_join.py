"""Exact Jaccard join on word shingles, as a join in the Jaccard metric space.

Distance is 1 - |A n B| / |A u B|; two sets link at ``EPS`` = 1 - threshold or less.  Nearly
all pairs are at distance 1, where the triangle inequality says nothing, so the space is first
parted where the distance saturates and then joined by pivots:

1. *Sets.*  Documents of equal sets are one point; it is named by a hash of its set.
2. *Parts below distance 1.*  Of two linked sets of n and m shingles in one global order, the
   rarest first, each holds a common shingle among its first ``n - ceil(threshold * n) + 1``.
   A point goes to the part of each shingle in that window, so every link lies inside a part.
   The order comes from a count sketch of fixed size; any order is exact.  At the first
   shingle that two sets share, all others they share come later in both, so points without
   a partner of a size that what is left of them (``left``) allows leave the part.
3. *Cells.*  The pivot of a part is its point of the smallest hash, so the parts that one
   group of near copies opens agree on a pivot; the parts of one pivot make one cell.  In a
   cell of up to ``LEAF`` points, pairs of different classes are compared whose sizes,
   distances to the pivot (triangle inequality) and signatures (a lower bound of the distance)
   allow a link: the likeliest ones first, so that linked points are one class before the
   rest is looked at.
4. *Voronoi regions.*  The points of a larger cell are measured against its pivot.  If it still
   holds several classes, those points of the class around the pivot go that the triangle
   inequality keeps out of reach of all others; the rest is measured against sub-pivots, and
   each point goes to the region of its nearest one.  A point at distance d from its nearest
   pivot is also replicated to every region whose pivot is within d + 2 * EPS, so each link lies
   in the region of one of its ends.  The regions are cells again, without their pivots, which
   are done.  A cell whose windows would more than double it stays one flat region, which gives
   more pivots up each round, measured only where the filters let them link.

No pair is given up: the recursion ends when no cell holds two classes.  Words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; shingles are told by 64-bit hashes, of which a
comparison of two sets takes the upper 48, sets by 128 bits.

Defined results: a document of fewer words than a shingle is one shingle of all its words;
one without words (or null) has none and links with nothing; repeated rows of a doc_id are
joined by that id; a null doc_id is left out of the join and keeps a null component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .shared import Scanner, forget, kept_by_worker, met, release, shuffle_partitions, slices, stored, utf8

WORDS, THRESHOLD = 5, 75
#: 2**SKETCH_BITS counters order the shingles; the sketch is sent to all tasks and has one byte for each.
SKETCH_BITS = 24
#: 2**SIEVE_BITS bits tell which sets are asked for; a fixed size as well. Of an input that fills them, all sets are shuffled.
SIEVE_BITS = 22
#: Points of a cell that is not parted further, and of one that a first round of sub-pivots could not part: one task
#: filters their pairs.
LEAF, FLAT_LEAF = 256, 4096
#: Pairs of each point that a small cell compares in its first visits; the last one takes all that are left.
VISITS = (1, 8)
#: Bits of a signature; one of a set of more shingles has the next power of two.
BITS = 1024
#: Sub-pivots of a cell; of one that did not split, four times as many in each later round.
PIVOTS = 8
CHUNK = 1 << 18
#: Rows of one part that a task holds; those of a larger one pass through it.
HELD = 50_000
#: Pairs of one point that a task compares; those of a point with more are salted.
PAIRS = 4096
SIZES = (1 << 32) - 1


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers with all their first bytes together, then all their second bytes and so on: small ones pack well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """One pass: for each document its number of shingles and set hash, and for each task its part of the sketch."""

    def scan(batches):
        scanner = kept_by_worker(Scanner)
        parts: list[np.ndarray] = []
        codec = pa.Codec("zstd", 1)

        def flush():
            at, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            edges = np.searchsorted(at, np.arange(0, (1 << SKETCH_BITS) + 1, CHUNK))
            rows = [(i, codec.compress(planes(np.concatenate([np.diff(at[a:b], prepend=i * CHUNK), n[a:b] - 1])), asbytes=True), 2 * (b - a)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "n", "high", "low", "chunk", "body", "cells"])

        held = 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            sizes, marks = [], []
            for i, j in slices(offsets):
                for s in scanner.shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    sizes.append(len(s))
                    marks.append(xxhash.xxh3_128_digest(s.tobytes()))
                    parts.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
                    held += len(s)
                if held > 8_000_000:
                    yield flush()
                    held = 0
            both = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.int64())], ["doc_id", "n", "high", "low", "chunk", "body", "cells"])
        if held:
            yield flush()

    return docs.mapInArrow(scan, "doc_id long, n long, high long, low long, chunk int, body binary, cells long")


def sketch(parts: DataFrame) -> np.ndarray:
    """The logarithm of each counter's total, in eighths of a bit: one byte each, 2**SKETCH_BITS in all."""

    def merge(batches):
        codec, totals = pa.Codec("zstd", 1), {}
        for batch in batches:
            for chunk, body, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(codec.decompress(body, 4 * cells), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
                total = totals.setdefault(chunk, np.zeros(CHUNK, np.int64))
                total[np.cumsum(x[: cells // 2])] += x[cells // 2 :] + 1
        rows = [(c, np.minimum(8 * np.log2(t + 1.0), 255).astype(np.uint8).tobytes()) for c, t in totals.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "body"])

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in parts.repartition(min(64, shuffle_partitions(parts.sparkSession)), "chunk").mapInArrow(merge, "chunk int, body binary").collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["body"], np.uint8)
    return out


class Points:
    """Names of sets: the first half of their 128-bit hash, or the second where two sets of the input share the first."""

    def __init__(self, clashes: frozenset[int]) -> None:
        self.clashes = clashes

    def name(self, shingles: np.ndarray) -> int:
        high, low = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()
        return low if high in self.clashes else high

    def column(self):
        return F.when(F.col("high").isin(*self.clashes), F.col("low")).otherwise(F.col("high")) if self.clashes else F.col("high")


def part_entries(docs: DataFrame, counts: np.ndarray, points: Points, k: int, threshold: int) -> DataFrame:
    """part, point, sizes (n << 32 | left): each set in the parts of its window, n and the shingles from that one on.
    A set seen before in a task is not repeated."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def scan(batches):
        scanner, rank, seen = kept_by_worker(Scanner), sent.value, set()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                parts, names, sizes = [], [], []
                for s in scanner.shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    n = len(s)
                    if not n or (name := points.name(s)) in seen:
                        continue
                    seen.add(name)
                    window = n - (threshold * n + 99) // 100 + 1
                    order = rank[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(55) | s >> np.uint64(9)  # positive as int64: sorting keeps the order
                    order = np.partition(order, window - 1)[:window] if window < n else order
                    order.sort()
                    parts.append(order)
                    names.append(name)
                    sizes.append((n << 32) + np.arange(n, n - window, -1))
                if parts:
                    times = [len(r) for r in parts]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), times)), pa.array(np.concatenate(sizes))], ["part", "point", "sizes"])

    return docs.select("doc_id", "text").mapInArrow(scan, "part long, point long, sizes long")


def may_link(n: np.ndarray, m: np.ndarray, left: np.ndarray, left_m: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles, whose first common one has ``left`` and ``left_m`` from itself on, can link."""
    return (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & ((100 + threshold) * np.minimum(left, left_m) >= threshold * (n + m))


def signature(shingles: np.ndarray) -> bytes:
    """For each of ``BITS`` classes of shingles, whether the set holds an odd number of them. A larger set has twice as many
    classes or more, as a full signature tells nothing: class c of ``BITS`` is c + ``BITS``, c + 2 * ``BITS`` and so on together."""
    more = max(0, (len(shingles) - 1).bit_length() - BITS.bit_length() + 1)
    low = shingles >> np.uint64(65 - BITS.bit_length())
    high = (shingles >> np.uint64(65 - BITS.bit_length() - more)) & np.uint64((1 << more) - 1)
    odd = np.bincount((low + high * np.uint64(BITS)).astype(np.int64), minlength=BITS << more) & 1
    return np.packbits(odd.astype(bool)).tobytes()


class Signatures:
    """Signatures of rows; those of different lengths are compared in the classes of the shorter one."""

    def __init__(self, bits: pa.Array) -> None:
        self.rows = [np.frombuffer(b, np.uint64) for b in bits.to_pylist()]
        self.size = np.array([len(r) for r in self.rows], np.int64)
        self.at = np.arange(len(self.rows))
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def taken(self, at: np.ndarray) -> Signatures:
        """The rows ``at``, without a copy."""
        out = Signatures.__new__(Signatures)
        out.rows, out.size, out.folded, out.at = self.rows, self.size, self.folded, self.at[at]
        return out

    def of_size(self, k: np.ndarray, size: int) -> np.ndarray:
        """Rows ``k``, which have ``size`` numbers or more, in the classes of that size."""
        if size not in self.folded:
            wide = np.flatnonzero(self.size >= size)
            place = np.zeros(len(self.rows), np.int64)
            place[wide] = np.arange(len(wide))
            self.folded[size] = place, np.array([np.bitwise_xor.reduce(self.rows[i].reshape(-1, size), 0) for i in wide.tolist()], np.uint64).reshape(-1, size)
        place, matrix = self.folded[size]
        return matrix[place[self.at[k]]]

    def apart(self, other: Signatures, k: np.ndarray) -> np.ndarray:
        """How many bits of each row ``k`` differ from those of the other's."""
        out, sizes = np.zeros(len(k), np.int64), np.minimum(self.size[self.at[k]], other.size[other.at[k]])
        for size in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == size)
            step = max(1, 1_600_000 // size)
            for i in range(0, len(same), step):
                own = same[i : i + step]
                out[own] = np.bitwise_count(self.of_size(k[own], size) ^ other.of_size(k[own], size)).sum(1, dtype=np.int64)
        return out


def near_enough(x: list, y: list, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of points (n, left, class, distance, signature) of one cell may be links of two classes, and how many
    bits of their signatures differ: by ``may_link``, by the triangle inequality over the cell's pivot, and by the
    signatures, as two sets differ in as many shingles as these do in bits at least."""
    (n, left, kind, far, bits), (m, left_m, kind_m, far_m, bits_m) = x, y
    at = np.flatnonzero((kind != kind_m) & ~(np.abs(far - far_m) > 1 - threshold / 100 + 1e-9) & may_link(n, m, left, left_m, threshold))
    apart = bits.apart(bits_m, at)
    both = n[at] + m[at]
    ok = 100 * (both - apart) >= threshold * (both + apart)
    return at[ok], apart[ok]


def has_partner(part: np.ndarray, n: np.ndarray, left: np.ndarray, threshold: int) -> np.ndarray:
    """Of rows sorted by part and n, those that have another member of a size ``may_link`` allows."""
    if not len(part):
        return np.zeros(0, bool)
    at = np.cumsum(np.append(False, part[1:] != part[:-1]))
    span = int(n.max()) + 2
    key = at * span + n
    most = np.minimum((100 + threshold) * left // threshold - n, 100 * n // threshold)
    low = np.searchsorted(key, at * span + (threshold * n + 99) // 100)
    high = np.searchsorted(key, at * span + np.minimum(most, span - 1), "right")
    return high - low > (n <= most)


def first_cells(entries: DataFrame, threshold: int) -> DataFrame:
    """pivot, point, n, left, pivot_n, pivot_left: the points that share a part with each pivot, and the largest ``left``
    that either has in one."""
    dealt = entries.repartition(shuffle_partitions(entries.sparkSession), "part").sortWithinPartitions("part", "point")
    names = ["pivot", "point", "n", "left", "pivot_n", "pivot_left"]

    def gather(batches):
        held = [np.zeros(0, np.int64)] * 3
        wide = None  # a part of more rows than are held: its id, and its pivot's name and sizes
        ready: list[list[np.ndarray]] = []

        def merged():
            rows = [np.concatenate(x) for x in zip(*ready, strict=True)]
            ready.clear()
            order = np.lexsort((rows[1], rows[0]))
            pivot, point, n, left, pivot_n, pivot_left = (x[order] for x in rows)
            start = np.flatnonzero(np.append(True, (pivot[1:] != pivot[:-1]) | (point[1:] != point[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (pivot[start], point[start], n[start], np.maximum.reduceat(left, start), pivot_n[start], np.maximum.reduceat(pivot_left, start))], names)

        def put(part, point, sizes, whole):
            nonlocal wide
            fresh = np.append(True, (part[1:] != part[:-1]) | (point[1:] != point[:-1]))
            part, point, n, left = part[fresh], point[fresh], sizes[fresh] >> 32, sizes[fresh] & SIZES
            goes_on = wide is not None and part[0] == wide[0]
            if whole:
                by_size = np.lexsort((n, part))
                stay = np.empty(len(part), bool)
                stay[by_size] = has_partner(part[by_size], n[by_size], left[by_size], threshold)
                if goes_on:
                    stay |= part == wide[0]
                part, point, n, left = (x[stay] for x in (part, point, n, left))
                if not len(part):
                    return
            start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            size = np.diff(start, append=len(part))
            lead = [x[start] for x in (point, n, left)]
            if goes_on:
                for x, y in zip(lead, wide[1:], strict=True):
                    x[0] = y
            elif not whole:
                wide = (part[0], point[0], n[0], left[0])
            pivot, pivot_n, pivot_left = (np.repeat(x, size) for x in lead)
            other = point != pivot
            if other.any():
                ready.append([x[other] for x in (pivot, point, n, left, pivot_n, pivot_left)])

        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, range(3), strict=True)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                put(*(x[:cut] for x in held), True)
                held = [x[cut:] for x in held]
            if len(held[0]) > HELD:
                put(*held, False)
                held = [x[:0] for x in held]
            if sum(len(x[0]) for x in ready) > 200_000:
                yield merged()
        if len(held[0]):
            put(*held, True)
        if ready:
            yield merged()

    found = dealt.mapInArrow(gather, "pivot long, point long, n long, left long, pivot_n long, pivot_left long")
    return found.groupBy("pivot", "point").agg(*(F.max(c).alias(c) for c in names[2:]))


def sieve(keys: DataFrame, key: str) -> np.ndarray:
    """Bits of the hashes of ``key``: the driver gets 2**SIEVE_BITS numbers at most."""
    out = np.zeros(1 << SIEVE_BITS, bool)
    out[keys.select(sieve_bit(key).alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)] = True
    return np.packbits(out)


def sieve_bit(key: str):
    return F.shiftrightunsigned(F.xxhash64(key), 64 - SIEVE_BITS).cast("int")


def shingle_sets(docs: DataFrame, wanted: DataFrame, points: Points, k: int) -> DataFrame:
    """point, body, bits (signature): the sets of the documents that ``wanted`` (doc_id) names; a few others that the sieve lets pass do no
    harm. A set is the upper 48 bits of its hashes, sorted: their differences, all lowest bytes first, then the next ones;
    the highest are mostly 0 and pack well."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve(wanted, "doc_id"))

    def scan(batches):
        scanner, some = kept_by_worker(Scanner), np.unpackbits(sent.value).view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(some[batch.column(2).to_numpy()]))
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                names, bodies, bits = [], [], []
                for s in scanner.shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    names.append(points.name(s))
                    bodies.append(np.diff(s >> np.uint64(16), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes())
                    bits.append(signature(s))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary()), pa.array(bits, pa.binary())], ["point", "body", "bits"])

    return docs.withColumn("at", sieve_bit("doc_id")).select("doc_id", "text", "at").mapInArrow(scan, "point long, body binary, bits binary")


def asked(sets: DataFrame, names: DataFrame) -> DataFrame:
    """point, body of the points that ``names`` (point) names, once each, and of a few others: most are left out before the shuffle."""
    sent = sets.sparkSession.sparkContext.broadcast(sieve(names, "point"))

    def scan(batches):
        some = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(some[batch.column(2).to_numpy()])).select([0, 1])

    return sets.select("point", "body").withColumn("at", sieve_bit("point")).mapInArrow(scan, "point long, body binary").dropDuplicates(["point"])


def opened(body: pa.Scalar) -> np.ndarray:
    packed = np.frombuffer(body.as_buffer(), np.uint8).reshape(6, -1).T
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :6] = packed
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def compared(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Size of the intersection and of the union of each pair of sets, of 65536 pairs at most: one sort for all."""
    sides = [[opened(s) for s in column] for column in (x, y)]
    sizes = np.array([len(a) + len(b) for a, b in zip(*sides, strict=True)], np.int64)
    values = np.concatenate([v for pair in zip(*sides, strict=True) for v in pair])
    values |= np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(48), sizes)
    values.sort()
    twice = values[1:][values[1:] == values[:-1]] >> np.uint64(48)
    common = np.bincount(twice.astype(np.int64), minlength=len(sizes))
    return common, sizes - common


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b, distance, linked of every pair of the stored table ``pairs`` (a, b). Stored."""

    def compare(batches):
        for batch in batches:
            offsets = np.append(0, np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy().astype(np.int64)))
            for i, j in slices(offsets, 4_000_000):
                part = batch.slice(i, j - i)
                common, union = compared(part.column(2), part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(1 - common / union), pa.array(100 * common >= threshold * union)], ["a", "b", "distance", "linked"])

    total = pairs.count()
    others = asked(sets, pairs.select(F.col("b").alias("point"))).withColumnsRenamed({"point": "b", "body": "y"})
    leads = asked(sets, pairs.select(F.col("a").alias("point"))).withColumnsRenamed({"point": "a", "body": "x"})
    if total <= 4 * PAIRS:
        return stored(pairs.join(others, "b").join(leads, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, distance double, linked boolean"))
    busy = pairs.groupBy("a").count().where(F.col("count") >= max(PAIRS, total // 1000)).select("a", F.ceil(F.col("count") / PAIRS).alias("salts"))  # a thousand at most
    salted = pairs.join(F.broadcast(busy), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "salts"), F.lit(0)).alias("salt"))
    leads = leads.join(F.broadcast(busy), "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return stored(salted.join(others, "b").join(leads, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, distance double, linked boolean"))


#: A row of a cell: ``distance`` is that of the point to the pivot, null before it is measured; ``flat``: sub-pivots did not
#: part the cell; ``visit`` counts the rounds.
CELL = {"cell": "long", "pivot": "long", "point": "long", "n": "long", "left": "long", "bits": "binary", "distance": "double", "flat": "boolean", "visit": "int"}
ROW = ", ".join(f"{k} {v}" for k, v in CELL.items())
TOLD_BY = ["n", "left", "class", "distance", "bits"]


def labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the class of ``point``."""
    return rows.join(groups.select(F.col("node").alias("point"), F.col("component").alias("class")), "point", "left").withColumn("class", F.coalesce("class", "point"))


def cell_pairs(told: list, visit: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of one cell that may be links of two classes; in the first visits only the likeliest ``VISITS``
    of each point, as the links among these leave fewer classes for the last visit, which takes all."""
    size, found = len(told[0]), []
    step = max(1, 500_000 // size)
    for first in range(0, size, step):
        x, y = np.nonzero(np.arange(first, min(first + step, size))[:, None] < np.arange(size)[None])
        x += first
        ok, apart = near_enough([v[x] for v in told[:-1]] + [told[-1].taken(x)], [v[y] for v in told[:-1]] + [told[-1].taken(y)], threshold)
        if visit < len(VISITS) and len(ok):
            ok = ok[np.lexsort((apart, x[ok]))]
            start = np.flatnonzero(np.append(True, x[ok][1:] != x[ok][:-1]))
            ok = ok[np.arange(len(ok)) - np.repeat(start, np.diff(start, append=len(ok))) < VISITS[visit]]
        found.append((x[ok], y[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def visited(rows: DataFrame, threshold: int) -> DataFrame:
    """What one visit of the cells in ``rows`` (``CELL`` and class) gives: pairs (a, b) to compare, rows of small open cells
    to visit again and, marked ``wide``, the rows of cells of more points than one task holds."""
    names = [*CELL, "class"]
    dealt = rows.select(*names).repartition(shuffle_partitions(rows.sparkSession), "cell").sortWithinPartitions("cell", "point")

    def visit_cells(batches):
        held, passing = None, None  # rows of the last cell; the wide cell whose rows go on

        def rows_out(table, wide):
            n = len(table)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(table.column(c).combine_chunks() for c in names), pa.array(np.full(n, wide))], ["a", "b", *names, "wide"])

        def small_cell(table):
            kind = table.column("class").to_numpy()
            if (kind == kind[0]).all():
                return
            told = [*(table.column(c).to_numpy() for c in TOLD_BY[:-1]), Signatures(table.column("bits"))]
            point, visit = table.column("point").to_numpy(), table.column("visit")[0].as_py()
            x, y = cell_pairs(told, visit, threshold)
            if not len(x):
                return
            nothing = [pa.nulls(len(x), t) for t in table.schema.types]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(point[x], point[y])), pa.array(np.maximum(point[x], point[y])), *nothing, pa.array(np.zeros(len(x), bool))], ["a", "b", *names, "wide"])
            if visit < len(VISITS):
                at = names.index("visit")
                yield rows_out(table.set_column(at, "visit", pa.array(np.full(len(table), visit + 1, np.int32))), False)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cell = held.column("cell").to_numpy()
            edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist() if len(cell) else [0]
            for s, e in zip(edges, edges[1:], strict=False):
                part = held.slice(s, e - s)
                if passing == cell[s] or e - s > (FLAT_LEAF if part.column("flat")[0].as_py() else LEAF):
                    yield rows_out(part, True)
                else:
                    yield from small_cell(part)
            held = held.slice(edges[-1])
            if len(held) and (passing == cell[-1] or len(held) > (FLAT_LEAF if held.column("flat")[0].as_py() else LEAF)):
                passing = cell[-1]
                yield rows_out(held, True)
                held = held.slice(len(held))
        if held is not None and len(held):
            yield from [rows_out(held, True)] if passing == held.column("cell")[0].as_py() else small_cell(held)

    return dealt.mapInArrow(visit_cells, f"a long, b long, {ROW}, class long, wide boolean")


def pivot_pairs(met_subs: DataFrame, threshold: int) -> DataFrame:
    """a, b: of the rows of ``against_pivots`` those of sub-pivots and points that may be links of two classes."""

    def pair(batches):
        for batch in batches:
            sides = [[*(batch.column(2 + 5 * i + k).to_numpy() for k in range(4)), Signatures(batch.column(6 + 5 * i))] for i in (0, 1)]
            ok = pa.array(near_enough(*sides, threshold)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok)], ["a", "b"])

    return met_subs.select("sub", "point", *TOLD_BY, *(f"sub_{c}" for c in TOLD_BY)).mapInArrow(pair, "a long, b long")


def against_pivots(rows: DataFrame, pivots: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every row of ``rows`` with each of its cell's ``pivots`` (cell, sub, …); the rows of a very wide cell are salted."""
    salts = stored(sizes.where(F.col("size") > HELD).select("cell", "size", F.ceil(F.col("size") / HELD).alias("salts")))
    if salts.isEmpty():
        return rows.join(pivots, "cell")
    salted = met(rows, salts, "cell", how="left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("point"), "salts"), F.lit(0))).drop("size", "salts")
    copies = pivots.join(salts, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("size", "salts")
    return salted.join(copies, ["cell", "salt"]).drop("salt")


def voronoi(measured: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """The regions of the sub-pivots as cells, from ``measured``, every point of a cell (``CELL``; ``distance`` to ``sub``) with
    each sub-pivot: each point is in the region of its nearest one and in those that its window reaches."""
    eps = 1 - threshold / 100 + 1e-9
    own = W.partitionBy("cell", "point")
    near = measured.withColumn("nearest", F.min("distance").over(own)).withColumn("first", F.min("sub").over(own))
    near = stored(near.withColumn("inside", F.col("distance") <= F.col("nearest") + 2 * eps))
    split = near.groupBy("cell").agg(F.count_if("inside").alias("rows"), F.count(F.lit(1)).alias("size"), F.count_if(F.col("sub") == F.col("first")).alias("points"))
    split = stored(split.select("cell", "size", (F.col("rows") <= 2 * F.col("points")).alias("split")))
    out = met(near, split, "cell").where(F.when(F.col("split"), F.col("inside")).otherwise(F.col("sub") == F.col("first")))
    return out.withColumn("cell", F.xxhash64("cell", "sub")).withColumn("pivot", F.col("sub")).withColumn("flat", ~F.col("split")).select(*CELL)


def linked_points(cells: DataFrame, links: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """node, component of all points that a link or ``links`` (a, b) touches; see the module for the steps."""
    spark, eps = cells.sparkSession, 1 - threshold / 100 + 1e-9
    groups, done = components(links), None

    def measure(pairs):
        """Distances of the pairs (a, b), a < b, not measured before; their links join classes."""
        nonlocal groups, done
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs)
        if done is not None and pairs.isEmpty():
            return
        new = verified(pairs, sets, threshold)
        forget(pairs)
        done = new if done is None else stored(done.union(new))
        found = new.where("linked").select("a", "b")
        if not found.isEmpty():
            groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
        release(spark)

    def ordered(one, two):
        return F.least(one, two).alias("a"), F.greatest(one, two).alias("b")

    def told(rows, pivot):
        """``rows`` with the measured distance of ``point`` to ``pivot``."""
        low, high = ordered(pivot, "point")
        far = done.select(F.col("a").alias("low"), F.col("b").alias("high"), F.col("distance"))
        return rows.drop("distance").withColumn("low", low).withColumn("high", high).join(far, ["low", "high"])

    members = cells.select("pivot", "point", "n", "left").unionByName(cells.groupBy("pivot").agg(F.max("pivot_n").alias("n"), F.max("pivot_left").alias("left")).select("pivot", F.col("pivot").alias("point"), "n", "left"))
    marks = sets.select("point", "bits").dropDuplicates(["point"])
    now = members.join(marks, "point").select(F.col("pivot").alias("cell"), "pivot", "point", "n", "left", "bits", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("flat"), F.lit(0).alias("visit"))
    while True:
        step = stored(visited(labelled(now, groups), threshold))
        pairs = step.where("a IS NOT NULL").select("a", "b")
        again = step.where("a IS NULL AND NOT wide").select(*CELL)
        wide = step.where("wide")
        if wide.isEmpty():
            if pairs.isEmpty():
                return groups
            measure(pairs)
            now = again
            continue
        first = wide.where("visit = 0 AND point != pivot")  # against the cell's own pivot
        state = wide.where("visit > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("low"), F.max("class").alias("top"), F.min_by("class", "distance").alias("home"))
        state = stored(state.where("low != top").select("cell", "size", "home"))
        later = stored(met(wide.where("visit > 0"), state, "cell").drop("size").withColumn("outside", F.col("class") != F.col("home")))
        reach = stored(later.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("outside"), F.col("distance"))).alias("least")))
        large = stored(met(later, reach, "cell").where(F.col("outside") | (F.col("distance") >= F.col("least") - eps)).select(*CELL, "class", "outside"))
        sizes = stored(large.groupBy("cell").agg(F.count(F.lit(1)).alias("size")))
        # a flat cell gets four times the pivots in each of its own rounds; row_number under a constant is cut before the shuffle
        rounds = large.where("flat").agg(F.max("visit")).first()[0] or 1
        place, own = F.row_number().over(W.partitionBy("cell").orderBy(F.desc("outside"), F.xxhash64("point"))), PIVOTS * F.pow(4, "visit").cast("long")
        drawn = [large.where("NOT flat").withColumn("place", place).where(F.col("place") <= PIVOTS), large.where("flat").withColumn("place", place).where(F.col("place") <= PIVOTS * 4**rounds).where(F.col("place") <= own)]
        subs = drawn[0].unionByName(drawn[1])
        subs = stored(subs.select("cell", F.col("point").alias("sub"), *(F.col(c).alias(f"sub_{c}") for c in TOLD_BY)))
        rest = large.join(subs.select("cell", F.col("sub").alias("point")), ["cell", "point"], "left_anti")
        parted = stored(against_pivots(large.where("NOT flat"), subs.select("cell", "sub"), sizes))
        flat = pivot_pairs(against_pivots(large.where("flat"), subs, sizes).where("sub != point"), threshold)
        measure(pairs.union(first.select(*ordered("pivot", "point"))).union(flat.select(*ordered("a", "b"))).union(parted.where("sub != point").select(*ordered("sub", "point"))))
        starred = told(first, "pivot").withColumn("visit", F.lit(1)).select(*CELL)
        regions = voronoi(told(parted.join(rest.select("cell", "point"), ["cell", "point"], "left_semi"), "sub"), sizes, threshold)
        now = stored(again.unionByName(starred).unionByName(regions).unionByName(rest.where("flat").withColumn("visit", F.col("visit") + 1).select(*CELL)))
        forget(step)


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of ``docs``."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = given.where("doc_id IS NOT NULL")
    seen = stored(summaries(given, words))
    counts = sketch(seen.where("chunk IS NOT NULL").select("chunk", "body", "cells"))
    rows = seen.where("chunk IS NULL").select("doc_id", "n", "high", "low")
    sized = rows.where("n > 0 AND doc_id IS NOT NULL")
    by_half = sized.groupBy("high").agg(F.min("low").alias("x"), F.max("low").alias("y")).where("x != y")
    points = Points(frozenset(r["high"] for r in by_half.select("high").collect()))  # two of 2**32 sets or so
    sized = sized.select("doc_id", points.column().alias("point"))
    classes = stored(sized.groupBy("point").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least")))

    cells = stored(first_cells(part_entries(named, counts, points, words, threshold), threshold))
    release(spark)
    held = cells.select("point").union(cells.select("pivot")).distinct()
    sets = stored(shingle_sets(named, classes.join(held, "point", "left_semi").select(F.col("least").alias("doc_id")), points, words))
    repeated = sized.groupBy("doc_id").agg(F.min("point").alias("a"), F.max("point").alias("z")).where("a != z")
    links = sized.join(repeated, "doc_id").select("a", F.col("point").alias("b")).where("a != b")
    groups = linked_points(cells, links, sets, threshold)

    joined = groups.join(classes, F.col("node") == F.col("point")).select("point", "size", "least", "component")
    roots = stored(joined.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("least").alias("root")))
    linked = met(groups.withColumnRenamed("node", "point"), roots, "component").select("point", "root")
    label = stored(classes.join(linked, "point", "left").where("size > 1 OR root IS NOT NULL").select("point", "size", F.coalesce("root", "least").alias("root")))
    counted = rows.select("doc_id", "n", points.column().alias("point"))
    out = met(counted, label, "point", how="left")
    root = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents`` at five words and a similarity of 0.75."""
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
r AS (SELECT s.* FROM s JOIN rare USING (sh)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r AS a JOIN r AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT b, root FROM reach JOIN both_ways ON a = node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) AS c ON c.node = w.doc_id
"""
