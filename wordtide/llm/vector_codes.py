"""Product codes of vectors by filtering Lloyd.

Each vector is cut into equal consecutive parts, and each part is coded by the nearest entry of
its position's codebook.  The codebooks are trained by Lloyd's rounds over all vectors in whole
numbers (components are ``floor(scale * x)``), so that the outcome doesn't depend on how
rows are dealt to tasks.

Before the first round every partition puts its vectors into blocks of bounded size and builds a
kd-tree over each part of a block, with the bounding box, sum and count of every node; the trees are
written once.  A round filters each tree against the codebook: going down level by level, an entry leaves
a node's candidates when no corner of the node's box can be nearer to it than to the candidate nearest
to the box's middle; a node with one candidate left is assigned whole, by its cached sum and count.
Only points of leaves with several candidates are measured.  Tasks return sums and counts by
entry, which Spark adds up; the driver holds the codebooks alone.

Defined results: rows whose vector is null or holds a null, NaN or infinite component go.
Shorter vectors count as padded with zeros up to the longest one, and that to a multiple of the number
of parts.  Repeated rows are coded each; of equal ids the smaller vector comes first, null ids come
last.  With fewer vectors than entries the codebook is as short; an empty table gives an empty result.
Scaled components beyond ``most_component`` raise an error, as their distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import met, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components of a block's vectors, and points of a leaf at most.
BLOCK_COMPONENTS = 1 << 17
LEAF = 16


def most_component(width: int) -> int:
    """The bound under which sums of squared differences of doubled vectors fit 64 bits, and components 32."""
    return min(math.isqrt((1 << 62) // width) // 4, 1 << 30)


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    scaled, most = np.floor(vectors * scale), most_component(vectors.shape[1])
    if np.abs(scaled).max(initial=0) > most:
        raise ValueError(f"a component times {scale} is beyond {most}")
    return scaled.astype(np.int64)


# ------------------------------------------------------------------ trees


def depth_of(n: int) -> int:
    """Levels below the root, so that leaves hold ``LEAF`` points at most and one at least."""
    return max(0, (max(1, -(-n // LEAF)) - 1).bit_length()) if n > LEAF else 0


def bounds(n: int, level: int) -> np.ndarray:
    """First points of a level's nodes, and n."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def build_tree(points: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The points' order, and for each level the nodes' lower corners, upper corners and sums."""
    n = len(points)
    order, levels, depth = np.arange(n), [], depth_of(n)
    for level in range(depth + 1):
        first, now = bounds(n, level)[:-1], points[order]
        low, high = np.minimum.reduceat(now, first), np.maximum.reduceat(now, first)
        levels.append((low, high, np.add.reduceat(now, first)))
        if level < depth:
            node = np.repeat(np.arange(1 << level), np.diff(bounds(n, level)))
            widest = (high - low).argmax(1)
            order = order[np.lexsort((now[np.arange(n), widest[node]], node))]
    return order, levels


def nearest(points: np.ndarray, book: np.ndarray, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry; ties to the lower index."""
    far = ((points[:, None, :] - book[None]) ** 2).sum(2)
    if may is not None:
        far = np.where(may, far, np.iinfo(np.int64).max)
    at = far.argmin(1)
    return at, far[np.arange(len(at)), at]


def filtered(points: np.ndarray, levels, book: np.ndarray, sums: np.ndarray | None = None, counts: np.ndarray | None = None, labels: np.ndarray | None = None) -> int:
    """Assigns all points (in tree order); adds to sums and counts, or sets labels.  Returns how many were assigned by whole subtrees."""
    n, k, apart = len(points), len(book), 0
    nodes, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level, (low, high, total) in enumerate(levels):
        first = bounds(n, level)
        lo, hi = low[nodes], high[nodes]
        best, _ = nearest(lo + hi, 2 * book, may)
        star = book[best][:, None, :]
        corner = np.where(book[None] > star, hi[:, None, :], lo[:, None, :])  # the corner furthest towards each entry
        gap = ((corner - book[None]) ** 2).sum(2) - ((corner - star) ** 2).sum(2)
        may = may & ((gap < 0) | (gap == 0) & (np.arange(k) < best[:, None]))
        may[np.arange(len(best)), best] = True
        one = may.sum(1) == 1
        done, entry = nodes[one], best[one]
        apart += int((first[done + 1] - first[done]).sum())
        if labels is not None:
            for a, b, e in zip(first[done].tolist(), first[done + 1].tolist(), entry.tolist(), strict=True):
                labels[a:b] = e
        else:
            np.add.at(sums, entry, total[done])
            np.add.at(counts, entry, first[done + 1] - first[done])
        nodes, may = nodes[~one], may[~one]
        if len(nodes) == 0:
            return apart
        if level + 1 < len(levels):
            nodes, may = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(may, 2, 0)
    sizes = first[nodes + 1] - first[nodes]
    rows = np.repeat(first[nodes] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    at, _ = nearest(points[rows], book, np.repeat(may, sizes, 0))
    if labels is not None:
        labels[rows] = at
    else:
        np.add.at(sums, at, points[rows])
        np.add.at(counts, at, 1)
    return apart


# ------------------------------------------------------------------ jobs


def kept_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and vector of the rows whose vector is whole."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("vector")).where(F.col("vector").isNotNull() & ~odd)


def blocks(rows: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """One row for each block of a partition's vectors: ids and labels, each part's points in tree order, their places and the trees' nodes."""
    most = max(1, BLOCK_COMPONENTS // max(1, width))
    names = ["ids", "labels", "points", "places", "nodes"]

    def made(held):
        ids, labels, vectors = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), [v for h in held for v in h[2]]
        whole_ = np.zeros((len(vectors), width), np.float64)
        for row, v in zip(whole_, vectors, strict=True):
            row[: len(v)] = v
        cut = whole(whole_, scale).reshape(len(vectors), parts, -1)
        points, places, nodes = [], [], []
        for p in range(parts):
            order, levels = build_tree(cut[:, p])
            points.append(cut[order, p].astype("<i4").tobytes())
            places.append(order.astype("<i4").tobytes())
            nodes.append(b"".join(low.astype("<i4").tobytes() + high.astype("<i4").tobytes() + total.astype("<i8").tobytes() for low, high, total in levels))
        one = pa.array([0, len(vectors)], pa.int32())
        lists = [pa.ListArray.from_arrays(one, x) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.list_(pa.binary())) for x in (points, places, nodes))], names)

    def build(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                piece = batch.slice(at, most - n)
                held.append((piece.column(0), piece.column(1), [np.asarray(v.values, np.float64) for v in piece.column(2)]))
                at, n = at + len(piece), n + len(piece)
                if n == most:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    return rows.mapInArrow(build, "ids array<long>, labels array<string>, points array<binary>, places array<binary>, nodes array<binary>")


def unpacked(points: bytes, nodes: bytes, width: int):
    """Points and levels of one part's tree."""
    n = len(points) // (4 * width) if width else 0
    levels, at = [], 0
    for level in range(depth_of(n) + 1):
        size = width << level
        low, high = (np.frombuffer(nodes, "<i4", size, at + i * 4 * size).reshape(-1, width).astype(np.int64) for i in (0, 1))
        levels.append((low, high, np.frombuffer(nodes, "<i8", size, at + 8 * size).reshape(-1, width)))
        at += 16 * size
    return np.frombuffer(points, "<i4").reshape(-1, width).astype(np.int64), levels


class Codebooks:
    """Entries of every part, as whole numbers [part, entry, component]."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def after_round(self, trees: DataFrame) -> Codebooks:
        """One round of Lloyd over all blocks."""
        book = self.entries
        parts, k, width = book.shape

        def count(batches):
            sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
            for batch in batches:
                for i in range(len(batch)):
                    for p in range(parts):
                        points, levels = unpacked(batch.column(0)[i].values[p].as_py(), batch.column(1)[i].values[p].as_py(), width)
                        filtered(points, levels, book[p], sums[p], counts[p])
            at = np.flatnonzero(counts.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts.ravel()[at]), pa.array(list(sums.reshape(-1, width)[at]), pa.list_(pa.int64()))], ["at", "n", "sums"])

        found = trees.select("points", "nodes").mapInArrow(count, "at int, n long, sums array<long>")
        added = found.select("at", "n", F.posexplode("sums").alias("i", "s")).groupBy("at", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        new = book.reshape(-1, width).copy()
        for r in added.collect():  # as many rows as the codebooks have components, at most
            new[r["at"], r["i"]] = r["s"] // r["n"]
        return Codebooks(new.reshape(book.shape))


def first_codebooks(rows: DataFrame, width: int, parts: int, entries: int, scale: int) -> Codebooks:
    ordered = rows.withColumn("filled", F.transform("vector", lambda x: F.floor(x * scale))).orderBy(F.col("id").asc_nulls_last(), "filled").limit(entries)
    start = np.zeros((0, width))
    for r in ordered.select("vector").collect():
        start = np.vstack([start, np.pad(np.array(r["vector"], np.float64), (0, width - len(r["vector"])))])
    return Codebooks(whole(start, scale).reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy())


def coded(trees: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code and error of every vector."""
    book = books.entries
    parts, k, width = book.shape

    def code(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids, labels, points, places, nodes = (batch.column(c)[i].values for c in range(5))
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p in range(parts):
                    own, levels = unpacked(points[p].as_py(), nodes[p].as_py(), width)
                    label, place = np.zeros(len(own), np.int64), np.frombuffer(places[p].as_py(), "<i4")
                    filtered(own, levels, book[p], labels=label)
                    codes[place, p] = label
                    error[place] += ((own - book[p][label]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return trees.mapInArrow(code, "id long, label string, code string, error long")


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """id, label, code and error of every whole vector, and the codebooks after all rounds."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes two hexadecimal digits")
    rows = kept_rows(vectors, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    books = first_codebooks(rows, width, parts, entries, scale)
    trees = stored(blocks(rows, width, parts, scale))
    for _ in range(rounds):
        books = books.after_round(trees)
    return coded(trees, books), books


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all whole ``embeddings``: 8 parts of 16 entries, 6 rounds; errors, also summed over equal labels."""
    out, books = product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    rows = stored(out.select(F.col("id").alias("vec_id"), "code", "error", key.alias("key")))
    totals = stored(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size")))
    return met(rows, totals, "key").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    def nearest_of(book: str) -> str:
        return f"""SELECT p.r, p.part, p.v, arg_min(b.e, (list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))), b.e)) AS e
  FROM parts p JOIN {book} b USING (part) GROUP BY p.r, p.part, p.v"""

    rounds, book = [], "book0"
    for n in range(1, ROUNDS + 1):
        rounds.append(f"""near{n} AS MATERIALIZED ({nearest_of(book)}),
sums{n} AS (SELECT part, e, i, sum(x) AS s, count(*) AS c FROM (SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{n}) GROUP BY part, e, i),
new{n} AS (SELECT part, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS v FROM sums{n} GROUP BY part, e),
book{n} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.v, b.v) AS v FROM {book} b LEFT JOIN new{n} n USING (part, e))""")
        book = f"book{n}"
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
given AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, len(v) // {PARTS} AS width FROM kept),
parts AS MATERIALIZED (SELECT r, vec_id, label, part, v[part * width + 1 : (part + 1) * width] AS v FROM given, range({PARTS}) t(part)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES}),
{", ".join(rounds)},
last AS MATERIALIZED (SELECT n.r, n.part, n.e, list_sum(list_transform(range(1, len(n.v) + 1), lambda i: (n.v[i] - b.v[i]) * (n.v[i] - b.v[i]))) AS d FROM ({nearest_of(book)}) n JOIN {book} b USING (part, e)),
coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM {book}) AS codebooks_sha256
FROM given JOIN coded USING (r)
"""


OP12_SQL = _sql()
