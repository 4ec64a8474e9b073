"""Toxicity by a linear-chain conditional random field over words.

Tags are 0 (clean) and 1 (toxic).  A word's features are hashes of the word and of its
prefixes, so inflected and unseen forms of a known stem count; a chain of tags joins
neighbours.  Forward-backward marginals give each word's probability; a document's score is
the chance that any of its suspicious words is toxic, and words of probability 0.5 or more
are its offending spans.

Labels mark documents, so token labels come first: in toxic training documents, the words
whose features have far more contexts in toxic than in other training documents, and near
the strongest evidence in that document, are tagged 1; all other words are 0.  The field is then
fitted on these tagged sequences by AdaGrad on the driver, on a sample bounded by
``SAMPLE`` documents of either label and ``SAMPLE_TOKENS`` words a document.  Scoring
covers every document and whole texts, each document in one task pass; forward and backward
run as blocked products of 2 x 2 matrices over many documents at once.

Defined results: null or empty texts and texts without words score 0; a document of any
length is scored whole; without any toxic label all scores are near 0; repeated rows score
alike; rows with a null doc_id are scored; labels with a null flag are ignored; an empty
table gives an empty result; labels, language, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scanner, mixed, slices, utf8

#: Training documents of either label, and their longest in words.
SAMPLE, SAMPLE_TOKENS = 1500, 3000
BITS = 20
PREFIXES = (4, 5, 6)
BLOCK = 64
CUT = 0.7
#: Words of training documents whose marginals the driver holds at once.
FIT_WORDS = 100_000
#: Words from this probability on count towards a document's chance of holding a toxic one.
SUSPICIOUS = 0.2
#: All ASCII bytes that are neither letters nor digits part words here.
SEPARATORS = [i for i in range(128) if not chr(i).isalnum()]


def token_features(scanner: Scanner, data: np.ndarray, offsets: np.ndarray):
    """Features (words x kinds), row, start and end of every word."""
    h, row, start, end = scanner.words(data, offsets)
    out = np.empty((len(h), 1 + len(PREFIXES)), np.uint32)
    out[:, 0] = h >> np.uint64(64 - BITS)
    for k, size in enumerate(PREFIXES, 1):
        stop = np.minimum(start + size, end)
        piece = mixed((scanner.sums[stop] - scanner.sums[start]) * scanner.inverse[start] + np.uint64(k)) if len(h) else h
        out[:, k] = piece >> np.uint64(64 - BITS)
    return out, row, start, end


def forward_backward(odds: np.ndarray, first: np.ndarray, step: np.ndarray, init: np.ndarray):
    """Forward and backward vectors (words x 2, each scaled) of many chains laid end to end.

    odds: weight of tag 1 against tag 0 by word; first: True where a chain starts; step: 2 x 2
    weights of neighbouring tags; init: weights of a chain's first tag.
    """
    n = len(odds)
    blocks = -(-n // BLOCK)
    m = np.zeros((2, 2, blocks * BLOCK))
    for a in (0, 1):
        m[a, 0, :n] = np.where(first, init[0], step[a, 0])
        m[a, 1, :n] = np.where(first, init[1], step[a, 1]) * odds
        m[a, a, n:] = 1
    m = np.ascontiguousarray(m.reshape(2, 2, blocks, BLOCK).transpose(3, 0, 1, 2))  # steps first
    p = np.zeros((2, 2, blocks))
    p[0, 0] = p[1, 1] = 1
    for j in range(BLOCK):
        p = np.stack([p[:, 0] * m[j, 0, b] + p[:, 1] * m[j, 1, b] for b in (0, 1)], 1)
        p /= p.max((0, 1))
    into, onto = np.empty((blocks, 2)), np.empty((blocks, 2))
    x, y = 0.5, 0.5
    for i, (p00, p01, p10, p11) in enumerate(zip(*(p[a, b].tolist() for a in (0, 1) for b in (0, 1)), strict=True)):
        into[i] = x, y
        x, y = x * p00 + y * p10, x * p01 + y * p11
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for i in range(blocks - 1, -1, -1):
        onto[i] = x, y
        x, y = p[0, 0, i] * x + p[0, 1, i] * y, p[1, 0, i] * x + p[1, 1, i] * y
        x, y = x / (x + y), y / (x + y)
    ahead, back = np.empty((BLOCK, 2, blocks)), np.empty((BLOCK, 2, blocks))
    a, b = into.T.copy(), onto.T.copy()
    for j in range(BLOCK):
        a = np.stack([a[0] * m[j, 0, k] + a[1] * m[j, 1, k] for k in (0, 1)])
        a /= a.sum(0)
        ahead[j] = a
        i = BLOCK - 1 - j
        back[i] = b
        b = np.stack([m[i, k, 0] * b[0] + m[i, k, 1] * b[1] for k in (0, 1)])
        b /= b.sum(0)
    flat = lambda z: z.transpose(2, 0, 1).reshape(-1, 2)[:n]
    return flat(ahead), flat(back)


class Field:
    """Weights of the features and of neighbouring tags."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << BITS)
        self.bias = -6.0
        self.step = np.zeros((2, 2))
        self.init = np.zeros(2)

    def odds(self, features: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weights[features].sum(1) + self.bias, -30, 30))

    def marginals(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.zeros(0)
        ahead, back = forward_backward(self.odds(features), first, np.exp(self.step), np.exp(self.init))
        both = ahead * back
        return both[:, 1] / both.sum(1)

    def fit(self, features: np.ndarray, first: np.ndarray, tags: np.ndarray, rounds: int = 20, rate: float = 0.5, decay: float = 1e-3) -> None:
        """AdaGrad on the log-likelihood of the tagged chains; gradients are summed over blocks of whole chains."""
        w, w2, other2 = self.weights, np.full(1 << BITS, 1e-6), np.full((3, 2, 2), 1e-6)
        tag, starts = tags.astype(np.int8), np.flatnonzero(first)
        inside = np.flatnonzero(~first)
        seen = np.bincount(2 * tag[inside - 1] + tag[inside], minlength=4).reshape(2, 2).astype(float)
        edges = np.unique(np.append(starts[np.searchsorted(starts, np.arange(0, len(tags), FIT_WORDS), "right") - 1], len(tags)))
        for _ in range(rounds):
            step, g, pairs, misses, heads = np.exp(self.step), -decay * w, np.zeros((2, 2)), 0.0, 0.0
            for i, j in zip(edges, edges[1:], strict=False):
                own, head = features[i:j], first[i:j]
                odds = self.odds(own)
                ahead, back = forward_backward(odds, head, step, np.exp(self.init))
                both = ahead * back
                miss = tags[i:j] - both[:, 1] / both.sum(1)
                for k in range(own.shape[1]):
                    g += np.bincount(own[:, k], miss, 1 << BITS)
                at = np.flatnonzero(~head)
                pair = ahead[at - 1][:, :, None] * step[None] * np.stack([back[at, 0], back[at, 1] * odds[at]], 1)[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                pairs, misses, heads = pairs + pair.sum(0), misses + miss.sum(), heads + miss[head].sum()
            w2 += g * g
            w += rate * g / np.sqrt(w2)
            for k, (name, g) in enumerate((("step", seen - pairs), ("bias", misses), ("init", np.array([-1, 1]) * heads))):
                g = np.broadcast_to(g, (2, 2)) / len(tags)
                other2[k] += g * g
                change = 0.2 * g / np.sqrt(other2[k])
                value = getattr(self, name) + (change if name == "step" else change[0, 0] if name == "bias" else change[0])
                setattr(self, name, value)


def token_labels(features: np.ndarray, row: np.ndarray, toxic: np.ndarray, least_surprise: float = 11.0, least_odds: float = 3.0) -> np.ndarray:
    """Tags of the words of training documents, from the documents' labels.

    A feature's evidence compares the contexts (word before, word after) it has in toxic and
    in other documents; counting contexts, not documents, keeps copies of one toxic document
    from making all its words look toxic.  ``least_surprise`` is the log likelihood ratio
    against chance from which evidence counts, so that few contexts don't suffice.
    """
    evidence = np.full(len(features), -np.inf)
    word = features[:, 0].astype(np.uint64) + np.uint64(1)
    before, after = np.zeros_like(word), np.zeros_like(word)
    same = row[1:] == row[:-1]
    before[1:][same], after[:-1][same] = word[:-1][same], word[1:][same]
    context = mixed(before * np.uint64(0x9E3779B97F4A7C15) + after) >> np.uint64(BITS)
    bad = toxic[row]
    for k in range(features.shape[1]):
        feature = features[:, k].astype(np.uint64)
        keys = context | feature << np.uint64(64 - BITS)
        a, b = (np.bincount((np.unique(keys[x]) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS) for x in (bad, ~bad))
        odds = np.log((a + 0.5) / (a.sum() + 1)) - np.log((b + 0.5) / (b.sum() + 1))
        n, share = np.maximum(a + b, 1), (a.sum() + 1) / (a.sum() + b.sum() + 2)
        surprise = a * np.log(np.maximum(a, 1) / (n * share)) + b * np.log(np.maximum(b, 1) / (n * (1 - share)))
        odds[surprise < least_surprise] = -np.inf
        evidence = np.maximum(evidence, odds[features[:, k]])
    best = np.full(len(toxic), -np.inf)
    np.maximum.at(best, row, evidence)
    return (bad & (evidence >= least_odds) & (evidence >= 0.6 * best[row])).astype(float)


def in_training(doc_id):
    """Rows whose labels may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field learnt from the labelled training rows; see the module for the bound on their sample."""
    spark = docs.sparkSession
    known = labels.where(in_training(F.col(id_col)) & F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("wordtide_id"), (F.col("toxic") == 1).alias("wordtide_toxic")).distinct()
    order = F.xxhash64(F.lit("train"), "wordtide_id")
    chosen = [tuple(r) for flag in (True, False) for r in known.where(F.col("wordtide_toxic") == flag).orderBy(order, "wordtide_id").limit(sample).collect()]
    few = F.broadcast(spark.createDataFrame(chosen, "wordtide_id long, wordtide_toxic boolean"))

    def scan(batches):
        scanner = Scanner(SEPARATORS)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            bodies = []
            for i in range(len(offsets) - 1):
                features = token_features(scanner, data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0]
                bodies.append(features.tobytes() if len(features) <= SAMPLE_TOKENS else b"")
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(bodies, pa.binary())], ["toxic", "id", "body"])

    rows = docs.select(id_col, text_col).join(few, F.col(id_col) == F.col("wordtide_id")).select(text_col, "wordtide_toxic", "wordtide_id").mapInArrow(scan, "toxic boolean, id long, body binary").where("octet_length(body) > 0")
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("body").alias("body")).collect()  # repeated rows once: 2 * sample at most
    field = Field()
    rows = sorted((bytes(r["body"]), r["toxic"]) for r in rows)
    if not any(t for _, t in rows):
        return field
    parts = [np.frombuffer(b, np.uint32).reshape(-1, 1 + len(PREFIXES)) for b, _ in rows]
    features, sizes, toxic = np.concatenate(parts), [len(x) for x in parts], np.array([t for _, t in rows])
    del rows, parts
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.zeros(len(features), bool)
    first[np.append(0, np.cumsum(sizes)[:-1])] = True
    field.fit(features, first, token_labels(features, row, toxic))
    return field


def score_texts(scanner: Scanner, field: Field, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and spans of every text of a column."""
    data, offsets = utf8(column)
    scores, spans = np.zeros(len(offsets) - 1), [[] for _ in range(len(offsets) - 1)]
    for i, j in slices(offsets):
        part, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        features, row, start, end = token_features(scanner, part, edges)
        if not len(row):
            continue
        p = field.marginals(features, np.append(True, row[1:] != row[:-1]))
        high, clean = np.zeros(j - i), np.zeros(j - i)
        np.maximum.at(high, row, p)
        some = p >= SUSPICIOUS
        np.add.at(clean, row[some], np.log1p(-np.minimum(p[some], 1 - 1e-12)))
        scores[i:j] = np.maximum(high, 1 - np.exp(clean))
        bad = np.flatnonzero(p >= 0.5)
        if len(bad):
            chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))
            for k in bad:
                base = chars[edges[row[k]]]
                spans[i + row[k]].append({"start": int(chars[start[k]] - base), "end": int(chars[end[k]] - base), "p": float(p[k])})
    return scores, spans


def _sent(spark, field: Field):
    """The field as a broadcast of its used weights, and how a task opens it."""
    used = np.flatnonzero(field.weights)
    sent = spark.sparkContext.broadcast((used.astype(np.uint32), field.weights[used].astype(np.float32), field.bias, field.step, field.init))

    def opened() -> tuple[Scanner, Field]:
        one = Field()
        at, weights, one.bias, one.step, one.init = sent.value
        one.weights = np.zeros(1 << BITS, np.float32)
        one.weights[at] = weights
        return Scanner(SEPARATORS), one

    return opened


def scored(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and spans (start and end in characters, and probability) of every row; no shuffle."""
    opened = _sent(docs.sparkSession, field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def scan(batches):
        scanner, one = opened()
        for batch in batches:
            scores, spans = score_texts(scanner, one, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(scan, "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def without_toxic(docs: DataFrame, field: Field, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose texts score under ``cut``; no shuffle."""
    opened = _sent(docs.sparkSession, field)
    at = docs.columns.index(text_col)

    def scan(batches):
        scanner, one = opened()
        for batch in batches:
            yield batch.filter(pa.array(score_texts(scanner, one, batch.column(at))[0] < cut))

    return docs.mapInArrow(scan, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learnt from ``labels`` outside the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    return scored(docs, field).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans")
