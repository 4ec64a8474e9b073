"""Periodic runs and vector codes against plain loops."""

import random
import zlib

import numpy as np
import pytest

from wordtide.llm import periodic_runs, vector_codes


def plain_runs(words, min_length=6, exponent=4):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def test_least_overlap():
    assert periodic_runs.least_overlap(6, 4) == 5 and periodic_runs.least_overlap(4, 4) == 3 and periodic_runs.least_overlap(12, 5) == 10


def test_runs_against_plain_loops():
    draw = random.Random(1)
    for _ in range(800):
        n, k, words = draw.choice([0, 3, 6, 10, 50, 120, 300]), draw.choice([1, 2, 3, 5, 40]), []
        while len(words) < n:
            if draw.random() < 0.5:
                words += [draw.randrange(k) for _ in range(draw.choice([1, 2, 3, 7, 9, 11, 14, 25]))] * draw.choice([1, 2, 3, 4, 5, 9])
            else:
                words.append(draw.randrange(3 * k))
        words = words[:n]
        for bounds in ((6, 4), (12, 5)):
            assert periodic_runs.runs_of(np.array(words, np.int64), *bounds) == plain_runs(words, *bounds)


@pytest.mark.parametrize("words", [np.zeros(200_000, np.int64), np.r_[np.zeros(99_999, int), 1, np.zeros(100_000, int)], np.arange(200_000) % 40_000])
def test_long_runs(words):
    runs = periodic_runs.runs_of(words)
    assert sum(length for _, length, _ in runs) >= 199_999 and len(runs) < 3


def test_outside_masked_words_no_segment():
    assert periodic_runs.segments(np.arange(1000), 5) == []
    assert periodic_runs.segments(np.r_[np.arange(50), np.tile([7, 8], 5), np.arange(100, 150)], 5) == [(50, 60)]


def test_planted_runs_follow_the_contract(spark):
    rows = [(i, " ".join(f"w{(7 * i + j * j) % 90}" for j in range(i * 3 % 70))) for i in range(300)] + [(400, None), (401, ""), (401, ""), (None, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = periodic_runs.with_planted_runs(docs).collect()
    planted = 0
    for (doc_id, text), r in zip(rows, got, strict=True):
        words, h = (text or "").split(), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], planted + 1
        assert (r["text"] or "").split() == words
    assert planted > 10


def test_collapsed_text_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b " + "x y " * 6 + "z", "t"), (2, None, "u")], "doc_id long, text string, runs string")
    one, two = periodic_runs.periodic_runs(docs).orderBy("doc_id").collect()
    assert (one["collapsed"], [tuple(r) for r in one["runs"]], one["n_words"]) == ("a b x y z", [(2, 12, 2)], 15)
    assert (two["collapsed"], two["runs"], two["n_words"]) == ("", [], 0)
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, exponent=2)


def test_filtered_trees_against_all_distances():
    rng, apart = np.random.default_rng(0), 0
    for t in range(60):
        n, w, k = int(rng.integers(1, 900)), int(rng.integers(1, 9)), int(rng.integers(1, 17))
        points = rng.integers(-6, 6, (n, w)) if t % 2 else rng.integers(-900, 900, (n, w)) + rng.integers(0, 4, (n, 1)) * 50_000
        book = points[rng.integers(0, n, k)] if t % 3 else rng.integers(-6, 6, (k, w))
        order, levels = vector_codes.build_tree(points)
        want, _ = vector_codes.nearest(points[order], book)
        labels, sums, counts = np.full(n, -1), np.zeros((k, w), np.int64), np.zeros(k, np.int64)
        assert vector_codes.filtered(points[order], levels, book, labels=labels) == (whole := vector_codes.filtered(points[order], levels, book, sums, counts))
        apart += whole
        plain = np.zeros((k, w), np.int64)
        np.add.at(plain, want, points[order])
        assert (labels == want).all() and (sums == plain).all() and (counts == np.bincount(want, minlength=k)).all()
    assert apart > 1000  # whole subtrees were assigned


def test_codes_of_many_blocks_ragged_and_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_COMPONENTS", 16 * 10)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=13 + i % 3)], str(i % 4)) for i in range(200)]
    out, books = vector_codes.product_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    cut = np.zeros((200, 16), np.int64)
    for i, v, _ in rows:
        cut[i, : len(v)] = np.floor(np.array(v) * 4096)
    cut = cut.reshape(200, 8, 2)
    book = cut[:16].transpose(1, 0, 2).copy()
    for _ in range(6):
        for p in range(8):
            near = ((cut[:, p, None] - book[p]) ** 2).sum(2).argmin(1)
            for e in set(near.tolist()):
                book[p, e] = cut[near == e, p].sum(0) // (near == e).sum()
    far = [((cut[:, p, None] - book[p]) ** 2).sum(2) for p in range(8)]
    want = {i: ("".join(f"{far[p][i].argmin():02x}" for p in range(8)), sum(int(far[p][i].min()) for p in range(8))) for i in range(200)}
    assert {r["id"]: (r["code"], r["error"]) for r in out.collect()} == want and (books.entries == book).all()
    few, books = vector_codes.product_codes(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, label string"))
    assert books.entries.shape == (8, 3, 2) and [r["error"] for r in few.collect()] == [0, 0, 0]
    with pytest.raises(Exception, match="beyond"):
        vector_codes.product_codes(spark.createDataFrame([(1, [1e30] * 8, "a")], "vec_id long, embedding array<double>, label string"))
