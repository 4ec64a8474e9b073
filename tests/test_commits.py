"""Tables replaced in one step, counts with retractions, exact rounding."""

import random

import pytest
from pyspark.sql import functions as F

from wordtide.functions import rounding
from wordtide.operators import incremental
from wordtide.sinks import commits


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def words(spark, tmp_path):
    table = commits.Versioned(spark, str(tmp_path / "words"))
    table.write(spark.createDataFrame([("a", 1), ("B", 2), ("c", 3), (None, 4)], "word string, n int"))
    return table


def test_a_writer_that_dies_leaves_the_old_state(spark, words, monkeypatch):
    assert commits.Versioned(spark, words.path + "2").read() is None
    new = spark.createDataFrame([("z", 9)], "word string, n int")
    with monkeypatch.context() as m:
        m.setattr(words, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            words.write(new)
    assert words.version() == 1 and words.read().count() == 4
    before = words.read()
    assert words.write(new) == 2 and rows(words.read(), "word") == [("z",)] and words.read(1).count() == 4
    assert before.count() == 4  # who reads the old version still can
    assert words.write(new) == 3 and words.clean(keep=2) == 2 and words.version() == 3 and rows(words.read(2), "n") == [(9,)]


def test_the_second_of_two_writers_starts_again(spark, words):
    new = spark.createDataFrame([("z", 9)], "word string, n int")
    with pytest.raises(commits.Conflict):
        words.write(new, since=0)
    seen = []

    def slow(table):
        seen.append(table.count())
        if len(seen) == 1:
            words.write(new)  # another writer is faster
        return table.union(new)

    assert words.change(slow) == 3 and seen == [4, 1] and words.read().count() == 2


def test_words_taken_out_are_counted_in_the_same_pass(spark, words):
    listed = spark.createDataFrame([("b",), ("A",), ("A",), ("x",), (None,)], "word string")
    assert commits.without_words(words, listed) == 2
    assert rows(words.read(), "word", "n") == [("c", 3), (None, 4)] and words.version() == 2


def test_columns_and_states(spark, words, tmp_path):
    glosses = spark.createDataFrame([("a", "eins", "a one")], "word string, gloss string, example string")
    tags = spark.createDataFrame([("c", "name")], "word string, tag string")
    for _ in range(2):  # columns of an earlier run are replaced
        commits.with_glosses(words, glosses, tags)
    assert ("a", 1, "eins", "a one", "") in rows(words.read(), "word", "n", "gloss", "example", "tag") and words.read().count() == 4
    state = commits.Versioned(spark, str(tmp_path / "state"))
    of = lambda *r: spark.createDataFrame(r, "user int, word string, gloss string, deleted boolean")
    commits.upsert(state, of((1, "a", "x", None), (2, "b", "y", False), (3, "c", "z", True)), "user", "word")
    commits.upsert(state, of((1, "a", "new", None), (2, "b", None, True)), "user", "word")
    assert rows(state.read(), "user", "word", "gloss") == [(1, "a", "new")]


def test_three_batches_equal_one_full_run(spark, tmp_path, monkeypatch):
    files, totals = (commits.Versioned(spark, str(tmp_path / x)) for x in ("files", "totals"))
    of = lambda **texts: spark.createDataFrame(list(texts.items()), "path string, content string")
    incremental.refreshed(files, totals, of(a="one two two", b="two three", c=""))
    incremental.refreshed(files, totals, of(b="three three four", d="one"), spark.createDataFrame([("c",)], "path string"))
    got = incremental.refreshed(files, totals, of(a="two"), spark.createDataFrame([("d",), ("none",)], "path string"))
    want = rows(incremental.totals_of(incremental.file_counts(of(a="two", b="three three four"))), "word", "n", "files")
    assert rows(got, "word", "n", "files") == want == [("four", 1, 1), ("three", 2, 1), ("two", 1, 1)]
    with monkeypatch.context() as m:  # a run dies between its two commits
        m.setattr(totals, "write", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            incremental.refreshed(files, totals, of(e="five"))
    got = incremental.refreshed(files, totals, of(f="five"))
    assert rows(got, "word", "n") == [("five", 2), ("four", 1), ("three", 2), ("two", 1)]


def test_rounding_as_of_exact_values(spark):
    draw = random.Random(4)
    given = [draw.uniform(-10, 10) for _ in range(600)] + [draw.randint(-4000, 4000) / 8 for _ in range(400)] + [round(draw.uniform(0, 100), 3) for _ in range(400)]
    given += [0.5, 1.5, 2.5, -0.5, 2.675, 1.005, 0.125, 0.375, 5.015, 0.0, -0.0, 1e15 + 0.5, 4503599627370497.5, 1e300, float("inf"), 123456789.125, 0.285, 1.115]
    got = spark.createDataFrame([(x,) for x in given], "x double").select("x", *(rounding.rounded(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2, 3))).collect()
    for r in got:
        for d in (0, 1, 2, 3):
            if abs(r["x"]) * 10**d < 2**52 or r["x"] == float("inf"):
                assert r[f"d{d}"] == (round(r["x"], d) if r["x"] != float("inf") else r["x"]), (r["x"], d)
    none = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(rounding.rounded(F.col("x"), 2).alias("y")).collect()
    assert none[0]["y"] is None and none[1]["y"] != none[1]["y"]
