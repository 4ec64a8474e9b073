"""Titles ranked within bounds against all pairs, and whole messages resolved."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from wordtide.operators import titles
from wordtide.plans import pipelines


def brute(queries, names, k):
    plain = lambda t: " ".join("".join(c if c.isalnum() or c in "_ " else " " for c in t.lower()).split())
    out = {}
    for q in set(queries):
        ratio = lambda t: SequenceMatcher(None, plain(q), plain(t)).ratio() if plain(q) and plain(t) else 0.0
        best = sorted(((-ratio(t), t) for t in names))[: k + 1]
        for i, (s, t) in enumerate(best[:k]):
            out[q, i + 1] = (t, round(-s, 9), round(-s + (best[i + 1][0] if i + 1 < len(best) else 0.0), 9))
    return out


@pytest.mark.parametrize("cells", [100_000, 5])
def test_ranked_against_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(titles, "MOST_CELLS", cells)  # few cells: fewer groups of letters, down to one
    monkeypatch.setattr(titles, "FIRST_TITLES", 6)
    draw = random.Random(5)
    words = ["the", "dark", "night", "king", "of", "ötzi", "star", "wars", "return", "x", "house", "2", "日本"]
    names = sorted({" ".join(draw.choice(words) for _ in range(draw.randint(1, 5))) + draw.choice(["", "!", " (2001)"]) for _ in range(300)} | {"", "?!", "A" * 300})
    queries = [*names, "dark knight", "zzz", "", "Return of the King", "Return of the King"]
    got = titles.ranked(spark.createDataFrame([(q,) for q in queries] + [(None,)], "query string"), spark.createDataFrame([(t,) for t in names] + [(None,)], "title string"), 3)
    assert {(r["query"], r["place"]): (r["title"], round(r["score"], 9), round(r["gap"], 9)) for r in got.collect()} == brute(queries, names, 3)


def test_ranked_edges_and_plan(spark):
    none, some = spark.createDataFrame([], "query string"), spark.createDataFrame([("dune",)], "query string")
    names = spark.createDataFrame([("Dune",)], "title string")
    assert titles.ranked(none, names).count() == 0 and titles.ranked(some, names.where("false")).count() == 0
    one = titles.ranked(some, names)
    assert one.first()["gap"] == 1.0
    assert "Cartesian" not in one._jdf.queryExecution().toString() and "NestedLoop" not in one._jdf.queryExecution().toString()


def test_bounds_never_miss(spark):
    draw = random.Random(1)
    pairs = [tuple("".join(draw.choice("abcde é") for _ in range(draw.randint(0, 12))) for _ in range(2)) for _ in range(400)]
    for a, b in pairs:
        counts = [{c: t.count(c) for c in t} for t in (a, b)]
        assert SequenceMatcher(None, a, b).ratio() <= titles.common_bound(counts[0], len(a), counts[1], len(b)) or not a or not b
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", titles.group_counts(F.col("a"), 3).alias("x"), titles.group_counts(F.col("b"), 3).alias("y")).collect()
    for r in rows:
        assert sum(r["x"]) == len(r["a"]) and (not r["a"] or not r["b"] or SequenceMatcher(None, r["a"], r["b"]).ratio() <= 2 * sum(map(min, r["x"], r["y"])) / (len(r["a"]) + len(r["b"])))


def test_resolved_messages(spark):
    movies = spark.createDataFrame([("Dune", 1984, 10), ("Dune", 2021, 11), ("Heat", 1995, 12), ("The Office Party", 2016, 13), ("Fallout Shelter", 2001, None)], "title string, year int, catalogue_id long")
    shows = spark.createDataFrame([("Fallout", 20, {2: 8}), ("The Office", 21, {1: 6}), ("Dark Matter", 22, {1: 9})], "title string, catalogue_id long, episodes map<int,int>")
    asked = [(1, "dune 2021", "series"), (2, "heat (1990)", "series"), (3, "fallout s2e3", "series"), (4, "Fallout season 2 episode 9", "series"), (5, "the office", "series"), (6, "qqqq", "movie"), (7, None, "movie"), (8, "dune", "movie"), (9, " ", "movie")]
    got = {r["id"]: r for r in pipelines.resolved_titles(spark.createDataFrame(asked, "id int, raw string, mode string"), movies, shows).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 8}
    assert (got[1]["title"], got[1]["catalogue_id"], got[1]["year"]) == ("Dune", 11, 2021)
    assert (got[2]["title"], got[2]["issue"]) == ("Heat", "year_mismatch")
    assert (got[3]["media"], got[3]["title"], got[3]["season"], got[3]["episode"], got[3]["issue"], got[3]["confidence"]) == ("tv", "Fallout", 2, 3, None, "high")
    assert got[4]["issue"] == "episode_out_of_range"
    assert (got[5]["media"], got[5]["title"]) == ("tv", "The Office") and got[5]["alternatives"][0]["title"] == "The Office Party"
    assert got[6]["issue"] == "not_found" and got[8]["issue"] == "ambiguous"  # two films of one name
