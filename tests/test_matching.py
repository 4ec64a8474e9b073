"""Phrases found by automata and by their rarest token, against regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wordtide.functions.matching import Phrases
from wordtide.operators import phrases


def test_counts_as_findall():
    draw = random.Random(2)
    for _ in range(300):
        listed = ["".join(draw.choice("ab _-.é") for _ in range(draw.randint(1, 6))) for _ in range(8)]
        said = "".join(draw.choice("ab _-.é") for _ in range(draw.randint(0, 60)))
        want = {p: n for p in set(listed) if (n := len(re.findall(r"\b" + re.escape(p) + r"\b", said)))}
        assert Phrases(listed).counts(said) == want
    assert Phrases(["go go"]).counts("go go go go go") == {"go go": 2} and Phrases([]).counts("x") == {} and Phrases(["", "x"]).counts("x") == {"x": 1}


@pytest.mark.parametrize("most", [200_000, 2])
def test_listed_counts(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "MOST_LISTED", most)
    docs = spark.createDataFrame([(1, "Go go go! give up, giveup; GIVE UP"), (2, None), (3, ""), (1, "look for it")], "doc_id long, text string")
    listed = spark.createDataFrame([("go go",), ("give up",), ("give up",), ("look for",), ("for it",), (None,), ("",)], "phrase string")
    got = sorted(tuple(r) for r in phrases.listed_counts(docs, listed).collect())
    assert got == [(1, "for it", 1), (1, "give up", 4), (1, "go go", 1), (1, "look for", 1)]
    assert phrases.listed_counts(docs, listed.where("false")).count() == 0


def test_examples_of_two_words_inside_words(spark):
    docs = spark.createDataFrame([(1, "They look for the key. I overlook forward motion here. Nobody saw it again"), (2, "Nobody here at all today")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "look for"), (1, "saw it"), (2, "look for"), (3, "saw it"), (1, "one")], "doc_id long, phrase string")
    got = sorted(tuple(r) for r in phrases.phrase_examples(docs, asked).collect())
    assert got == [(1, "look for", 1, "They look for the key"), (1, "look for", 2, "I overlook forward motion here"), (1, "saw it", 1, "Nobody saw it again")]


def test_examples_of_many_sentences_and_phrases(spark):
    """A book: neither its sentences nor its phrases are multiplied."""
    said = [f"word{i} turns{i} into word{i + 1} quite slowly" for i in range(20_000)]
    asked = [(1, f"turns{i} into") for i in range(0, 20_000, 40)]
    docs = spark.createDataFrame([(1, ". ".join(said))], "doc_id long, text string")
    got = phrases.phrase_examples(docs, spark.createDataFrame(asked, "doc_id long, phrase string")).collect()
    assert {(r["phrase"], r["place"], r["sentence"]) for r in got} == {(p, 1, said[int(p[5:].split()[0])]) for _, p in asked}


def test_judge_examples_by_the_rarest_token(spark):
    draw = random.Random(9)
    words = ["the", "the", "the", "cat", "sat", "mat", "on", "zebra"]
    lines = [(i, " ".join(draw.choice(words) for _ in range(8)) + draw.choice(["", ", the end", "  <i>on</i> mat"])) for i in range(200)]
    asked = ["the cat", "sat on the", "zebra zebra", "missing word", "the", "mat the end", "on mat"]
    got = phrases.judge_examples(spark.createDataFrame(lines, "at int, line string"), spark.createDataFrame([(p,) for p in asked], "phrase string"))
    want = []
    for p in asked:
        seen = {}
        for at, line in lines:
            clean = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", line)).strip()
            marked = " ".join(re.sub(r"[^\w\s]", " | ", clean.lower()).split())
            if f" {p} " in f" {marked} " and len(clean) >= 8:
                seen.setdefault(clean[:220], at)
        want += [(p, i, line) for i, (line, _) in enumerate(sorted(seen.items(), key=lambda x: (x[1], x[0]))[:2], 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "slice(" not in plan  # no n-grams are put together


def test_judge_examples_send_few_lines(spark, monkeypatch):
    """Frequent phrases send their first lines of each task alone, by nested positions with nulls, and no line is lost by cuts or flushes."""
    lines = [((i // 7, i % 7 if i % 5 else None), f"the cat sat on line {i % 40} again" + " and on" * (i % 3)) for i in range(400)]
    df = spark.createDataFrame([(a, x) for a, x in lines], "at struct<a:int,b:int>, line string").repartition(4)
    asked = ["the", "cat sat", "sat the", "on line 7", "a  b", "", "again and on", None]
    phrases_ = spark.createDataFrame([(p,) for p in asked], "phrase string")
    want = {}
    for p in filter(None, asked):
        first = {}
        for (a, b), x in lines:
            if f" {p} " in f" {x} ":
                key = (a, b is not None, b or 0)
                first[x] = min(first.get(x, key), key)
        want |= {(p, i): x for i, x in enumerate(sorted(first, key=lambda x: (first[x], x))[:2], 1)}
    for listed, held in ((200_000, 100_000), (2, 1)):
        monkeypatch.setattr(phrases, "MOST_LISTED", listed)
        monkeypatch.setattr(phrases, "MOST_HELD", held)
        got = {(r["phrase"], r["place"]): r["line"] for r in phrases.judge_examples(df, phrases_).collect()}
        assert got == want
    sent = phrases.first_lines(df.select("at", "line", F.split("line", " ").alias("tokens")), phrases_.where("phrase = 'the'"), 2)
    assert sent.count() <= 4 * 2
