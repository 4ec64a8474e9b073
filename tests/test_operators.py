"""Operators against hand-made rows."""

import re

from pyspark.sql import functions as F

from wordtide.annotate import base
from wordtide.functions import fixed, text
from wordtide.operators import activity, frequency, phrases, tiers, titles
from wordtide.plans import catalogue, pipelines


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_thresholds_are_order_statistics(spark):
    data = [("a", str(i), i, 10 * i if i % 2 else 0) for i in range(1, 8)]
    got = frequency.thresholds(spark.createDataFrame(data, "g string, word string, n long, english_frequency long"), "g").first()
    assert tuple(got) == ("a", 5, 50, 4, 50)


def test_thresholds_of_no_english_words(spark):
    got = frequency.thresholds(spark.createDataFrame([("a", "w", 3, 0)], "g string, word string, n long, english_frequency long"), "g").first()
    assert tuple(got) == ("a", 3, 1, 3, 1)


def test_tier_rules_in_order(spark):
    data = [
        ("few", 2, 0, "C1", False, False), ("easy", 9, 0, "C1", True, False), ("ox", 9, 0, "C1", False, True), ("often", 9, 60, "C1", False, False),
        ("low", 9, 0, "A2", False, False), ("b1", 9, 0, "b1 ", False, False), ("b2", 9, 0, "B2", False, False), ("hard", 9, 0, "N/A", False, False),
        ("random", 4, 0, "C2", False, False), ("common", 9, 100, "A1", True, True), ("rare", 1, 100, "C1", False, False),
    ]
    df = spark.createDataFrame(data, "word string, n long, english_frequency long, vocabulary_level string, easy boolean, oxford boolean")
    tier, reason = tiers.tier_and_reason(max_english=50)
    got = {r[0]: (r[1], r[2]) for r in df.withColumns({"series_threshold": F.lit(5), "english_threshold": F.lit(80)}).select("word", tier, reason).collect()}
    t = fixed.TIERS
    assert got == {
        "few": (t[1], None), "easy": (t[4], "Easy word (easy_words.csv)"), "ox": (t[4], "Oxford 3000"), "often": (t[4], "High English frequency (60 > 50)"),
        "low": (t[4], "Vocabulary level below C (A2)"), "b1": (t[5], None), "b2": (t[6], None), "hard": (t[0], None), "random": (t[1], None), "common": (t[2], None), "rare": (t[3], None),
    }


def test_levels(spark):
    listed = spark.createDataFrame([("a", "B1"), ("a", "c1"), ("b", "x"), ("c", "A1")], "word string, level string")
    assert rows(tiers.one_level(listed), "word", "level") == [("a", "B1"), ("c", "A1")]
    assert rows(tiers.one_level(listed, highest=True), "word", "level") == [("a", "C1"), ("c", "A1")]
    words = spark.createDataFrame([("boxes",), ("zzz",)], "word string")
    assert rows(tiers.labelled(words, spark.createDataFrame([("box", "A2")], "word string, level string")), "word", "level") == [("boxes", "A2"), ("zzz", "UNKNOWN")]


def test_ngrams_and_subsumption(spark):
    found = phrases.repeated_ngrams(docs(spark, "a b c d x a b c d", "one two"))
    assert rows(found, "phrase", "n") == [("a b c", 2), ("a b c d", 2), ("b c d", 2)]
    assert rows(phrases.unsubsumed(found), "phrase") == [("a b c d",)]


def test_ngram_candidates(spark):
    df = spark.createDataFrame([("one of the",), ("s red car",), ("big red car of",), ("it is the",), ("big red car",)], "phrase string")
    assert rows(df.where(phrases.is_candidate(F.col("phrase"))), "phrase") == [("big red car",)]


def test_phrasal_verbs(spark):
    got = phrases.phrasal_verbs(docs(spark, "Wake up! We wake up and zap out in. Look forward to it; give-up. s up"))
    assert rows(got, "phrase", "n", "from_dictionary") == [("s up", 1, False), ("wake up", 4, True), ("zap out", 1, False), ("zap out in", 1, False), ("out in", 1, False)] or rows(got, "phrase", "n", "from_dictionary") == sorted(
        [("s up", 1, False), ("wake up", 4, True), ("zap out", 1, False), ("zap out in", 1, False), ("out in", 1, False)]
    )
    assert ("s up", 1) not in rows(phrases.phrasal_candidates(got), "phrase", "n")


def test_examples(spark):
    lines = spark.createDataFrame([(1, "The cat sat here."), (2, "A cat ran off now."), (3, "Cat number three."), (4, "concatenate words"), (5, "cat")], "at long, line string")
    got = phrases.word_examples(lines, spark.createDataFrame([("cat",)], "word string"))
    assert rows(got, "place", "line") == [(1, "The cat sat here."), (2, "A cat ran off now.")]
    asked = spark.createDataFrame([(0, "red car zone")], "doc_id long, phrase string")
    told = phrases.phrase_examples(docs(spark, "A scared car red car zoned out. The red  car zone is here. Short."), asked)
    assert rows(told, "place", "sentence") == [(1, "The red  car zone is here"), (2, "A scared car red car zoned out")]


def test_queues_and_streaks(spark):
    shows = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "show_pos int, name string, episodes int")
    got = [(r["episode"], r["name"]) for r in activity.round_robin(shows).orderBy("order_key").collect()]
    assert got == [(1, "a"), (1, "b"), (2, "a")]
    runs = spark.createDataFrame([("g", i, ok) for i, ok in enumerate([True, False, False, True, False, False, False, True])], "grp string, pos int, ok boolean")
    assert [r[0] for r in rows(activity.until_streak(runs, 3), "pos")] == [0, 1, 2, 3, 4, 5, 6]


def test_reuse_and_reconciliation(spark):
    words = spark.createDataFrame([("Cat",), ("dog",)], "word string")
    answers = spark.createDataFrame([("cat", "c"), ("dog", "n/a")], "word string, gloss string")
    assert rows(activity.reconciled(words, answers), "word", "gloss") == [("Cat", "c"), ("dog", "n/a")]
    assert rows(activity.reused(words, answers).where("to_translate"), "word") == [("Cat",), ("dog",)]
    glossed = pipelines.glossed(words, answers, base.Stub(("x",)))
    assert rows(glossed, "word", "gloss") == [("Cat", "x"), ("dog", "x")]


def test_annotator_retries(spark):
    class Flaky(base.Annotator):
        batch, attempts, pause = 2, 3, (0,)

        def label(self, words):
            if "bad" in words:
                raise ValueError
            return {w.upper(): "ok" for w in words}

    words = spark.createDataFrame([("a",), ("b",), ("bad",)], "word string").coalesce(1)
    assert rows(base.annotated(words, Flaky(), wait=lambda s: None), "word", "label") == [("a", "ok"), ("b", "ok"), ("bad", None)]


def test_title_decisions(spark):
    df = spark.createDataFrame([(0.95, 0.3, 0, 2000), (0.6, 0.3, 0, 0), (0.95, 0.3, 1999, 2000), (0.9, 0.05, 0, 0), (0.8, 0.3, 0, 0)], "score double, gap double, y int, f int")
    _, issue = titles.movie_decision(F.col("score"), F.col("gap"), F.col("y"), F.col("f"), F.lit(True), F.lit(True))
    assert [r[0] for r in df.select(issue).collect()] == [None, "not_found", "year_mismatch", "ambiguous", "uncertain"]
    ranked = titles.ranked(spark.createDataFrame([("dune",)], "query string"), spark.createDataFrame([("Dune",), ("Dune part two",), ("June",)], "title string"))
    assert [r["title"] for r in ranked.orderBy("place").collect()] == ["Dune", "June", "Dune part two"]


def test_examples_of_all_phrases(spark, tmp_path):
    names = [f"{a} {b} {c}" for a, b, c in zip("amber birch cedar delta ember frost grape hazel".split(), "river stone table under valley water yellow zebra".split(), "north ocean paper quiet round south tower urban".split(), strict=True)]
    spoken = [f"They saw the {p} again" for p in names] + [f"Nobody liked {p}s at all" for p in names] + [f"Later the {p} was gone" for p in names]
    docs(spark, ". ".join(spoken), "nothing here is said twice").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for p in {r["phrase"] for r in catalogue.phrase_subsume(spark, str(tmp_path)).collect()}:
        held = [(not re.search(rf"\b{p}\b", s.lower()), i, s) for i, s in enumerate(spoken) if p in s.lower()]
        want += [(0, p, place, s) for place, (_, _, s) in enumerate(sorted(held)[:2], 1)]
    got = rows(catalogue.QUERIES["phrase_examples_whole"](spark, str(tmp_path)), "doc_id", "phrase", "place", "sentence")
    assert got == sorted(want) and len({r[1] for r in got}) >= len(names)


def test_examples_of_two_words_inside_longer_ones(spark):
    told = docs(spark, "We look forward to it. They overlook forms daily. Please look for the key. Nothing of the kind here", "I look forward to that")
    asked = spark.createDataFrame([(0, "look for"), (0, "give up"), (1, "look for")], "doc_id long, phrase string")
    got = rows(phrases.phrase_examples(told, asked), "doc_id", "phrase", "place", "sentence")
    assert got == [(0, "look for", 1, "Please look for the key"), (0, "look for", 2, "We look forward to it"), (1, "look for", 1, "I look forward to that")]


def test_words_are_ranked_within_their_row(spark):
    from wordtide.functions.python import singular_form

    words = ["cats", "cat", "is", "bus", "ties", "flies", "boxes", "wolves", "gas", "glass", "s", "wishes", "yes", "vs", "ves", "lives", "dies", "sizes"]
    df = spark.createDataFrame([(x,) for x in words], "w string")
    assert [singular_form(x) for x in words] == [r[0] for r in df.select(text.singular(F.col("w"))).collect()]
    docs = [(1, "x", "en", "b cats a cat b a cat"), (2, "x", "de", ""), (3, "x", "en", None), (4, "x", "en", "z y z")]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")
    rows = lambda d, k=None: sorted(tuple(r) for r in frequency.ranked_words(d, k).select("doc_id", "place", "word", "n", "first_pos", "total").collect())
    want = [(1, 1, "cat", 3, 1, 3), (1, 2, "b", 2, 0, 3), (1, 3, "a", 2, 2, 3), (4, 1, "z", 2, 0, 2), (4, 2, "y", 1, 1, 2)]
    assert rows(df) == want and rows(df, 1) == [x for x in want if x[1] == 1]
    assert "Exchange" not in frequency.ranked_words(df)._jdf.queryExecution().executedPlan().toString()
    twice = df.union(spark.createDataFrame([(4, "x", "en", "y y y z")], df.schema))
    assert [x for x in rows(twice) if x[0] == 4] == [(4, 1, "y", 4, 0, 2), (4, 2, "z", 3, 0, 2)]


def test_limits_and_dimensions_without_shuffles_of_frequent_words(spark, monkeypatch):
    """Limits beside the rows are those of ``thresholds``; dimensions are the same with any number of broadcast words, absent words too."""
    rows = [(d, f"w{i}", (i * 7 + d) % 11 + 1, (i * i + d) % 5) for d in range(1, 9) for i in range(d * d)] + [(None, "w1", 2, 3), (99, "w0", 4, 0)]
    df = spark.createDataFrame(rows, "d long, word string, n long, english_frequency long")
    limits = {r["d"]: (r["series_threshold"], r["english_threshold"]) for r in frequency.thresholds(df, "d").collect() if r["d"] is not None}
    got = tiers.with_limits(df, "d").collect()
    assert len(got) == len(rows) - 1 and all((r["series_threshold"], r["english_threshold"]) == limits[r["d"]] for r in got)
    counts = df.select("d", "word", "n")
    english = spark.createDataFrame([("w0", 5), ("w2", 7), ("none", 1)], "word string, english_frequency long")
    lists = spark.createDataFrame([("w0", "easy"), ("w3", "oxford")], "word string, filter_class string")
    for hot in (1 << 17, 3, 0):
        monkeypatch.setattr(tiers, "MOST_HOT", hot)
        out = tiers.with_dimensions(counts, english, catalogue.level_of("word"), lists)
        assert out.count() == len(rows)
        told = {(r["word"], r["english_frequency"], r["vocabulary_level"], r["easy"], r["oxford"]) for r in out.where("word < 'w4'").collect()}
        assert {x for x in told if len(x[0]) == 2} == {("w0", 5, "N/A", True, False), ("w1", 0, "N/A", False, False), ("w2", 7, "N/A", False, False), ("w3", 0, "N/A", False, True)}
