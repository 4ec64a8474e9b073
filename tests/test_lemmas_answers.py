"""Lemmas with their way out, and questions that are asked once."""

import glob
import threading
import time


from wordtide.annotate import answers
from wordtide.annotate.base import Annotator
from wordtide.functions import lemmas


def test_rules():
    given = "cities cats boxes classes wolves bus this went thinking thought stopped making hoped walked agreed studying tried kiss red falling creating Using".split()
    want = "city cat box class wolf bus this go think think stop make hope walk agreed study try kiss red fall create use".split()
    got = lemmas.RuleLemmatiser().lemmas(given)
    assert got == want
    assert lemmas.RuleLemmatiser([("en", "", 2)], {"oxen": "ox!"}).lemmas(["oxen", "taken", "en"]) == ["ox!", "take", "en"]


def odd():
    class Odd(lemmas.Lemmatiser):
        """Splits what has a hyphen in two, as tokenisers do; fails of one word."""

        def lemmas(self, words):
            if "boom" in words:
                raise RuntimeError
            return [p.upper() for w in words for p in w.split("-")]

    return Odd  # made in a function, so that tasks get it by value


def test_a_batch_of_another_number_falls_back_whole(spark):
    words = ["a-b", "cats", "dogs", "fish", "cities", "Cats", None, ""]
    df = spark.createDataFrame([(w,) for w in words], "word string").coalesce(1)
    got = {r["word"]: r["lemma"] for r in lemmas.lemmatised(df, odd(), batch=100).collect()}
    assert got == {"a-b": "a-b", "cats": "cat", "dogs": "dog", "fish": "fish", "cities": "city"}  # singular forms, not the hook's
    got = {r["word"]: r["lemma"] for r in lemmas.lemmatised(df.where("word != 'a-b'"), odd()).collect()}
    assert got["cats"] == "cats" and got["cities"] == "cities"
    assert lemmas.lemmatised(spark.createDataFrame([("boom",), ("boxes",)], "word string").coalesce(1), odd()).where("lemma = 'box'").count() == 1
    counts = spark.createDataFrame([(1, "cats", 2), (1, "cat", 3), (2, "went", 1), (2, "xyz", 4)], "doc_id int, word string, n int")
    rolled = lemmas.rolled_up(counts, lemmas.lemmatised(counts), "doc_id").collect()
    assert sorted(tuple(r) for r in rolled) == [(1, "cat", 5), (2, "go", 1), (2, "xyz", 4)]
    assert [r[0] for r in counts.select(lemmas.lemma_of(counts["word"])).collect()] == ["cat", "cat", "go", "xyz"]


def counting():
    class Counting(Annotator):
        """Notes each call as a file; two fields in an answer."""

        batch, pause = 2, (0,)

        def __init__(self, folder):
            self.folder = folder

        def label(self, words):
            with open(f"{self.folder}/{time.time_ns()}-{threading.get_ident()}.call", "w") as f:
                f.write("\n".join(words))
            time.sleep(0.2)
            if "bad" in words:
                raise ValueError
            return {w.upper(): {"tag": "name" if w.startswith("n") else "word", "rating": "low" if w.endswith("l") else "high"} for w in words}

    return Counting  # made in a function, so that tasks get it by value


def calls(folder):
    return [w for f in glob.glob(f"{folder}/*.call") for w in open(f).read().split("\n")]


def test_each_word_is_asked_once_whatever_runs_again(spark, tmp_path):
    words = spark.createDataFrame([(f"w{i}",) for i in range(20)] + [("nina",), ("w1",), (None,)], "word string")
    out = answers.asked_once(words, counting()(str(tmp_path)), str(tmp_path / "kept"), "tag", "rating", wait=lambda s: None)
    first = sorted(tuple(r) for r in out.collect())
    assert sorted(tuple(r) for r in out.collect()) == first  # every task has run again
    asked = calls(str(tmp_path))
    assert sorted(asked) == sorted({*(f"w{i}" for i in range(20)), "nina"}) and ("nina", "name", "high") in first and len(first) == 21


def test_a_lost_task_goes_on_where_it_stopped(spark, tmp_path):
    """The second half of the batches fails at first: only those are asked again."""
    words = spark.createDataFrame([("a",), ("b",), ("bad",), ("c",)], "word string").coalesce(1)

    class Mending(counting()):
        attempts = 1

    run = lambda a: sorted(tuple(r) for r in answers.asked_once(words, a, str(tmp_path / "kept"), "tag", wait=lambda s: None).collect())
    broken = run(Mending(str(tmp_path)))
    assert ("bad", None) in broken
    before = calls(str(tmp_path))
    run(Mending(str(tmp_path)))
    again = calls(str(tmp_path))
    for w in before:
        assert again.count(w) == (2 if any(x[0] == w and x[1] is None for x in broken) else 1)


def test_several_batches_at_a_time(spark, tmp_path):
    words = spark.createDataFrame([(f"w{i:02}",) for i in range(40)], "word string")

    class One(counting()):
        batch = 1

    began = time.time()
    part = answers.asked_once(words.coalesce(1), One(str(tmp_path)), str(tmp_path / "kept"), "tag")
    assert part.count() == 40
    assert time.time() - began < 40 * 0.2  # one by one it would take that on each core alone


def test_assessed_rows(spark, tmp_path):
    rows = spark.createDataFrame([("nina", "tier_3_common"), ("owl", "tier_1_hard_usable"), ("owl", "tier_3_common"), ("fine", "tier_1_hard_usable")], "word string, tier string")
    got = answers.assessed(rows, counting()(str(tmp_path)), str(tmp_path / "kept"))
    assert sorted(tuple(r) for r in got.collect()) == [("fine", "tier_1_hard_usable"), ("owl", "tier_3_common")]
