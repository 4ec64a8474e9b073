"""The further queries against their SQL, and their operators on hand-made rows."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from wordtide.annotate import base
from wordtide.functions import fixed, names
from wordtide.operators import phrases, reports, tags
from wordtide.plans import catalogue, more, pipelines  # noqa: F401
from wordtide.sinks import tables
from wordtide.sources import files
from wordtide.streaming import activity

DATA = "/root/testdata/sf0.001"
MORE = sorted(k for k, f in catalogue.QUERIES.items() if f.__module__.endswith(".more"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are needed")
@pytest.mark.parametrize("name", MORE)
def test_query(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def put(df):
        df = df[columns].astype(object)
        return sorted(str(x).replace(".0,", ",").replace(".0)", ")") for x in df.where(df.notna(), None).itertuples(index=False, name=None))

    assert put(got) == put(want)


def one(spark, column, *given):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    return [tuple(r["o"]) for r in df.select("i", column(F.col("x")).alias("o")).orderBy("i").collect()]


def test_typed_and_file_names(spark):
    got = one(spark, names.series_input, "Breaking Bad S01E05", "fallout s2 e3", "game of thrones ep 2 season 3", "Dark, season 1 episode 4", "", None, "x-ray files")
    assert got == [("Breaking Bad", 1, 5), ("Fallout", 2, 3), ("Game Of Thrones", 3, 2), ("Dark", 1, 4), ("Unknown", 1, 1), ("Unknown", 1, 1), ("X-Ray Files", 1, 1)]
    assert one(spark, names.movie_input, "Dune (2021)", "the matrix 1999", "Up", "2012") == [("Dune", 2021), ("The Matrix", 1999), ("Up", 0), ("Unknown", 2012)]
    assert one(spark, names.movie_info, "/s/Movies/Inception/Inception_2010.srt", "a/the_thing_1982.srt", "noir.srt") == [("Inception", "2010"), ("The Thing", "1982"), ("Noir", None)]
    assert one(spark, names.video_info, "/s/YouTube/My Talk/talk_abcDEF123.srt", "x.srt") == [("My Talk", "abcDEF123"), ("X", None)]
    assert one(spark, names.release_info, "Game.of.Thrones.S02E05.1080p.BluRay.srt", "some.show.2019.s1e2.HDTV.x264-LOL.srt", "Odd Season 3 Episode 9.srt")[::2] == [("Game of Thrones", 2, 5), ("Odd", 3, 9)]


def test_tags(spark):
    df = spark.createDataFrame([("Ann", True, "normal word", False, 5), ("bo", False, "name/fantasy entity", False, 5), ("zz", False, "normal word", False, 0), ("ok", False, "normal word", False, 9), ("q", False, "odd", True, 9), ("r", False, None, True, 9), ("s", False, None, False, 0), ("t", False, "", False, 9)], "w string, l boolean, t string, e boolean, f long")
    got = [r[0] for r in df.select(tags.name_tag(F.col("w"), F.col("l"), F.col("t"), F.col("e"), F.col("f"))).collect()]
    assert got == ["name/fantasy entity (name filter: Ann)", "name/fantasy entity (ChatGPT: name/fantasy entity)", "name/fantasy entity (zero frequency - likely proper noun)", "normal word", "name/fantasy entity (ChatGPT: odd)", "name/fantasy entity (ChatGPT: no tag provided)", "name/fantasy entity (zero frequency - likely proper noun)", ""]
    more_rows = spark.createDataFrame([("waaay", "", "N/A", 5), ("cat", "normal word", "A1", 5), ("the", "", "N/A", 3_000_000), ("abcd", "", "B1", 2_500_000), ("bo", "name/fantasy entity (x)", "A1", 5)], "w string, t string, l string, f long")
    got = [r[0] for r in more_rows.select(tags.simple_tag(F.col("w"), F.col("t"), F.col("l"), F.lit(False), F.col("f"))).collect()]
    assert got == ["simple word (informal/non-standard spelling)", "simple word (vocabulary level: A1)", "simple word (high frequency: 3,000,000, not in vocabulary list)", "simple word (short word with high frequency: 2,500,000)", "name/fantasy entity (x)"]


def test_three_phrasal_verbs_count_once(spark):
    text = "We had to come up with a plan, put up with it and keep up with them. They wake up."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(rows(phrases.dictionary_counts(docs), "phrase", "n")) == [("come up", 1), ("come up with", 1), ("keep up", 1), ("keep up with", 1), ("put up", 1), ("put up with", 1), ("wake up", 2)]
    assert len(fixed.PHRASAL_VERBS) == 183


def test_phrase_counts_against_loops(spark):
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice("up out a b c with".split()) for _ in range(rng.choice([0, 1, 2, 5, 60, 400]))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = set()
    for i, t in enumerate(texts):
        w = t.split()
        for n in range(3, 7):
            held = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)]
            want |= {(i, p, held.count(p), n) for p in held if held.count(p) >= 2}
    assert {tuple(r) for r in phrases.repeated_ngrams(docs).collect()} == want


def test_reports(spark):
    parts = spark.createDataFrame([("p", "ok", None, None, 4.0), ("p", "ok", True, None, 9.0), ("p", "ok", False, "x", 9.0), ("p", "failed", None, None, 1.0), ("q", "ok", None, None, None)], "part string, status string, skipped boolean, error string, overall_score double")
    assert rows(reports.judge_summary(parts, "part"), "part", "mean_score", "scored", "skipped", "errors") == [("p", 4.0, 1, 1, 1), ("q", None, 0, 0, 0)]
    state = spark.createDataFrame([("2024-01-01", 5), ("2024-01-02", 7)], "date string, new_downloads_today long")
    assert rows(reports.daily_state(state, F.lit("2024-01-02")), "used") == [(0,), (7,)]
    held = spark.createDataFrame([("f", "phrasal_verbs.csv"), ("f", "other"), ("g", "x")], "folder string, file string")
    got = {(r["folder"], r["part"]): r["missing"] for r in reports.missing_parts(held).collect()}
    assert got["f", "phrasal"] == "" and got["g", "frequent_b"] == "tier_b1_words_translations.csv, tier_b2_words_translations.csv"


def test_discovery_and_artefacts(spark, tmp_path):
    for name in ("b/x_s1_e2.srt", "a/x_s1_e2.srt", "c/tier_1_hard_usable_words.csv", "c/y.srt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    listing = files.file_listing(spark, str(tmp_path))
    wanted = spark.createDataFrame([("x_s1_e2.srt", 1, 2), ("unknown.srt", 1, 1), ("none.srt", 1, 1)], "file string, season int, episode int")
    got = rows(files.discovered(listing, wanted), "file", "path")
    assert len(got) == 1 and got[0][1].endswith("/a/x_s1_e2.srt")
    folders = listing.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    found = {r["folder"][-1]: tuple(r)[1:] for r in files.existing_artefacts(listing, folders).collect()}
    assert found["c"] == (True, False, False, True) and found["a"] == (False, False, False, True)
    infos = spark.createDataFrame([("f1", "/s/a.srt"), ("f2", "b.srt")], "folder string, subtitle_file string")
    asked = spark.createDataFrame([("/s/a.srt",), ("/q/b.srt",), ("c.srt",)], "file string")
    assert rows(files.episode_folders(infos, asked), "file", "folder") == [("/q/b.srt", "f2"), ("/s/a.srt", "f1"), ("c.srt", None)]
    tables.write_manifest(listing, str(tmp_path / "m"))
    manifest = spark.read.parquet(str(tmp_path / "m"))
    assert files.changed_files(spark, str(tmp_path / "a"), manifest).count() == 0


def test_sinks(spark, tmp_path):
    words = spark.createDataFrame([("b1", "cat", "Katze", None, 3), ("b1", "dog", "N/A", "A dog.", 5)], "band string, word string, gloss string, example string, n long")
    tables.write_translations(words, str(tmp_path / "t"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "t/lists")), "word", "translation", "example_en") == [("cat", "Katze", None), ("dog", "N/A", "A dog.")]
    assert rows(spark.read.json(str(tmp_path / "t/info")), "words", "translated", "missing") == [(2, 1, 1)]
    state = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "user int, word string, gloss string")
    changes = spark.createDataFrame([(1, "a", "new", False), (1, "b", None, True), (2, "c", "z", None)], "user int, word string, gloss string, deleted boolean")
    assert rows(tables.upserted(state, changes, "user", "word"), "user", "word", "gloss") == [(1, "a", "new"), (2, "c", "z")]
    tables.write_markdown(spark.createDataFrame([("p", 4.256, 3, 1, 0)], "part string, mean_score double, scored long, skipped long, errors long"), str(tmp_path / "md"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()][-1] == "| p | 4.26 | 3 | 1 | 0 |"


def test_annotator_is_asked_again(spark):
    class Half(base.Annotator):
        batch, attempts, pause = 4, 1, (0,)

        def label(self, words):
            return {w: "C" for w in words if len(words) < 3 or w < "c"}

    got = base.annotated_again(spark.createDataFrame([(x,) for x in "abcd"], "word string").coalesce(1), Half(), wait=lambda s: None)
    assert rows(got, "word", "label") == [(x, "C") for x in "abcd"]
    assert rows(base.coerced(got, ("b",), "n/a"), "label") == [("n/a",)] * 4


def test_toggles_and_runs_of_a_stream(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    kinds = ["click", "click", "purchase", "purchase", "click"]
    data = [(i, day + dt.timedelta(seconds=i), 1, k, 1.0, '{"k":1}') for i, k in enumerate(kinds)]
    spark.createDataFrame(data, activity.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = activity.events(spark, str(tmp_path / "in"))
    for name, df in (("toggles", activity.toggled(stream)), ("paired", activity.runs(stream, "click", "purchase"))):
        q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(spark.table("toggles"), "user_id", "action", "saved") == [(1, "1", True)]
    assert rows(spark.table("paired"), "user_id", "us") == [(1, 1_000_000)]


def Answers(answer):  # noqa: N802
    """An annotator by a plain function of the word; a local class is sent to tasks by value."""

    class Plain(base.Annotator):
        batch, attempts, pause = 5, 1, (0,)

        def label(self, words):
            return {w: a for w in words if (a := answer(w)) is not None}

    return Plain()


def test_phrase_pipelines(spark):
    docs = spark.createDataFrame([(1, "We give up now. They never give up at all. He ran zap out here today. The old red barn door fell. An old red barn door stood.")], "doc_id long, text string")
    yes = Answers(lambda w: "yes" if w != "zap out" else None)
    rate = Answers(lambda w: '{"gloss": "stop", "idiomaticity": 8, "literality": 2, "rating": 9}' if w != "old red barn door" else '```json\n{"gloss": "place", "rating": 5}\n```')
    assert rows(pipelines.phrasal_list(docs, yes, rate), "phrase", "n", "gloss", "idiomaticity", "example") == [("give up", 2, "stop", 8, "We give up now")]
    assert rows(pipelines.idiom_list(docs, yes, rate), "phrase", "n", "rating", "example") == [("old red barn door", 2, 5, "The old red barn door fell")]


def test_served_lists_and_plans(spark, tmp_path):
    t = fixed.TIERS
    given = spark.createDataFrame([(t[0], "w", 3, "C1", "g"), (t[5], "b", 9, "B1", "h"), (t[6], "c", 8, "B2", "i"), (t[3], "r", 1, "C2", "j")], "tier string, word string, n long, vocabulary_level string, gloss string")
    saved = spark.createDataFrame([("B", "H")], "word string, gloss string")
    assert rows(pipelines.served_list("frequent_b", given, saved, 1), "place", "word", "total", "truncated", "saved") == [(1, "b", 2, True, True)]
    assert rows(pipelines.served_list("rare_c", given, saved), "word", "truncated") == [("r", False)]
    assert rows(pipelines.without_names(given, Answers(lambda w: "Name" if w == "w" else "word")), "word") == [("b",), ("c",), ("r",)]
    listing = spark.createDataFrame([("/z/some.show.S01E02.srt",), ("/z/notes.srt",), ("/f/tier_1_hard_usable_words.csv",)], "path string")
    assert rows(pipelines.reorganised(listing, "/r"), "target", "action")[0] == ("/f/tier_1_hard_usable_words.csv", "keep")
    assert ("/r/Some Show/Season 1/some.show.S01E02.srt", "move") in rows(pipelines.reorganised(listing, "/r"), "target", "action")
    assert rows(pipelines.stale_folders(listing, spark.createDataFrame([("/f",), ("/z",)], "folder string")), "folder") == [("/f",)]
    lines = spark.createDataFrame([(1, "here w stands alone")], "at int, line string")
    cache = spark.createDataFrame([("b", "known")], "word string, gloss string")
    got = pipelines.glossed_tiers(given.drop("gloss"), lines, cache, Answers(lambda w: w * 2))
    assert rows(got, "word", "gloss", "example") == [("b", "known", None), ("c", "cc", None), ("r", "rr", None), ("w", "ww", "here w stands alone")]
