"""Scalar functions against hand-made values."""

import pytest
from pyspark.sql import functions as F

from wordtide.functions import python, text


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def one(spark, column, given):
    return values(spark, [(given,)], "s string", column(F.col("s")))[0]


SRT = "1\n00:00:01,000 --> 00:00:02,000\n<b>Hello</b> [door] there, don't go!\n\n2\n00:00:03,000 --> 00:00:04,500\nThe boxes' café\n"


def test_words_drop_timing_tags_brackets_and_inner_apostrophes(spark):
    assert one(spark, text.words, SRT) == ["hello", "there", "go", "the", "boxes"]


def test_plain_text(spark):
    assert one(spark, text.plain_text, SRT) == "Hello there, don't go! The boxes' café"


def test_cue_lines(spark):
    assert [c["line"] for c in one(spark, text.cue_lines, SRT)] == ["Hello there, don't go!", "The boxes' café"]


@pytest.mark.parametrize("word,want", [("cat", "cat"), ("cats", "cat"), ("flies", "fly"), ("ties", "tie"), ("boxes", "box"), ("wishes", "wish"), ("wolves", "wolf"), ("glass", "glass"), ("bus", "bus"), ("virus", "virus"), ("this", "this"), ("gas", "gas")])
def test_singular(spark, word, want):
    assert one(spark, text.singular, word) == want


@pytest.mark.parametrize("word,want", [("ties", "ty"), ("boxes", "box"), ("churches", "churches"), ("knives", "knif"), ("cats", "cat"), ("s", "s")])
def test_singular_for_levels(spark, word, want):
    assert one(spark, text.singular_for_levels, word) == want


@pytest.mark.parametrize(
    "stem,want",
    [
        ("game.of.thrones.S02E02.720p", ("Game Of Thrones", "S02", "E02")),
        ("The.Wire.2002.s1e10", ("The Wire", "S01", "E10")),
        ("x-ray_s1e1", ("X-Ray", "S01", "E01")),
        ("movie", ("Movie", None, None)),
    ],
)
def test_series_info(spark, stem, want):
    assert tuple(one(spark, text.series_info, stem)) == want


@pytest.mark.parametrize("name,want", [("show.S01E04.srt", True), ("show_s1_e4", False), ("show.1x04", True), ("show.s1e40", False), ("show s01e4", True), (None, False)])
def test_has_season_episode(spark, name, want):
    assert one(spark, lambda s: text.has_season_episode(s, 1, 4), name) is want


def test_media_intent(spark):
    rows = [("Dune 2021",), ("Fargo season 2",), ("Fargo s2e3",), ("Fargo",), (None,)]
    assert values(spark, rows, "s string", text.media_intent(F.col("s"))) == ["movie", "tv", "tv", "ambiguous", "ambiguous"]


def test_titles_and_slugs(spark):
    assert one(spark, text.normal_title, "  Spider-Man: No  Way! ") == "spider man no way"
    assert one(spark, text.slug, "Game of - Thrones!") == "game_of_thrones"
    assert one(spark, text.slug, "!!!") == "series"
    assert one(spark, text.youtube_id, "see https://www.youtube.com/watch?v=abc_DEF-123&t=1") == "abc_DEF-123"
    assert one(spark, text.youtube_id, None) == ""
    assert one(spark, text.title_case, "b2b it's") == "B2B It'S"


def test_small_formats(spark):
    assert one(spark, text.srt_timestamp, "01:02.345") == "00:01:02,345"
    assert one(spark, text.ellipsis, "a\nb " * 40).endswith("...")
    back = one(spark, lambda s: text.from_base64url(text.base64url(s)), "a?b>c~")
    assert back == "a?b>c~"
    assert one(spark, text.base64url, "a?b>c~d") == "YT9iPmN-ZA"
    assert values(spark, [(5,), (65,), (7300,), (200000,)], "s long", text.span(F.col("s"))) == ["5s", "1m 5s", "2h 1m", "2d 7h"]
    assert values(spark, [("7",), ("7.0",), ("7.5",), ("11",), ("true",), (None,)], "s string", text.whole_score(F.col("s"))) == [7, 7, None, None, None, None]
    assert one(spark, text.unfenced, "```json\n{}\n```") == "{}"
    assert one(spark, text.imdb_number, "tt0123") == 123


def test_match_score(spark):
    rows = [("game of thrones", "Game.of.Thrones.S01", "x", 1.0), ("a b c d", "zzz a", "", 0.25 * 0.3), ("", "x", "", 0.0)]
    got = values(spark, rows, "q string, f string, r string, w double", text.match_score(F.col("q"), F.col("f"), F.col("r")) - F.col("w"))
    assert got == pytest.approx([0, 0, 0])


def test_python_functions(spark):
    assert one(spark, python.html_unescaped, "a &amp; b &eacute;") == "a & b é"
    got = values(spark, [("tide", "diet"), ("diet", "tide"), ("", "x")], "a string, b string", python.sequence_ratio(F.col("a"), F.col("b")))
    assert got == [0.25, 0.5, 0.0]
    assert one(spark, lambda s: python.message_chunks(s, 5), "ab\ncdefghij\nk") == ["ab\n", "cdefg", "hij\nk"]
    assert one(spark, lambda s: python.message_chunks(s, 5), "") == []


def test_base64url_of_long_texts(spark):
    import base64

    given = [None, "", *("é?>" * k + "x" * (k % 3) for k in range(1, 60)), "a" * 57, "a" * 58]
    link = text.base64url(F.col("t"))
    rows = spark.createDataFrame([(x,) for x in given], "t string").select("t", link.alias("link"), text.from_base64url(link).alias("back")).collect()
    for r in rows:
        assert r["back"] == r["t"] and r["link"] == (r["t"] if r["t"] is None else base64.urlsafe_b64encode(r["t"].encode()).decode().rstrip("="))


def test_release_names_run_each_step_once(spark):
    from wordtide.functions import names

    files = ["/z/Fallout.S02E03.720p.WEB-DL.x264-GRP.srt", "the boys and friends season 1 episode 12.srt", "game.of.thrones.s1e2.srt", "my.show.2020.BluRay.srt", "", None]
    df = spark.createDataFrame([(x,) for x in files], "f string").select(names.release_info(F.col("f")).alias("i"))
    got = [tuple(r) for r in df.select("i.*").collect()]
    assert got[0] == ("Fallout", 2, 3) and got[1] == ("Friends", 1, 12) and got[2] == ("Game of Thrones", 1, 2) and got[3] == ("My Show", None, None)
    assert got[4][0] is None and got[5][0] is None
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("bluray") + plan.count("BluRay") == 1
