"""Readers, writers and streams over small files."""

import datetime as dt
import zipfile

from wordtide.functions import fixed
from wordtide.sinks import tables
from wordtide.sources import files
from wordtide.streaming import activity


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_subtitles_and_archives(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.srt").write_bytes(b"1\nHel\xfflo\n")
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("ep.srt", "text")
    assert rows(files.subtitles(spark, str(tmp_path)), "content") == [("1\nHello\n",)]
    assert rows(files.zipped_subtitles(spark, str(tmp_path)), "content") == [("text",)]


def test_word_lists_and_frequencies(spark, tmp_path):
    (tmp_path / "easy_words.csv").write_text("word\nCats\n")
    (tmp_path / "oxford.csv").write_text("word\nhouse\n")
    assert rows(files.word_lists(spark, str(tmp_path)), "word", "filter_class") == [("cat", "easy"), ("cats", "easy"), ("house", "oxford")]
    assert rows(files.word_lists(spark, str(tmp_path), without_oxford=True), "word") == [("cat",), ("cats",)]
    (tmp_path / "u").mkdir()
    (tmp_path / "u/f.csv").write_text("word,count\ncat,1\ncats,5\ncat,3\nflies,2395433165\n")
    assert rows(files.english_frequencies(spark, str(tmp_path / "u")), "word", "english_frequency") == [("cat", 8), ("cats", 5), ("flies", 2395433165), ("fly", 2395433165)]


def test_vtt(spark):
    vtt = "WEBVTT\nKind: captions\n\n00:01.500 --> 00:02.000 align:start\n<c>Tom &amp;</c> co\n\nNOTE x\n\n00:00:03.000 --> 00:00:04.000\n<00:00:03.100>two\nlines\n"
    got = files.vtt_cues(spark.createDataFrame([("p", vtt)], "path string, content string"))
    assert rows(got, "number", "start", "end", "body") == [(1, "00:00:01,500", "00:00:02,000", "Tom &amp; co"), (2, "00:00:03,000", "00:00:04,000", "two\nlines")]


def test_tiers_round_trip(spark, tmp_path):
    t = fixed.TIERS
    df = spark.createDataFrame([(t[0], "w", 3, 7, "C1", None), (t[3], "r", 1, 9, "B1", None), (t[4], "e", 5, 1, "A1", "Easy word (easy_words.csv)")], "tier string, word string, n long, english_frequency long, vocabulary_level string, filter_reason string")
    tables.write_tiers(df, str(tmp_path / "t"))
    assert rows(files.tier_table(spark, str(tmp_path / "t")), "word", "series_frequency", "filter_reason") == sorted([("w", 3, None), ("r", 1, None), ("e", 5, "Easy word (easy_words.csv)")])
    tables.write_rare(df, str(tmp_path / "r"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "r")), "word", "rare") == [("r", "rare_b")]
    left, gone = tables.rewritten(df, spark.createDataFrame([("W",)], "word string"))
    assert gone == 1 and left.count() == 2


def test_captions(spark):
    tracks = spark.createDataFrame([("v", "en", True, True), ("v", "de", False, False), ("u", "en", False, True), ("u", "en", True, True)], "video string, language string, automatic boolean, preferred boolean")
    assert rows(files.chosen_caption(tracks), "video", "language", "automatic") == [("u", "en", False), ("v", "en", True)]


def test_streams(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    data = [(i, day + dt.timedelta(hours=9 * i), i % 2, "click", 1.0, '{"k":1}') for i in range(12)]
    spark.createDataFrame(data, activity.EVENTS).write.parquet(str(tmp_path / "in"))
    stream = activity.events(spark, str(tmp_path / "in"))
    for name, df, mode in (("counted", activity.counters(stream), "complete"), ("days", activity.daily(stream), "append"), ("ring", activity.recent(stream, 3), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(spark.table("counted"), "user_id", "n") == [(0, 6), (1, 6)]
    assert rows(spark.table("ring"), "user_id", "recent") == [(0, "[6, 8, 10]"), (1, "[7, 9, 11]")]
    assert (dt.date(2024, 1, 1), "click", 3) in rows(spark.table("days"), "day", "event_type", "n")
