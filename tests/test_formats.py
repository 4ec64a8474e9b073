"""The data sources: batch and stream, archives in parts, broken members, workbooks made here."""

import os
import time
import zipfile

import pytest

from wordtide.sources import files, formats

SRT = "1\n00:00:01,000 --> 00:00:02,000\nHello <i>you</i>\nand me\n\n2\n00:00:03,000 --> 00:00:04,000\nBye &amp; bye\n\n3\n00:00:05,000 --> 00:00:06,000\n\n"
VTT = "﻿WEBVTT\n\nNOTE not said\n\nid-1\n01:02.500 --> 01:03.000 align:start\n<c.a>One</c>\n2\n00:01:04.000 --> 00:01:05.000\nTwo\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.srt").write_bytes(SRT.encode() + b"\xff")
    (tmp_path / "two.vtt").write_text(VTT, encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "three.zip", "w") as z:
        z.writestr("readme.txt", "x")
        for i in range(5):
            z.writestr(f"m{i}.srt", SRT.replace("Hello", f"Hello{i}"))
    raw = bytearray((tmp_path / "three.zip").read_bytes())
    at = raw.find(b"Hello3")
    raw[at : at + 6] = b"hello3"  # its checksum is wrong now
    (tmp_path / "three.zip").write_bytes(raw)
    (tmp_path / "four.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "five.zip", "w") as z:
        z.writestr("readme.txt", "x")
    return str(tmp_path)


def test_cues_and_errors(spark, folder):
    formats.register(spark)
    df = spark.read.format("subtitles").option("members", 2).load(folder)
    assert df.rdd.getNumPartitions() == 2 + 3 + 1 + 1  # files, an archive in three parts, two unreadable ones
    got = {}
    for r in df.collect():
        got.setdefault((os.path.basename(r["path"]), r["member"]), []).append((r["number"], r["start"], r["end"], r["body"], r["error"]))
    assert got["one.srt", None] == [(1, "00:00:01,000", "00:00:02,000", "Hello you\nand me", None), (2, "00:00:03,000", "00:00:04,000", "Bye & bye", None)]
    assert got["two.vtt", None] == [(1, "00:01:02,500", "00:01:03,000", "One", None), (2, "00:01:04,000", "00:01:05,000", "Two", None)]
    assert [len(got["three.zip", f"m{i}.srt"]) for i in (0, 1, 2, 4)] == [2] * 4
    assert "unreadable member" in got["three.zip", "m3.srt"][0][4] and "unreadable archive" in got["four.zip", None][0][4] and "no .srt" in got["five.zip", None][0][4]
    texts = spark.read.format("subtitles").option("unit", "text").option("first", "true").load(folder).where("error IS NULL").collect()
    assert sorted((os.path.basename(r["path"]), r["member"]) for r in texts) == [("one.srt", None), ("three.zip", "m0.srt"), ("two.vtt", None)]
    assert next(r["content"] for r in texts if r["member"] is None and r["path"].endswith("one.srt")) == SRT


def test_empty_folder(spark, tmp_path):
    formats.register(spark)
    assert spark.read.format("subtitles").load(str(tmp_path)).count() == 0 and spark.read.format("workbook").load(str(tmp_path)).count() == 0


def test_stream_goes_on_from_its_checkpoint(spark, folder, tmp_path_factory):
    formats.register(spark)
    out, mark = (str(tmp_path_factory.mktemp(x)) for x in ("out", "mark"))

    def run():
        stream = spark.readStream.format("subtitles").option("settle", 0).load(folder).where("error IS NULL")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(formats.CUES).parquet(out).count()

    assert run() == 2 + 2 + 8
    assert run() == 12
    time.sleep(0.02)
    with open(f"{folder}/late.srt", "w") as f:
        f.write(SRT)
    assert run() == 14


def workbook(path, rows, shared=True):
    """A workbook of one sheet, with shared or inline strings."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings: list[str] = []

    def cell(at, v):
        if v is None:
            return ""
        if isinstance(v, int):
            return f'<c r="{at}"><v>{v}</v></c>'
        if not shared:
            return f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
        strings.append(v)
        return f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'

    sheet = "".join(f'<row r="{i}">' + "".join(cell(f"{'ABC'[k]}{i}", v) for k, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Words" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            half = lambda s: f"<si><r><t>{s[:2]}</t></r><r><t xml:space='preserve'>{s[2:]}</t></r></si>" if len(s) > 2 else f"<si><t>{s}</t><rPh><t>hint</t></rPh></si>"
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(map(half, strings))}</sst>")


def test_workbooks(spark, tmp_path):
    rows = [("word", "level", "n"), ("Bank ", "B1", 3), ("bank", "A2", None), (None, "C1", 1), ("bank", "C2", 7), ("run", "A1", None), ("ab", "B2", None)]
    for name, shared in (("x.xlsx", True), ("y.xlsx", False)):
        workbook(tmp_path / name, rows, shared)
        cells = {r["row"]: r["cells"] for r in spark.read.format("workbook").load(str(tmp_path / name)).collect()} if formats.register(spark) is None else {}
        assert cells[2] == ["Bank ", "B1", "3"] and cells[4] == [None, "C1", "1"] and cells[6] == ["run", "A1"]
        for highest, level in ((False, "A2"), (True, "C2")):
            got = {r["word"]: r["level"] for r in files.levels(spark, str(tmp_path / name), highest).collect()}
            assert got == {"bank": level, "run": "A1", "ab": "B2"}
    (tmp_path / "z.xlsx").write_bytes(b"none")
    assert spark.read.format("workbook").load(str(tmp_path)).where("error IS NOT NULL").count() == 1
    with pytest.raises(ValueError, match="unreadable workbook"):
        files.levels(spark, str(tmp_path / "z.xlsx"))
