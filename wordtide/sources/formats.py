"""Data sources for subtitles, zipped subtitles and workbooks: ``spark.read.format(...)`` and ``spark.readStream.format(...)``.

``register`` makes the formats known to a session.  Paths are folders or files that pyarrow's file systems open on every
machine.  Files, and parts of the members of an archive, are the partitions; a file or member that can't be read
gives a row that says why, not a failed job.
"""

from __future__ import annotations

import html
import re
import time
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CUES = "path string, member string, number int, start string, end string, body string, error string"
TEXTS = "path string, member string, content string, error string"
CELLS = "path string, sheet string, row long, cells array<string>, error string"
#: Rows that a reader passes on at once.
BATCH = 2000
TIMING = re.compile(r"^\s*((?:\d+:)?\d+:\d+[.,]\d+)\s*-->\s*((?:\d+:)?\d+:\d+[.,]\d+)")


# ------------------------------------------------------------------ files


def opened(path: str):
    return pafs.FileSystem.from_uri(path) if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", path) else (pafs.LocalFileSystem(), path)


def listing(path: str, suffixes: tuple[str, ...]) -> list[tuple[int, str]]:
    """Time of change (ns) and path of all files below ``path``, or of the file itself, that end in one of ``suffixes``."""
    system, at = opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((f.mtime_ns or 0, prefix + f.path) for f in found if f.type == pafs.FileType.File and f.path.endswith(suffixes))


def stream_of(path: str):
    system, at = opened(path)
    return system.open_input_file(at)


# ------------------------------------------------------------------ subtitles


def srt_time(t: str) -> str:
    """``HH:MM:SS,mmm`` of a time with or without hours, with a point or a comma."""
    t = t.replace(".", ",")
    return t if t.count(":") > 1 else f"00:{t}"


def cues(content: str) -> Iterator[tuple[int, str, str, str]]:
    """Number from 1, start, end and text of every cue of SRT or WebVTT ``content``; cues without text go."""
    number = 0
    start = end = None
    lines: list[str] = []

    def done():
        nonlocal number
        body = "\n".join(x for x in lines if x)
        if start is not None and body:
            number += 1
            yield number, srt_time(start), srt_time(end), body

    for line in content.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if timing := TIMING.match(line):
            if start is not None and lines and lines[-1].isdigit():  # the next cue's number without an empty line before it
                lines.pop()
            yield from done()
            start, end, lines = *timing.groups(), []
        elif not line.strip():
            yield from done()
            start, lines = None, []
        elif start is not None:
            lines.append(html.unescape(re.sub(r"<[^>]+>", "", line)).strip())
    yield from done()


class Part(InputPartition):
    """A file, or some members of an archive."""

    def __init__(self, path: str, members: list[str] | None = None, error: str | None = None) -> None:
        self.path, self.members, self.error = path, members, error


class SubtitleRows:
    """What batch and stream readers have in common. Options: ``path``; ``unit`` (``cue`` or ``text``); ``members`` (of an archive in
    one partition, 100); ``first``: of an archive the first member ending in .srt alone, none is an error."""

    SUFFIXES = (".srt", ".vtt", ".zip")

    def __init__(self, options: dict) -> None:
        self.path, self.unit = options["path"], options.get("unit", "cue")
        self.members, self.first = int(options.get("members", 100)), options.get("first", "false").lower() == "true"

    def parts(self, paths: list[str]) -> list[Part]:
        out = []
        for path in paths:
            if not path.endswith(".zip"):
                out.append(Part(path))
                continue
            try:
                with zipfile.ZipFile(stream_of(path)) as z:
                    names = [n for n in z.namelist() if n.endswith((".srt",) if self.first else self.SUFFIXES[:2])]
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                out.append(Part(path, error=f"unreadable archive: {e}"))
                continue
            names = names[:1] if self.first else names
            if not names:
                out.append(Part(path, error="no .srt file in the archive"))
            out += [Part(path, names[i : i + self.members]) for i in range(0, len(names), self.members)]
        return out

    def contents(self, part: Part) -> Iterator[tuple[str | None, str | None, str | None]]:
        """Member, text and error; bytes that are no UTF-8 are dropped."""
        if part.error:
            yield None, None, part.error
        elif part.members is None:
            try:
                with stream_of(part.path) as f:
                    yield None, f.read().decode("utf-8", "ignore"), None
            except (OSError, ValueError) as e:
                yield None, None, f"unreadable file: {e}"
        else:
            with zipfile.ZipFile(stream_of(part.path)) as z:
                for name in part.members:
                    try:
                        yield name, z.read(name).decode("utf-8", "ignore"), None
                    except Exception as e:  # noqa: BLE001  a broken member of any kind is reported, the others are read
                        yield name, None, f"unreadable member: {e}"

    def rows(self, part: Part) -> Iterator[tuple]:
        for member, content, error in self.contents(part):
            if self.unit == "text":
                yield part.path, member, content, error
            elif error:
                yield part.path, member, None, None, None, None, error
            else:
                for cue in cues(content):
                    yield part.path, member, *cue, None


class SubtitleReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.own = SubtitleRows(options)

    def partitions(self) -> list[Part]:
        return self.own.parts([p for _, p in listing(self.own.path, self.own.SUFFIXES)]) or [Part("", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.own.rows(partition) if partition.path else iter(())


class SubtitleStream(DataSourceStreamReader):
    """Files in order of their time of change, then path; the offset is the last one read. Option ``settle`` (seconds, 2): files changed
    later than that long ago wait, so that none is overtaken by one of the same time."""

    def __init__(self, options: dict) -> None:
        self.own, self.settle = SubtitleRows(options), float(options.get("settle", 2))

    def initialOffset(self) -> dict:
        return {"mtime": 0, "path": ""}

    def _settled(self) -> list[tuple[int, str]]:
        until = time.time_ns() - int(self.settle * 1e9)
        return [f for f in listing(self.own.path, self.own.SUFFIXES) if f[0] <= until]

    def latestOffset(self) -> dict:
        mtime, path = max(self._settled(), default=(0, ""))
        return {"mtime": mtime, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = ((x["mtime"], x["path"]) for x in (start, end))
        return self.own.parts([p for m, p in listing(self.own.path, self.own.SUFFIXES) if low < (m, p) <= high])

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.own.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Subtitles(DataSource):
    """Format ``subtitles``: the cues (or whole texts) of .srt, .vtt and .zip files below a path."""

    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return TEXTS if self.options.get("unit") == "text" else CUES

    def reader(self, schema) -> SubtitleReader:
        return SubtitleReader(dict(self.options))

    def streamReader(self, schema) -> SubtitleStream:
        return SubtitleStream(dict(self.options))


# ------------------------------------------------------------------ workbooks

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets_of(z: zipfile.ZipFile) -> dict[str, str]:
    """Name and member of a workbook's sheets, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): (t.lstrip("/") if (t := targets[s.get(LINK)]).startswith("/") else f"xl/{t}") for s in found}


def text_of(element) -> str:
    """The text of a shared or inline string, whole or in runs; phonetic hints are none of it."""
    parts = [t for child in element if child.tag != f"{MAIN}rPh" for t in ([child] if child.tag == f"{MAIN}t" else child.iter(f"{MAIN}t"))]
    return "".join(t.text or "" for t in parts)


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{MAIN}si":
                out.append(text_of(e))
                e.clear()
    return out


def column_of(reference: str) -> int:
    """Number from 0 of a cell's column, as in ``AB12``."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(z: zipfile.ZipFile, member: str, strings: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """Number and cells of every row, read as the XML comes in."""
    with z.open(member) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag != f"{MAIN}row":
                continue
            cells: list[str | None] = []
            for i, c in enumerate(e.iter(f"{MAIN}c")):
                at = column_of(c.get("r")) if c.get("r") else i
                cells += [None] * (at + 1 - len(cells))
                kind, value = c.get("t"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    inline = c.find(f"{MAIN}is")
                    cells[at] = text_of(inline) if inline is not None else None
                elif value is not None:
                    cells[at] = strings[int(value.text)] if kind == "s" else value.text
            yield int(e.get("r") or 0), cells
            e.clear()


class WorkbookReader(DataSourceReader):
    """A partition for each sheet; the shared strings of its workbook are held by the task. Option ``sheet``: that one only, ``first``: each
    workbook's first."""

    def __init__(self, options: dict) -> None:
        self.path, self.sheet, self.first = options["path"], options.get("sheet"), options.get("first", "false").lower() == "true"

    def partitions(self) -> list[Part]:
        out = []
        for _, path in listing(self.path, (".xlsx",)):
            try:
                with zipfile.ZipFile(stream_of(path)) as z:
                    names = [n for n in sheets_of(z) if self.sheet in (None, n)]
                out += [Part(path, [n]) for n in (names[:1] if self.first else names)]
            except (OSError, KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                out.append(Part(path, error=f"unreadable workbook: {e}"))
        return out or [Part("", [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
        made = lambda rows: pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)
        held: list[tuple] = []
        if partition.error:
            held.append((partition.path, None, None, None, partition.error))
        for sheet in partition.members or ():
            with zipfile.ZipFile(stream_of(partition.path)) as z:
                try:
                    for row, cells in sheet_rows(z, sheets_of(z)[sheet], shared_strings(z)):
                        held.append((partition.path, sheet, row, cells, None))
                        if len(held) >= BATCH:
                            yield made(held)
                            held = []
                except (KeyError, IndexError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    held.append((partition.path, sheet, None, None, f"unreadable sheet: {e!r}"))
        if held:
            yield made(held)


class Workbooks(DataSource):
    """Format ``workbook``: the rows of the sheets of .xlsx files below a path, as text."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    for source in (Subtitles, Workbooks):
        spark.dataSource.register(source)

