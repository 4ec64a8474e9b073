"""Tables that are replaced as a whole, with one atomic step: readers see the state before it or after it, never between.

A version is written aside, in a folder of its own; then a commit file of the next number, which holds the folder's name, is
put into place by a rename that fails where the name is taken.  A writer that dies before that leaves a folder
that nobody follows; of two writers that started from one version the second one fails and may start again from the
new version.  Works on every file system that Hadoop reaches and that renames files atomically.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import tiers


class Conflict(RuntimeError):
    """Another writer committed in between."""


class Versioned:
    """A table in ``path``: ``_commits/<number>`` names the folder below ``data`` that is the table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _numbers(self) -> list[int]:
        at = self.fs_path(f"{self.path}/_commits")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _folder(self, number: int) -> str:
        stream = self.fs.open(self.fs_path(f"{self.path}/_commits/{number:012d}"))
        try:
            return f"{self.path}/data/{stream.readUTF()}"
        finally:
            stream.close()

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max(self._numbers(), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as the last commit, or that of ``version``, left it; None before the first."""
        number = version or self.version()
        return self.spark.read.parquet(self._folder(number)) if number else None

    def write(self, rows: DataFrame, since: int | None = None) -> int:
        """``rows`` in place of the table, whose version was ``since`` when they were read; the new version's number."""
        before, name = self.version() if since is None else since, uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        self._commit(before + 1, name)
        return before + 1

    def _commit(self, number: int, name: str) -> None:
        aside = self.fs_path(f"{self.path}/_aside/{name}")
        stream = self.fs.create(aside, True)
        stream.writeUTF(name)
        stream.close()
        self.fs.mkdirs(self.fs_path(f"{self.path}/_commits"))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self.fs_path(f"{self.path}/_commits/{number:012d}"), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number} is there already") from e
            raise

    def change(self, f: Callable[[DataFrame | None], DataFrame], attempts: int = 5) -> int:
        """``f`` of the table in its place; it is called again where another writer was first."""
        for _ in range(attempts - 1):
            since = self.version()
            try:
                return self.write(f(self.read(since) if since else None), since)
            except Conflict:
                continue
        since = self.version()
        return self.write(f(self.read(since) if since else None), since)

    def clean(self, keep: int = 2) -> int:
        """Deletes the folders of all but the last ``keep`` versions, and those that were never committed; how many went. Not while
        a writer is at work."""
        numbers = self._numbers()
        held = {self._folder(n).rsplit("/", 1)[1] for n in numbers[-keep:]}
        gone = 0
        for s in self.fs.listStatus(self.fs_path(f"{self.path}/data")) if numbers else []:
            if s.getPath().getName() not in held:
                gone += self.fs.delete(s.getPath(), True)
        for n in numbers[:-keep]:
            self.fs.delete(self.fs_path(f"{self.path}/_commits/{n:012d}"), False)
        return gone


def without_words(table: Versioned, words: DataFrame) -> int:
    """A tier table without ``words`` of any case; how many rows went, told by the one pass that writes the others."""
    since, seen = table.version(), Observation()
    rows = table.read(since)
    listed = words.select(F.lower("word").alias("gone")).distinct()
    marked = rows.join(listed, F.lower(rows["word"]) == F.col("gone"), "left").observe(seen, F.count("gone").alias("gone"))
    table.write(marked.where("gone IS NULL").drop("gone"), since)
    return seen.get["gone"]


def with_glosses(table: Versioned, glosses: DataFrame, tags: DataFrame) -> int:
    """A tier table with its words' gloss, example and tag, in place of it; columns of these names are replaced. The new version."""

    def augmented(rows):
        own = rows.drop("gloss", "example", "tag")
        out = own.join(glosses.select("word", "gloss", "example"), "word", "left").join(tags.select("word", "tag"), "word", "left")
        return out.fillna("", ["gloss", "example", "tag"])

    return table.change(augmented)


def upsert(table: Versioned, changes: DataFrame, *keys: str) -> int:
    """A keyed state (user dictionaries, link index, monitoring, plans) with ``changes`` in place of the rows of the same keys; one whose
    ``deleted`` is true takes its row away. The new version."""
    new = changes.where("NOT coalesce(deleted, false)").drop("deleted")

    def changed(rows):
        return new if rows is None else rows.join(changes.select(*keys), list(keys), "left_anti").unionByName(new)

    return table.change(changed)


def rare_split(table: Versioned, rows: DataFrame) -> int:
    """The two cuts of tier 4 as one versioned table, so that no reader sees one cut of the new run beside one of the old."""
    return table.write(tiers.rare_split(rows))
