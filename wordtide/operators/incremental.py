"""Word counts kept up to date: a changed file's old counts are taken back, its new ones put in their place.

Two versioned tables: ``files`` (path, word, n) and ``totals`` (word, n, files).  A batch touches the rows of its own files and
the totals of their words; a total that comes to nothing goes.  The totals are committed last and carry the number of the
``files`` version that they belong to, so that a run that died in between is made good by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sinks.commits import Versioned


def file_counts(contents: DataFrame) -> DataFrame:
    """path, word, n of texts (path, content); a file without words has one row without a word."""
    words = contents.select("path", F.explode_outer(text.words("content")).alias("word"))
    return words.groupBy("path", "word").agg(F.count("word").alias("n"))


def totals_of(files: DataFrame) -> DataFrame:
    return files.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))


def refreshed(files: Versioned, totals: Versioned, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The totals after the files ``changed`` (path, content; new ones too) and without those ``removed`` (path)."""
    new = file_counts(changed)
    touched = changed.select("path").distinct()
    if removed is not None:
        touched = touched.union(removed.select("path")).distinct()
    before, held = files.read(), totals.read()
    matches = held is not None and held.agg(F.max("of")).first()[0] == files.version()
    if before is None:
        version = files.write(new)
        out = totals_of(new)
    else:
        old = before.join(touched, "path", "left_semi")
        version = files.write(before.join(touched, "path", "left_anti").unionByName(new), files.version())
        if not matches:  # totals of another version: a run died between its two commits
            out = totals_of(files.read(version))
        else:
            signed = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1))).where("word IS NOT NULL")
            delta = signed.groupBy("word").agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum("sign").cast("long").alias("files"))
            both = held.drop("of").unionByName(delta).groupBy("word").agg(F.sum("n").alias("n"), F.sum("files").alias("files"))
            out = both.where("files > 0")
    totals.write(out.withColumn("of", F.lit(version)))
    return totals.read().drop("of")
