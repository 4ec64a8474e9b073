"""Word counts, roll-ups and order-statistic thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.python import Tokens, singular_form, token_slices


def doc_words(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, pos, word: every word of every document, as written."""
    return docs.select("doc_id", "source", "lang", F.posexplode(text.words("text")).alias("pos", "word"))


def doc_lemmas(docs: DataFrame) -> DataFrame:
    """As ``doc_words`` with singular forms."""
    return doc_words(docs).withColumn("word", text.singular(F.col("word")))


def word_counts(words: DataFrame, *keys: str) -> DataFrame:
    """n and first position of each word within ``keys``."""
    return words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def doc_counts(docs: DataFrame, singular: bool = True) -> DataFrame:
    """doc_id, source, word, n, english (n in English documents): the one pass over the texts that counts, frequencies and
    thresholds are derived from.  Words are counted within their document's row, without a shuffle; a doc_id of several rows has
    rows of its own for each."""

    def count(batches):
        for batch in token_slices(batches, 3):
            tokens = Tokens(batch.column(3)).renamed(singular_form) if singular else Tokens(batch.column(3))
            first, _, n = tokens.counted(tokens.starts(1), 1)
            row = pa.array(tokens.row[first])
            english = np.where(np.array(pc.fill_null(pc.equal(batch.column(2), "en"), False).to_pylist(), bool)[tokens.row[first]], n, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), tokens.words.take(pa.array(tokens.code[first])), pa.array(n), pa.array(english)], ["doc_id", "source", "word", "n", "english"])

    given = docs.select("doc_id", "source", F.col("lang").cast("string").alias("lang"), text.words("text").alias("words"))
    kinds = dict(given.dtypes)
    return given.mapInArrow(count, f"doc_id {kinds['doc_id']}, source {kinds['source']}, word string, n long, english long")


def repeated_ids(docs: DataFrame) -> DataFrame:
    """Ids of several documents."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")


def by_document(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, word, n of ``doc_counts``; rows are put together only where a doc_id has several documents."""
    return counts.select("doc_id", "word", "n") if repeated_ids(docs).isEmpty() else summed(counts, "doc_id")


def ranked_words(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, word, n, first_pos, place, total: singular forms of a document by frequency, ties by first occurrence; ``total`` is their
    number, ``most`` shows the first places alone.

    Words are counted and ranked within their document's row, without a shuffle; only where a doc_id has several rows, these are put together.
    """

    def rank(batches, most):
        for batch in token_slices(batches, 1):
            tokens = Tokens(batch.column(1)).renamed(singular_form)
            first, _, n = tokens.counted(tokens.starts(1), 1)
            order = np.lexsort((first, -n, tokens.row[first]))
            first, n = first[order], n[order]
            row = tokens.row[first]
            opens, sizes = np.searchsorted(row, row), np.bincount(row, minlength=len(batch))[row]
            place = np.arange(len(row)) - opens + 1
            shown = np.flatnonzero(place <= most) if most else np.arange(len(row))
            pos, word = first - np.searchsorted(tokens.row, row), tokens.words.take(pa.array(tokens.code[first[shown]]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[shown])), word, *(pa.array(x[shown].astype(t)) for x, t in ((n, np.int64), (pos, np.int64), (place, np.int32), (sizes, np.int64)))], ["doc_id", "word", "n", "first_pos", "place", "total"])

    given = docs.select("doc_id", text.words("text").alias("words"))
    shape = f"doc_id {dict(given.dtypes)['doc_id']}, word string, n long, first_pos long, place int, total long"
    if repeated_ids(docs).isEmpty():
        return given.mapInArrow(lambda batches: rank(batches, most), shape)
    counts = given.mapInArrow(lambda batches: rank(batches, None), shape).groupBy("doc_id", "word").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    own = W.partitionBy("doc_id")
    out = counts.withColumn("place", F.row_number().over(own.orderBy(F.desc("n"), "first_pos"))).withColumn("total", F.count(F.lit(1)).over(own))
    return out.where(F.col("place") <= most) if most else out


def summed(counts: DataFrame, *keys: str) -> DataFrame:
    """n of each word within ``keys``, from ``doc_counts``."""
    return counts.groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def english_counts(counts: DataFrame) -> DataFrame:
    """word, english_frequency over all English documents, from ``doc_counts``."""
    return counts.where("english > 0").groupBy("word").agg(F.sum("english").alias("english_frequency"))


def order_statistics(rows: DataFrame, *keys: str, **values) -> DataFrame:
    """For each of ``values`` (name=column) of a group the threshold v[min(2n div 3, n - 1)] (``name_threshold``) and the
    upper median v[n div 2] (``name_median``); nulls are left out, and a group of none gives 1.

    Equal values are counted first; running sums over a group's distinct values find the places, so no group is collected.
    """
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("long").alias("value")) for k, v in values.items()))).alias("one")
    counts = rows.select(*keys, one).select(*keys, "one.*").groupBy(*keys, "kind", "value").agg(F.count("value").alias("c")).repartition(*keys)
    own = W.partitionBy(*keys, "kind")
    upto = F.sum("c").over(own.orderBy(F.col("value").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(own))

    def at(kind, i):
        here = (F.col("kind") == kind) & (i >= F.col("upto") - F.col("c")) & (i < F.col("upto"))
        return F.coalesce(F.max(F.when(here, F.col("value"))), F.lit(1).cast("long"))

    third, half = F.least(F.floor(F.col("n") * 2 / 3), F.col("n") - 1), F.floor(F.col("n") / 2)
    return counts.groupBy(*keys).agg(*(at(k, i).alias(f"{k}_{name}") for name, i in (("threshold", third), ("median", half)) for k in values))


def thresholds(counts: DataFrame, *keys: str) -> DataFrame:
    """Series and English thresholds and medians of each group of (keys, word, n, english_frequency)."""
    return order_statistics(counts, *keys, series=F.col("n"), english=F.when(F.col("english_frequency") > 0, F.col("english_frequency")))


def long_enough(words: DataFrame, least: int = fixed.MIN_LENGTH) -> DataFrame:
    return words.where(F.length("word") >= least)


def without(words: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose word is not in ``listed`` (word)."""
    return words.join(listed, "word", "left_anti")
