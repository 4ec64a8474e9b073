"""The corpus pipeline: five stages over ``documents``, each written and read again.

Each stage is (name, function); the function takes (spark, docs, sf_dir), works on all rows
its predecessor kept and returns a DataFrame.  All but the last return the columns of
documents.  Tables between stages live in the shared folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wordtide.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from wordtide.llm.shared import forget_since, stored, tables_written


def aside(stage):
    """``stage`` for documents that have columns of the operators' reserved prefix too: these go by other names in it."""

    @functools.wraps(stage)
    def run_stage(spark, docs, sf_dir):
        names = docs.columns
        own = [f"aside_{'_' * len(names)}{i}" if c.startswith("wordtide_") else c for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*own), sf_dir).select(*(F.col(f"`{c}`").alias(name) for c, name in zip(own, names, strict=True)))

    return run_stage


def drop_toxic(spark, docs, sf_dir):
    """Documents that score ``toxicity.CUT`` or more go; learnt from ``labels`` outside the held-out third."""
    field = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, field)


@aside
def drop_lines(spark, docs, sf_dir):
    """Lines that an earlier document holds too leave the texts; all documents stay."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each class of near duplicates the document of the smallest doc_id stays."""
    classes = jaccard_join.linked_components(docs)
    gone = stored(classes.where("component_id != doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


@aside
def mix(spark, docs, sf_dir):
    """All documents in the order of the mix to ``mixing.WEIGHTS``: the files' order and the rows' order in them."""
    return mixing.mixed_order(docs, mixing.WEIGHTS)


def pack(spark, docs, sf_dir):
    """Pieces in sequences; ``sequence_order`` grows with the place in the mix of a sequence's first document."""
    try:
        file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
        other = (1 << 26) + F.crc32(F.col("_metadata.file_name").cast("binary")) % (1 << 26)  # files of other names follow, in no set order
        order = F.coalesce(file, other) * (1 << 36) + F.col("_metadata.row_index")
        docs = docs.select("doc_id", "text", order.alias("wordtide_order"))
    except AnalysisException:  # not read from files: the order is that of the partitions
        docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("wordtide_order"))
    placed = stored(packing.packed(docs, more=("wordtide_order",)))
    first = placed.groupBy("sequence_id").agg(F.min("wordtide_order").alias("sequence_order"))
    return placed.join(first, "sequence_id").drop("wordtide_order")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: SQL can't express a trained field or a tokeniser; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_written()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        forget_since(before, docs)
    return docs
