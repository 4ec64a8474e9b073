"""Title resolution: candidates ranked by similarity, and the decision over the best two.

The similarity is Ratcliff and Obershelp's, 2 * matched / (n + m).  No more letters can match than
both titles have in common, so counts of letters bound it.  Titles are put into cells by how many letters
of a few groups they have; the cells' number is small and checked.  A query is bounded against cells,
meets the titles of the best cells first, and then those of all other cells whose bound reaches the last place that
the first ones left; the similarity itself is computed only where the bound of whole letter counts reaches that place too.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text
from ..functions.scratch import stored

#: Groups of letters that tell cells apart, and cells that are sent to tasks; with more, groups are joined.
GROUPS, MOST_CELLS = 8, 100_000
#: Titles that a query meets at least before its last place is known.
FIRST_TITLES = 64


def common_bound(a: dict[str, int], n: int, b: dict[str, int], m: int) -> float:
    """No similarity of two titles of ``n`` and ``m`` letters is above this."""
    return 2 * sum(min(k, b[c]) for c, k in a.items() if c in b) / (n + m) if n and m else 0.0


def group_counts(title, groups: int):
    """Letters of each group; a character's group is its code modulo ``groups``."""
    codes = F.transform(F.filter(F.split(title, ""), lambda c: c != ""), lambda c: F.ascii(c) % groups)
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.size(F.filter(codes, lambda c: c == g)))


class Cells:
    """The cells of all titles: letters by group, and how many titles each holds."""

    def __init__(self, cells: list, groups: int) -> None:
        self.groups = groups
        self.keys = np.array([r["cell"] for r in cells], np.int64).reshape(-1)
        self.letters = np.array([r["letters"] for r in cells], np.int64).reshape(-1, groups)
        self.held = np.array([r["n"] for r in cells], np.int64)

    def bounds(self, letters: np.ndarray) -> np.ndarray:
        """The bound of the similarity of a title with these letters to the titles of each cell."""
        both = letters.sum() + self.letters.sum(1)
        return np.where(self.letters.sum(1) * letters.sum() > 0, 2 * np.minimum(self.letters, letters).sum(1) / np.maximum(both, 1), 0.0)


def cells_of(titles: DataFrame) -> tuple[DataFrame, Cells]:
    """``titles`` with their ``cell``, and the cells: as many groups of letters as keep them few."""
    for groups in range(GROUPS, 0, -1):
        rows = titles.withColumn("letters", group_counts(F.col("plain"), groups)).withColumn("cell", F.xxhash64("letters"))
        cells = stored(rows.groupBy("cell").agg(F.first("letters").alias("letters"), F.count(F.lit(1)).alias("n")))
        if groups == 1 or cells.count() <= MOST_CELLS:
            return rows.drop("letters"), Cells(cells.collect(), groups)
    raise AssertionError


def probed(queries: DataFrame, cells: Cells, first: bool) -> DataFrame:
    """query, asked, cell, least: the cells that a query meets first, or (with its ``least``) all others whose bound reaches that."""

    sent = queries.sparkSession.sparkContext.broadcast(cells)  # MOST_CELLS at most

    def probe(batches):
        cells = sent.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for query, asked, letters, least in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                bound = cells.bounds(np.array(letters, np.int64))
                order = np.lexsort((cells.keys, -bound))
                held = np.cumsum(cells.held[order])
                n = int(np.searchsorted(held, FIRST_TITLES)) + 1
                at = order[:n] if first else order[n:][bound[order[n:]] >= least]
                for column, values in zip(out, ([query] * len(at), [asked] * len(at), cells.keys[at].tolist(), [least] * len(at)), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)], ["query", "asked", "cell", "least"])

    least = F.lit(0.0) if first else F.col("least")
    return queries.select("query", "asked", group_counts(F.col("asked"), cells.groups).alias("letters"), least.alias("least")).mapInArrow(probe, "query string, asked string, cell long, least double")


@F.pandas_udf(T.DoubleType())
def ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The similarity where the bound by letters reaches ``least``, null elsewhere; 0 where a side is empty."""
    known: dict[str, dict] = {}
    of = lambda t: known.get(t) or known.setdefault(t, {c: t.count(c) for c in set(t)})
    matcher, last, out = SequenceMatcher(None), None, []
    for x, y, low in zip(a, b, least, strict=True):
        if not x or not y:
            out.append(0.0)
        elif common_bound(of(x), len(x), of(y), len(y)) < low:
            out.append(None)
        else:
            if y != last:
                matcher.set_seq2(last := y)
            matcher.set_seq1(x)
            out.append(matcher.ratio())
    return pd.Series(out, dtype=float)


def ranked(queries: DataFrame, titles: DataFrame, k: int = 4) -> DataFrame:
    """query, title, score, place, gap: the top ``k`` of all ``titles`` for each distinct query, any number of them.

    gap is the lead over the next title.  Null titles and queries go; equal scores are placed by title.
    """
    asked = stored(queries.where("query IS NOT NULL").select("query").distinct().withColumn("asked", text.normal_title(F.col("query"))))
    rows, cells = cells_of(titles.where("title IS NOT NULL").select("title", text.normal_title(F.col("title")).alias("plain")))
    rows = stored(rows)
    order = W.partitionBy("query").orderBy(F.desc("score"), "title")

    def scores(met):
        found = met.join(rows, "cell").select("query", "title", ratio_from("asked", "plain", "least").alias("score")).where("score IS NOT NULL")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")

    early = stored(scores(probed(asked, cells, first=True)))
    last = early.groupBy("query").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    bound = asked.join(last, "query", "left").select("query", "asked", F.when(F.col("n") > k, F.col("low")).otherwise(0.0).alias("least"))
    best = early.unionByName(scores(probed(bound, cells, first=False))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return best.withColumn("gap", F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))).where(F.col("place") <= k)


def movie_decision(score, gap, user_year, found_year, runner_up, has_id) -> tuple:
    """Confidence and issue of a movie's best match; the first rule that holds decides."""
    known = (user_year > 0) & (found_year > 0)
    sure = (score >= fixed.TITLE_HIGH) & ((user_year <= 0) | (user_year == found_year) | (gap >= fixed.TITLE_CLEAR_GAP))
    issue = (
        F.when((score < fixed.TITLE_LEAST) | ~has_id, "not_found")
        .when(known & (user_year != found_year), "year_mismatch")
        .when(runner_up & (gap < fixed.TITLE_GAP), "ambiguous")
        .when(sure, None)
        .otherwise("uncertain")
    )
    return F.when(issue.isNull(), "high").otherwise("low"), issue


def tv_decision(score, gap, episode, episodes, runner_up) -> tuple:
    """Confidence and issue of a show's best match."""
    issue = (
        F.when(score < fixed.TITLE_LEAST, "not_found")
        .when((episodes > 0) & (episode > episodes), "episode_out_of_range")
        .when(runner_up & (gap < fixed.TITLE_GAP), "ambiguous")
        .when((score >= fixed.TITLE_HIGH) | (gap >= fixed.TITLE_CLEAR_GAP), None)
        .otherwise("uncertain")
    )
    return F.when(issue.isNull(), "high").otherwise("low"), issue


def bare_title(movie_score, tv_score):
    """movie, tv or ambiguous for a title without cues."""
    wins = lambda a, b: (a >= fixed.TITLE_LEAST) & ((a >= fixed.TITLE_HIGH) | (a >= b + fixed.TITLE_CLEAR_GAP))
    return F.when(wins(movie_score, tv_score), "movie").when(wins(tv_score, movie_score), "tv").otherwise("ambiguous")
