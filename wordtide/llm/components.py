"""Connected components of a table of links, by alternating large and small stars.

Kiveris et al., "Connected components in MapReduce and beyond".  A star needs one shuffle: the
links of a node arrive sorted, the first one names its smallest neighbour, and all that
follow are hung on it as they pass; a window's rows of one node spill to disk, and are one task's.  Repeated links are dropped
where they meet.  Links live in shared-folder tables; the driver sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import forget, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """A large star hangs a node's larger neighbours on the smallest of it and its neighbours, a small star all the others."""
    both = links.select("a", "b").union(links.select("b", "a")) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    own = W.partitionBy("a").orderBy("b")
    met = both.select("a", "b", F.least("a", F.first("b").over(own)).alias("m"), F.lag("b").over(own).alias("last"))
    if large:
        return met.where("b > a AND b != m AND (last IS NULL OR last != b)").select(F.col("b").alias("a"), F.col("m").alias("b"))
    hung = F.array(F.when(F.col("last").isNull() | (F.col("last") != F.col("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))), F.when(F.col("last").isNull(), F.struct("a", F.col("m").alias("b"))))
    return met.select(F.explode(hung).alias("link")).where("link IS NOT NULL").select("link.a", "link.b").where("a != b")


def components(links: DataFrame) -> DataFrame:
    """node, component: for every node of ``links`` (a, b), the smallest node it is connected with. Stored."""
    now, mark = links.where("a != b"), None
    while True:
        following = stored(_star(_star(now, True), False))
        if mark is not None:
            forget(now)
        now = following
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    out = stored(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct())
    forget(now)
    return out
