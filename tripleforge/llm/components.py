"""Connected components of an edge table by alternating large-star and small-star steps.

No group is gathered: a step takes each node's least neighbour by an aggregate and joins it back, so the centre of a
large star is one row of the small side. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) but the roots, which are the least nodes of their components. Loops and repeats are allowed."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    sign = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = stored(small)
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == sign:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = now
