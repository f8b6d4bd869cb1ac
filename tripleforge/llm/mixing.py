"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Sources share a budget by weight; no target passes `most` times its source's
size, and what is over goes to the others by weight (water filling). A source takes each document floor(target / size)
times and once more where the document's hash lies under the source's threshold. The threshold is found without a sort
of the documents: sizes are summed by source and hash bucket, a running sum finds the bucket in which the remaining
budget ends, and only that boundary bucket is divided again, `LEVELS` times of `BITS` bits. Thresholds are nested: a
larger budget's documents include a smaller one's.

Defined results: a null text has size 0; sources are ordered by code point, null last and a source like any other; rows
with one doc_id hash alike and go together; a null doc_id has a hash too, so such rows go together as well; an empty table gives an empty result; extra columns are
kept; a text of any length is counted whole. The hash
depends on doc_id alone, so reruns and other partitions agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import fresh, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
LEVELS, BITS = 3, 10
#: Word count without a list of words.
SIZE = r"CAST(coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) AS BIGINT)"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (LEVELS * BITS bits of hash)."""
    bits = LEVELS * BITS
    return docs.select("doc_id", "source", F.expr(SIZE).alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("string")), 64 - bits).alias("h"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row for each source. The windows run over sources, not documents."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * most)
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(every) * share)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("line", F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level")))  # the water level, where it holds
    s = s.withColumn("line", F.min_by("line", F.when(F.col("line").isNotNull(), F.col("cap") / F.col("w"))).over(every))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("line") * F.col("w"), F.col("cap"))).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, whole (full takes) and cut: documents with h < cut are taken once more."""
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long"))
    goals = goals.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("cut", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        goals, shift = stored(goals), (LEVELS - level) * BITS  # stored: a row for each source, of a size that the planner knows
        g = goals.select(F.col("source").alias("g_source"), "cut", "need")
        inside = sizes.join(g, sizes.source.eqNullSafe(g.g_source)).where(F.shiftright("h", shift + BITS) == F.shiftright("cut", shift + BITS))  # all at first, then the boundary bucket
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("need").alias("need"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hist = hist.withColumn("upto", run).withColumn("below", F.col("upto") - F.col("size"))
        over = F.col("upto") > F.col("need")
        if level < LEVELS:  # the first bucket whose running sum passes the need, or the last one
            edge = F.coalesce(F.min(F.when(over, F.struct("bucket", "below"))), F.max(F.struct("bucket", "below")))
            found = hist.groupBy("source").agg(edge.alias("e")).select("source", F.col("e.bucket").alias("end"), F.col("e.below").alias("below"))
        else:  # the nearer side of that bucket
            nearer = F.col("upto") - F.col("need") < F.col("need") - F.col("below")
            end = F.coalesce(F.min(F.when(over, F.col("bucket") + F.when(nearer, 1).otherwise(0))), F.max("bucket") + 1)
            found = hist.groupBy("source").agg(end.alias("end")).withColumn("below", F.lit(0).cast("long"))
        f = found.withColumnRenamed("source", "f_source")
        goals = goals.join(f, goals.source.eqNullSafe(f.f_source), "left").select("source", "source_size", "target", "whole", (F.col("need") - F.coalesce("below", F.lit(0))).alias("need"), F.coalesce(F.shiftleft("end", shift), F.lit(0)).cast("long").alias("cut"))
    return goals.select("source", "source_size", "target", "whole", "cut")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times for every row of docs(doc_id, source, text)."""
    sizes = stored(sized(docs))
    cuts = stored(thresholds(sizes, targets(sizes, weights, share, most))).withColumnRenamed("source", "c_source")
    out = sizes.join(cuts, sizes.source.eqNullSafe(cuts.c_source), "left")
    times = F.col("whole") + F.when((F.col("h") < F.col("cut")) & (F.col("whole") < most), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.cast("int").alias("times"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns: one pass over the texts after the counts."""
    name, whole, cut, copy = (fresh(docs, x) for x in ("mix_source", "mix_whole", "mix_cut", "mix_copy"))
    sizes = stored(sized(docs))
    cuts = stored(thresholds(sizes, targets(sizes, weights, share, most))).select(F.col("source").alias(name), F.col("whole").alias(whole), F.col("cut").alias(cut))
    h = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("string")), 64 - LEVELS * BITS)
    out = docs.join(cuts, docs.source.eqNullSafe(cuts[name]), "left")
    times = F.coalesce(F.col(whole), F.lit(0)) + F.when((h < F.col(cut)) & (F.col(whole) < most), 1).otherwise(0)
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
