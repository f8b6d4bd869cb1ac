"""Samples and choices of one row among several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def balanced(rows: DataFrame, groups: list[str], order: list, limit: int) -> DataFrame:
    """Round robin: the first row of each group, then the second of each, up to limit; groups in the order of their first rows.

    Ranks above limit cannot be taken, so the window keeps at most limit rows of a group in each task before the shuffle.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*groups).orderBy(*order)
    ranked = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit)
    lead = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ranked = ranked.withColumn("__g", F.first(lead).over(w))
    return ranked.orderBy("__r", "__g").limit(limit).drop("__r", "__g")


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__v")).select(*key, *[F.col(f"__v.{c}").alias(c) for c in rest])


def shuffled(rows: DataFrame, seed: int, key: list[str], limit: int) -> DataFrame:
    """limit rows in an order that seed and key fix."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(limit)


def among(col: Column, text: str | None) -> Column:
    """Whether col is in a comma list; an empty list lets all through."""
    items = [x.strip() for x in (text or "").split(",") if x.strip()]
    return col.isin(*items) if items else F.lit(True)


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """rows with their place from 1 in a total order; among rows that are equal in it, some order.

    Rows are sorted by ranges and stored with the number of their range and of their row in it; a place is that plus the rows
    of the ranges before. One task adds up ranges, whose number is that of the shuffle's partitions, and none holds the rows.
    """
    kept = stored(rows.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id()}))
    parts = kept.groupBy("__part").agg(F.count("*").alias("n"), F.min("__n").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select("__part", (before - F.col("first") + 1).alias("__shift"))
    return kept.join(F.broadcast(shift), "__part").select(*rows.columns, (F.col("__n") + F.col("__shift")).alias(name))  # a row for each partition
