"""Sinks: JSON of samples, datasets and tasks, request and eval lines, canonical CSV, splits by model. None replaces what is there unless told to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import metric_text, rule_order
from .relations import _exists

METRICS = ("accuracy", "precision_triple", "recall_triple", "f1_triple", "precision_rule", "recall_rule", "f1_rule")
#: The columns of the canonical CSV.
COLUMNS = ("model", "prompting_condition", "presented_rule_type", "rule_format", "dataset_variant", "pattern_id", "rules", "n_rule", "n_total", "n_correct", *METRICS)


def may_write(df: DataFrame, path: str, overwrite: bool) -> None:
    """An error where path is there and may not be replaced."""
    if not overwrite and _exists(df.sparkSession, path):
        raise FileExistsError(path)


def sample_name(pattern: Column, n: Column, uid: Column) -> Column:
    return F.concat_ws("__", F.lit("lod-sample"), pattern, F.concat(F.lit("n"), n.cast("string")), uid)


def dataset_name(variant: Column, pattern: Column, n: Column, fetch_uid: Column, build_uid: Column) -> Column:
    """The fetch id stands in it only where there is one."""
    return F.concat_ws("__", F.lit("dataset"), variant, pattern, F.concat(F.lit("n"), n.cast("string")), F.nullif(fetch_uid, F.lit("")), build_uid)


def task_name(condition: Column, variant: Column, pattern: Column, n: Column, *uids: Column) -> Column:
    return F.concat_ws("__", F.lit("task"), condition, variant, pattern, F.concat(F.lit("n"), n.cast("string")), *[F.nullif(u, F.lit("")) for u in uids])


def documents(rows: DataFrame, name: Column, order: str, entry: list[str], metadata: dict[str, Column], entries: str = "entries") -> DataFrame:
    """name, value: one JSON document {metadata, <entries>} for each name, with metadata.count; entries in the order of a column.

    A document is one row, as the file it becomes; rows of a name must fit a task's memory, as a sample's few hundred do.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*entry).alias("e")))), lambda x: x["e"])
    grouped = rows.groupBy(name.alias("name")).agg(listed.alias("__e"), *[F.first(c).alias(k) for k, c in metadata.items()])
    head = F.struct(*metadata, F.size("__e").cast("long").alias("count"))
    return grouped.select("name", F.to_json(F.struct(head.alias("metadata"), F.col("__e").alias(entries))).alias("value"))


def lines(rows: DataFrame, name: Column, value: Column, order: str | None = None) -> DataFrame:
    """name, order, value: a line of each row for the file of its name."""
    return rows.select(name.alias("name"), (F.col(order) if order else F.lit(0)).alias("order"), value.alias("value"))


def write(files: DataFrame, path: str, overwrite: bool = False, extension: str = "") -> None:
    """The text of files(name, value[, order]) as one file path/<name><extension> for each name, its lines in order.

    Files are written aside and moved to their names when all are there, so a failed task leaves nothing. Names that are there
    already are left alone, or with overwrite replaced one by one; other files are never touched. A name's lines are one
    task's; a name must not be empty or hold a slash or colon.
    """
    spark = files.sparkSession
    fs, at = _file_system(spark, path)
    if not overwrite and fs.exists(at):
        there = [s.getPath().getName().removesuffix(extension) for s in fs.listStatus(at) if s.getPath().getName().endswith(extension)]
        files = files.join(spark.createDataFrame([(n,) for n in there], "name string"), "name", "left_anti")
    named = F.when(F.col("name").rlike("[/:]|^$"), F.raise_error(F.concat(F.lit("no name of a file: "), F.col("name"))).cast("string")).otherwise(F.col("name"))
    keys = ["name", "order"] if "order" in files.columns else ["name"]
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    jvm = spark._jvm
    try:
        files.withColumn("name", named).repartition("name").sortWithinPartitions(*keys).select("name", "value").write.option("maxRecordsPerFile", 0).partitionBy("name").text(aside)
        for folder in fs.listStatus(jvm.org.apache.hadoop.fs.Path(aside)):
            if not folder.isDirectory():
                continue
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getPath().getName().removeprefix("name="))
            (part,) = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            to = jvm.org.apache.hadoop.fs.Path(at, name + extension)
            if fs.exists(to):
                if not overwrite:
                    continue
                fs.delete(to, True)
            if not fs.rename(part, to):
                raise OSError(f"could not move {part} to {to}")
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(aside), True)


def _file_system(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def unwritten(rows: DataFrame, there: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not there yet."""
    return rows.join(there.select(*key).distinct(), key, "left_anti")


def without_response(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Request stems (stem) that no response stem continues after response__ and a double underscore."""
    want = F.concat(F.lit("response__"), F.regexp_replace("stem", "^seq__", ""))
    # every prefix of a response name that ends before a double underscore is a key, so the test is an equi-join
    parts = F.split("stem", "__")
    prefixes = responses.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "__"))).alias("__want")).distinct()
    return requests.withColumn("__want", want).join(prefixes, "__want", "left_anti").drop("__want")


def canonical(scores: DataFrame) -> DataFrame:
    """Scores in the columns and texts of the canonical CSV; missing ones are empty."""
    have = set(scores.columns)
    empty = F.lit("")
    cell = lambda c: empty if c not in have else metric_text(F.col(c)) if c in METRICS else F.coalesce(F.col(c).cast("string"), empty)
    return scores.select(*[cell(c).alias(c) for c in COLUMNS])


def write_csv(scores: DataFrame, path: str, overwrite: bool = False, columns: list[str] | None = None) -> None:
    """The canonical CSV (or the given columns), sorted by model, condition, variant and pattern; an error where it is there."""
    may_write(scores, path, overwrite)
    rows = canonical(scores) if columns is None else scores.select(*columns)
    keys = [c for c in ("model", "prompting_condition", "dataset_variant") if c in rows.columns]
    if "pattern_id" in rows.columns:
        keys.append(rule_order(F.col("pattern_id")))
    rows.orderBy(*keys).coalesce(1).write.mode("overwrite" if overwrite else "error").csv(path, header=True, emptyValue="")  # report rows: a few for each model


def write_by_model(scores: DataFrame, path: str, overwrite: bool = False) -> None:
    """A canonical CSV for each model under path/model=<model>."""
    may_write(scores, path, overwrite)
    rows = canonical(scores)
    rows.repartition("model").sortWithinPartitions("model", "prompting_condition", "dataset_variant", rule_order(F.col("pattern_id"))).write.mode("overwrite" if overwrite else "error").partitionBy("model").csv(path, header=True, emptyValue="")


def view(rows: DataFrame, order: list, shown: dict[str, str]) -> list[list[str]]:
    """A report's cells as text, header first: metrics (units of 1e-12) with three places, what is missing as shown says. Over report rows alone."""
    three = lambda c: F.when(F.col(c).isNull(), shown.get(c, "")).otherwise(F.format_string("%.3f", F.floor(F.col(c) / 10**9 + F.lit(0.5)) / 1000))
    cells = rows.orderBy(*order).select(*[three(c) if t == "bigint" and c not in ("n_total", "n_correct", "n_rule", "rank") else F.coalesce(F.col(c).cast("string"), F.lit(shown.get(c, ""))) for c, t in rows.dtypes])
    return [list(rows.columns), *[list(r) for r in cells.collect()]]
