"""From response and task files to scored rows: the join of files, of rows by id, and what is withheld."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import answer_text, request_id
from ..sources.names import response_name, stem, task_key
from ..sources.relations import jsonl
from .scoring import flex, joined, rules, strict


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, task_key, model, task_id, model_output of every line of the response files under path."""
    rows = jsonl(spark, path, "response__*.jsonl")
    name = stem(F.col("file"))
    return rows.select("file", "pos", task_key(name).alias("task_key"), response_name(name)["model"].alias("model"), request_id(F.col("value")).alias("task_id"), answer_text(F.col("value")).alias("model_output"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """task_key, prompting_condition, dataset_variant, pattern_id, rules, pos, task_id, premise_knowledge, expected_output of every task of the task files under path."""
    metadata = "prompting_condition string, dataset_variant string, pattern_id string, rules array<string>"
    kind = f"metadata struct<{metadata.replace(' string', ': string').replace(' array', ': array')}>, tasks array<struct<task_id: string, premise_knowledge: string, expected_output: string>>"
    files = spark.read.schema(kind).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="task__*.json").select(F.col("_metadata.file_path").alias("file"), "metadata", "tasks")
    key = F.regexp_replace(stem(F.col("file")), "^task__", "")
    return files.select(key.alias("task_key"), "metadata.*", F.posexplode("tasks").alias("pos", "t")).select("task_key", "prompting_condition", "dataset_variant", "pattern_id", "rules", "pos", "t.*")


def paired(responses: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Response rows whose file has a task file, with its metadata and their own task's texts (empty without one); the files that have none."""
    files = tasks.groupBy("task_key").agg(*[F.first(c).alias(c) for c in ("prompting_condition", "dataset_variant", "pattern_id", "rules")])
    own = responses.join(files, "task_key")
    lost = responses.select("file", "task_key").distinct().join(files, "task_key", "left_anti")
    return joined(own, tasks), lost


def scored(rows: DataFrame, mode: str = "strict") -> DataFrame:
    """Scores of paired rows by strict or flex matching; rules are scored under ARP alone (else null), where an answer must have both right."""
    out = strict(rows) if mode == "strict" else flex(rows)
    ruled = rules(out)
    arp = F.col("prompting_condition").startswith("ARP-")
    names = [c for c in ruled.columns if c not in out.columns and c != "overall_ok"]
    overall = F.when(arp, F.col("overall_ok")).otherwise(F.col("triple_ok"))
    return ruled.select(*out.columns, *[F.when(arp, F.col(c)).alias(c) for c in names], overall.alias("overall_ok"))


def outcome(rows: DataFrame, lost: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """file, status: skipped_exists (in there), error (a row has an empty target), written, or no_task."""
    files = rows.groupBy("file").agg(F.bool_or("target_empty").alias("bad")).select("file", F.when(F.col("bad"), "error").otherwise("written").alias("status"))
    every = files.unionByName(lost.select("file", F.lit("no_task").alias("status")))
    if there is None:
        return every
    old = there.select("file").distinct().withColumn("__old", F.lit(True))
    return every.join(old, "file", "left").select("file", F.when(F.col("__old") & (F.col("status") != "no_task"), "skipped_exists").otherwise(F.col("status")).alias("status"))


def written(rows: DataFrame, status: DataFrame) -> DataFrame:
    """The rows of files that are written: a file with one empty target is withheld as a whole."""
    return rows.join(status.where("status = 'written'").select("file"), "file", "left_semi")
