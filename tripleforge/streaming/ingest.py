"""Response files as a stream: scored as they arrive, kept by file, and summed to the cells of the batch report.

A micro-batch scores its files and writes two tables under `store`, in the folder batch=<id>: `files` (what became of each
file) and `sums` (for each file and cell the counts, sums and numbers of values, which add up). The folder is replaced as a
whole, so a batch that is run again after a failure leaves the same as if it had run once, and the source's checkpoint says
which files are done. A file that comes again, changed or not, from whatever folder, counts with its last batch alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import WIDE, answer_text, mean, request_id, share, total_of
from ..operators import evaluate
from ..operators.reports import KEYS, METRICS, n_rule
from ..sources.names import response_name, stem, task_key

SUMS = [f"{kind}_{m}" for m in METRICS for kind in ("sum", "count")]
_KEEP = "stem string, model string, prompting_condition string, dataset_variant string, pattern_id string, n_total long, n_correct long, " + ", ".join(f"{c} {WIDE if c.startswith('sum') else 'long'}" for c in SUMS) + ", batch long"


def responses(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """The lines of response files under path, as they come: file, task_key, model, task_id, model_output."""
    source = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "response__*.jsonl")
    raw = (source.option("maxFilesPerTrigger", files_at_once) if files_at_once else source).text(path)
    raw = raw.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value")
    name = stem(F.col("file"))
    return raw.select("file", task_key(name).alias("task_key"), response_name(name)["model"].alias("model"), request_id(F.col("value")).alias("task_id"), answer_text(F.col("value")).alias("model_output"))


def contributions(rows: DataFrame, tasks: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Of response rows: what each file adds to its cell (stem, KEYS, counts and SUMS), and the files' outcomes (stem, status). A file with an empty target adds nothing."""
    paired, lost = evaluate.paired(rows, tasks)
    done = evaluate.scored(paired, mode).withColumn("stem", stem(F.col("file")))
    status = evaluate.outcome(done, lost)
    kept = evaluate.written(done, status)
    sums = [e for m in METRICS for e in (F.coalesce(total_of(F.col(m)), F.lit(0)).cast(WIDE).alias(f"sum_{m}"), F.count(m).alias(f"count_{m}"))]
    added = kept.groupBy("stem", *KEYS).agg(F.count("*").alias("n_total"), F.sum(F.col("overall_ok").cast("long")).alias("n_correct"), *sums)
    return added, status.select(stem(F.col("file")).alias("stem"), "status")


def score_available(spark: SparkSession, path: str, tasks: DataFrame, store: str, checkpoint: str, mode: str = "strict", files_at_once: int | None = None) -> None:
    """Scores what has come since the last call. tasks: as from `evaluate.read_tasks`."""

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read by the scores and by the outcomes
        try:
            added, status = contributions(batch, tasks, mode)
            added.write.mode("overwrite").parquet(f"{store}/sums/batch={number}")
            status.write.mode("overwrite").parquet(f"{store}/files/batch={number}")  # last: a batch counts once its outcomes are there
        finally:
            batch.unpersist()

    rows = responses(spark, path, files_at_once)
    rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def outcomes(spark: SparkSession, store: str) -> DataFrame:
    """stem, status, batch of every file, as its last batch left it."""
    files = spark.read.schema("stem string, status string, batch long").parquet(f"{store}/files")
    return files.groupBy("stem").agg(F.max_by("status", "batch").alias("status"), F.max("batch").alias("batch"))


def cells(spark: SparkSession, store: str) -> DataFrame:
    """The score rows of `reports.aggregate` over all files that have come: the sums of each file's last batch, added up."""
    sums = spark.read.schema(_KEEP).parquet(f"{store}/sums")
    last = sums.join(outcomes(spark, store).select("stem", "batch"), ["stem", "batch"], "left_semi")
    total = last.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_total", "n_correct", *SUMS)])
    means = [mean(F.col(f"sum_{m}"), F.col(f"count_{m}")).alias(m) for m in METRICS]
    return total.select(*KEYS, "n_total", "n_correct", share(F.col("n_correct"), F.col("n_total")).alias("accuracy"), *means, n_rule(F.col("pattern_id")).alias("n_rule"))
