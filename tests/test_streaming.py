"""Response files that stream in: late, repeated and interrupted ones leave the cells of the batch plan."""

import pytest
from pyspark.sql import functions as F

from tripleforge.operators import evaluate, reports
from tripleforge.sources import sinks
from tripleforge.sources.names import stem
from tripleforge.streaming import ingest

PREMISE, TARGET = "<X, rdfs:subClassOf, Y>, <a, rdf:type, X>", "<a, rdf:type, Y>"


def test_streamed_cells(spark, tmp_path, monkeypatch):
    key = lambda p: f"ARP-full__rk__{p}__n4__b-01234567"
    tasks = spark.createDataFrame([(key(p), "ARP-full", "rk", p, ["rdfs9"], i, f"request-{i}", PREMISE, TARGET) for p in ("rdfs9", "rdfs9_11") for i in range(4)], "task_key string, prompting_condition string, dataset_variant string, pattern_id string, rules array<string>, pos int, task_id string, premise_knowledge string, expected_output string")

    def deliver(folder, model, pattern, answers, tag="batch_ab"):
        rows = spark.createDataFrame([(f"response__{model}__{key(pattern)}__{tag}", i, f'{{"id":"request-{i}","response":"{a} [used_rules: rdfs9]"}}') for i, a in answers], "name string, order int, value string")
        sinks.write(rows, str(tmp_path / "in" / folder), extension=".jsonl")

    args = (spark, str(tmp_path / "in"), tasks, str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    deliver("1", "m", "rdfs9", [(0, TARGET), (1, "none")])
    deliver("1", "m", "rdfs2", [(0, TARGET)])  # no task
    real = ingest.contributions

    def torn(rows, tasks, mode):
        added, status = real(rows, tasks, mode)
        return added, status.withColumn("status", F.raise_error(F.lit("lost")).cast("string"))

    monkeypatch.setattr(ingest, "contributions", torn)
    with pytest.raises(Exception, match="lost"):
        ingest.score_available(*args)  # the batch has written its sums and fails
    monkeypatch.setattr(ingest, "contributions", real)
    ingest.score_available(*args)
    ingest.score_available(*args)  # nothing new
    deliver("2", "m", "rdfs9_11", [(i, TARGET) for i in range(4)])
    deliver("2", "n", "rdfs9", [(9, TARGET), (0, TARGET)])  # an id without a task: withheld
    ingest.score_available(*args)
    deliver("3", "m", "rdfs9", [(0, "none"), (1, TARGET), (2, TARGET)])  # again, changed
    deliver("3", "m", "rdfs9", [(3, TARGET)], "batch_cd")  # late
    ingest.score_available(*args, files_at_once=1)
    status = {r.stem.split("__b-")[0] + r.stem[-2:]: r.status for r in ingest.outcomes(spark, str(tmp_path / "store")).collect()}
    assert status == {"response__m__ARP-full__rk__rdfs9__n4ab": "written", "response__m__ARP-full__rk__rdfs9__n4cd": "written", "response__m__ARP-full__rk__rdfs2__n4ab": "no_task", "response__m__ARP-full__rk__rdfs9_11__n4ab": "written", "response__n__ARP-full__rk__rdfs9__n4ab": "error"}
    got = ingest.cells(spark, str(tmp_path / "store"))
    # the batch plan over the last delivery of each file
    every = evaluate.read_responses(spark, str(tmp_path / "in"))
    last = every.select(stem(F.col("file")).alias("s"), "file").distinct().groupBy("s").agg(F.max("file").alias("file"))
    done = evaluate.scored(evaluate.paired(every.join(last, "file", "left_semi"), tasks)[0])
    kept = evaluate.written(done, evaluate.outcome(done, every.select("file", "task_key").limit(0)))
    want = reports.aggregate(kept.withColumn("ok", F.col("overall_ok")))
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert {(r.pattern_id, r.n_total, r.n_correct) for r in got.collect()} == {("rdfs9", 4, 3), ("rdfs9_11", 4, 4)}


def test_sums_past_a_long(spark, tmp_path):
    """Ten files whose sums fit a long each, but not together, and more right answers than units of 5e-13 fit a long."""
    key, store = "ARP-full__rk__rdfs9__n4__b-01234567", str(tmp_path / "store")
    tasks = spark.createDataFrame([(key, "ARP-full", "rk", "rdfs9", ["rdfs9"], 0, "request-0", PREMISE, TARGET)], "task_key string, prompting_condition string, dataset_variant string, pattern_id string, rules array<string>, pos int, task_id string, premise_knowledge string, expected_output string")
    rows = spark.createDataFrame([(f"response__m__{key}__batch_ab", 0, f'{{"id":"request-0","response":"{TARGET} [used_rules: rdfs9]"}}')], "name string, order int, value string")
    sinks.write(rows, str(tmp_path / "in"), extension=".jsonl")
    ingest.score_available(spark, str(tmp_path / "in"), tasks, store, str(tmp_path / "checkpoint"))
    one, file = spark.read.parquet(f"{store}/sums/batch=0"), spark.read.parquet(f"{store}/files/batch=0")
    n = 3_000_000
    counts = [c for c in one.columns if c not in ("stem", *reports.KEYS)]
    many = one.crossJoin(spark.range(10)).select(F.concat("stem", "id").alias("stem"), *reports.KEYS, *[(F.col(c) * n).cast(dict(one.dtypes)[c]).alias(c) for c in counts])
    many.write.parquet(f"{store}/sums/batch=1")
    file.crossJoin(spark.range(10)).select(F.concat("stem", "id").alias("stem"), "status").write.parquet(f"{store}/files/batch=1")
    (got,) = ingest.cells(spark, store).collect()
    assert (got.n_total, got.n_correct) == (10 * n + 1, 10 * n + 1)
    assert {got.accuracy, *(got[m] for m in reports.METRICS)} == {10**12}


def test_mean_of_many_values(spark):
    rows = spark.range(10_000_000).selectExpr("'m' AS model", "'c' AS prompting_condition", "'v' AS dataset_variant", "'rdfs9' AS pattern_id", "id % 2 = 0 OR id > 20000 AS ok", f"{10**12} - id % 2 AS f1_triple")
    (got,) = reports.aggregate(rows).collect()
    assert (got.n_correct, got.accuracy, got.f1_triple) == (9_990_000, 999 * 10**9, 10**12)
