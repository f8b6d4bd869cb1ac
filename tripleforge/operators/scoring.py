"""Scores of free-text answers against target triples. Row by row over arrays: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import PICO, candidates, flexible, normal_candidate, ratio, triple_parts, triple_set, used_rules


def _metrics(tp: Column, predicted: Column, target: Column, prefix: str) -> list[Column]:
    """Precision, recall and F1 in units of 1e-12 from counts."""
    return [ratio(tp, predicted).alias(f"precision_{prefix}"), ratio(tp, target).alias(f"recall_{prefix}"), ratio(2 * tp, predicted + target).alias(f"f1_{prefix}")]


def _targets(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("premise_triples", triple_set(F.col("premise_knowledge"))).withColumn("expected_triples", triple_set(F.col("expected_output")))
    rows = rows.withColumn("target_triples", F.array_except("expected_triples", "premise_triples"))
    return rows.withColumn("target_empty", F.size("target_triples") == 0)


def strict(rows: DataFrame) -> DataFrame:
    """rows(premise_knowledge, expected_output, model_output) with precision, recall and F1 of the answer's triples without the premise's."""
    rows = _targets(rows).withColumn("filtered_triples", F.array_except(triple_set(F.col("model_output")), "premise_triples"))
    tp = F.size(F.array_intersect("target_triples", "filtered_triples"))
    rows = rows.select("*", *_metrics(tp, F.size("filtered_triples"), F.size("target_triples"), "triple"))
    return rows.withColumn("triple_ok", (F.col("precision_triple") == PICO) & (F.col("recall_triple") == PICO))


def flex(rows: DataFrame, on_error: str = "raise") -> DataFrame:
    """Like strict, but a candidate counts as a triple if its terms stand in order between commas or white space.

    Candidates that match the premise go (premise_filtered_candidates has the others as they came); what matches a target
    counts once for the target, the rest once for each normal form (scored_candidates). A candidate that matches two targets,
    or a premise and a target, candidates of one normal form that match differently, or a reference triple that can't be
    parsed, is an error: raised, or kept as flex_error (on_error="keep").
    """
    rows = _targets(rows)
    spelled = F.transform(candidates(F.col("model_output")), lambda c: F.struct(c.alias("c"), normal_candidate(c).alias("n")))
    rows = rows.withColumn("__all", spelled)
    hits = lambda x, col: F.filter(col, lambda t: flexible(x["c"], t, x["n"]))
    per = F.transform("__all", lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n"), F.exists("premise_triples", lambda t: flexible(x["c"], t, x["n"])).alias("p"), hits(x, F.col("target_triples")).alias("m")))
    rows = rows.withColumn("__per", per).withColumn("__left", F.filter("__per", lambda x: ~x["p"]))
    bad = F.exists("__per", lambda x: (F.size(x["m"]) > 1) | ((F.size(x["m"]) > 0) & x["p"])) | F.exists(F.concat("premise_triples", "target_triples"), lambda t: triple_parts(t).isNull())
    forms = F.array_distinct(F.transform("__left", lambda x: x["n"]))
    bad = bad | (F.size(forms) != F.size(F.array_distinct(F.transform("__left", lambda x: F.struct(x["n"], x["m"])))))
    rows = rows.withColumn("flex_error", bad)
    if on_error == "raise":
        rows = rows.withColumn("flex_error", F.when(F.col("flex_error"), F.raise_error(F.lit("ambiguous or unparsable triples")).cast("boolean")).otherwise(False))
    rows = rows.withColumn("premise_filtered_candidates", F.transform("__left", lambda x: x["c"])).withColumn("scored_candidates", F.array_sort(forms))
    rows = rows.withColumn("matched_target_triples", F.array_sort(F.array_distinct(F.flatten(F.transform("__left", lambda x: x["m"])))))
    rows = rows.withColumn("unmatched_candidates", F.array_sort(F.array_distinct(F.transform(F.filter("__left", lambda x: F.size(x["m"]) == 0), lambda x: x["n"]))))
    m, u, e = (F.size(c) for c in ("matched_target_triples", "unmatched_candidates", "target_triples"))
    rows = rows.drop("__all", "__per", "__left").select("*", *_metrics(m, m + u, e, "triple"))
    return rows.withColumn("triple_ok", (F.col("precision_triple") == PICO) & (F.col("recall_triple") == PICO))


def rules(rows: DataFrame) -> DataFrame:
    """Adds rule scores to rows(rules array, model_output, triple_ok)."""
    rows = rows.withColumn("expected_rules", F.array_sort(F.array_distinct("rules"))).withColumn("model_rules", F.array_sort(F.array_distinct(used_rules(F.col("model_output")))))
    tp = F.size(F.array_intersect("expected_rules", "model_rules"))
    rows = rows.select("*", *_metrics(tp, F.size("model_rules"), F.size("expected_rules"), "rule"))
    rows = rows.withColumn("rule_ok", (F.col("precision_rule") == PICO) & (F.col("recall_rule") == PICO))
    return rows.withColumn("overall_ok", F.col("triple_ok") & F.col("rule_ok"))


def joined(responses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Responses with their tasks by (task_key, task_id); a missing task leaves empty texts; of repeated task ids the last by pos counts."""
    last = tasks.groupBy("task_key", "task_id").agg(F.max_by(F.struct("premise_knowledge", "expected_output"), "pos").alias("t"))
    out = responses.join(last, ["task_key", "task_id"], "left")
    return out.select(*responses.columns, F.coalesce("t.premise_knowledge", F.lit("")).alias("premise_knowledge"), F.coalesce("t.expected_output", F.lit("")).alias("expected_output"))


def publishable(rows: DataFrame, file: str = "file") -> DataFrame:
    """Rows of files in which no target is empty."""
    bad = rows.where("target_empty").select(file).distinct()
    return rows.join(bad, file, "left_anti")
