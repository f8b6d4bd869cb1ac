"""Reports over scored rows. Metrics are whole numbers of 1e-12; every stage rounds half up once, as its output is read by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import expected_text, input_text, mean, rule_order, share, tokens_estimated, total_of
from ..sources.names import request_name, stem
from ..sources.relations import values

KEYS = ["model", "prompting_condition", "dataset_variant", "pattern_id"]
METRICS = ["precision_triple", "recall_triple", "f1_triple", "precision_rule", "recall_rule", "f1_rule"]


def aggregate(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One score row for each file key: counts, accuracy and means over values that are there."""
    ok = F.sum(F.col("ok").cast("long"))
    means = [mean(total_of(F.col(m)), F.count(m)).alias(m) for m in METRICS if m in rows.columns]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_total"), ok.alias("n_correct"), share(ok, F.count("*")).alias("accuracy"), *means)
    return out.withColumn("n_rule", n_rule(F.col("pattern_id")))


def n_rule(pattern: Column) -> Column:
    return F.size(F.split(pattern, "_")).cast("long")


def family(condition: Column) -> Column:
    return F.substring_index(condition, "-", 1)


def form(condition: Column) -> Column:
    return F.substring_index(condition, "-", -1)


def scaling(scores: DataFrame) -> DataFrame:
    """Mean F1 by form, variant, model, family and number of rules, on the full grid of what a form's models have; a missing cell is null."""
    s = scores.select(form(F.col("prompting_condition")).alias("rule_format"), "dataset_variant", "model", family(F.col("prompting_condition")).alias("family"), "n_rule", "f1_triple")
    cells = s.groupBy("rule_format", "dataset_variant", "model", "family", "n_rule").agg(mean(total_of(F.col("f1_triple")), F.count("f1_triple")).alias("f1"))
    grid = s.select("rule_format", "model").distinct().crossJoin(F.broadcast(s.select("dataset_variant").distinct())).crossJoin(F.broadcast(s.select("family").distinct())).crossJoin(F.broadcast(s.select("n_rule").distinct()))  # 7 variants, 2 families, 3 counts at most
    return grid.join(cells, ["rule_format", "dataset_variant", "model", "family", "n_rule"], "left")


def rule_accuracy(scores: DataFrame) -> DataFrame:
    """Single rules with full texts: the mean of each condition's mean F1, by variant, rule and model."""
    s = scores.where((F.col("n_rule") == 1) & (form(F.col("prompting_condition")) == "full"))
    by = s.groupBy("dataset_variant", "pattern_id", "model", "prompting_condition").agg(mean(total_of(F.col("f1_triple")), F.count("f1_triple")).alias("f"))
    return by.groupBy("dataset_variant", "pattern_id", "model").agg(mean(total_of(F.col("f")), F.count("f")).alias("f1"))


def by_dataset(scores: DataFrame, variants: list[str]) -> DataFrame:
    """Full texts: mean of cell means (family x number of rules) by model, one column for each variant."""
    s = scores.where(form(F.col("prompting_condition")) == "full").withColumn("family", family(F.col("prompting_condition")))
    cells = s.groupBy("model", "dataset_variant", "family", "n_rule").agg(mean(total_of(F.col("f1_triple")), F.count("f1_triple")).alias("f"))
    flat = cells.groupBy("model", "dataset_variant").agg(mean(total_of(F.col("f")), F.count("f")).alias("f1"))
    return flat.groupBy("model").pivot("dataset_variant", variants).agg(F.max("f1"))


def matrix(scores: DataFrame, variants: list[str], order: str) -> DataFrame:
    """Model, condition and pattern against variants; of repeated cells the last by order counts."""
    return scores.groupBy("model", "prompting_condition", "pattern_id").pivot("dataset_variant", variants).agg(F.max_by("f1_triple", order))


def best(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Marks the largest value of each column; all that tie are marked. Over report rows, one for each model."""
    top = rows.agg(*[F.max(c).alias(f"__{c}") for c in columns])
    return rows.crossJoin(F.broadcast(top)).select(*rows.columns, *[(F.col(c) == F.col(f"__{c}")).alias(f"best_{c}") for c in columns])


def composites(scores: DataFrame, order: str) -> DataFrame:
    """The seven composite metrics of each model.

    A combination is a family and a number of rules; its patterns are those seen in any condition or variant. A mean
    over combinations is null if one of the six (for rule scores: three) has no value. Ratios are capped at one and
    carried with 18 digits; one rounding at the end.
    """
    last = scores.groupBy(*KEYS).agg(F.max_by(F.struct("f1_triple", "f1_rule", "n_rule"), order).alias("v")).select(*KEYS, "v.*")
    s = last.withColumn("family", family(F.col("prompting_condition"))).withColumn("form", form(F.col("prompting_condition")))
    cell = s.groupBy("model", "family", "n_rule", "pattern_id").agg(
        *[F.max(F.when((F.col("dataset_variant") == v) & (F.col("form") == "full"), F.col("f1_triple"))).alias(v) for v in ("rk", "ns", "gs", "gsc", "nsc")],
        *[F.max(F.when((F.col("dataset_variant") == v) & (F.col("form") == "full") & (F.col("family") == "ARP"), F.col("f1_rule"))).alias(f"{v}_rule") for v in ("rk", "ns")],
        F.max(F.when((F.col("dataset_variant") == "ns") & (F.col("form") == "name"), F.col("f1_triple"))).alias("ns_name"),
    )
    big = F.lit(10**18).cast("decimal(38,0)")

    def capped(num: str, den: str) -> Column:
        n, d = F.col(num).cast("decimal(20,0)"), F.col(den).cast("decimal(20,0)")
        return F.when(F.col(den) > 0, F.when(F.col(num) >= F.col(den), F.lit(10**18)).otherwise(F.call_function("div", n * big, F.when(d > 0, d)))).cast("long")

    pico18 = lambda c: (F.col(c) * 1_000_000).cast("long")
    values = {"RI": pico18("rk"), "SI": pico18("ns"), "RRS": pico18("rk_rule"), "SRS": pico18("ns_rule"), "VR": capped("gsc", "nsc"), "TR": capped("gs", "gsc"), "RDI": capped("ns_name", "ns")}
    cell = cell.select("model", "family", "n_rule", *[v.alias(k) for k, v in values.items()])
    d38 = lambda c: F.col(c).cast("decimal(38,0)")
    combo = cell.groupBy("model", "family", "n_rule").agg(*[F.sum(d38(k)).alias(k) for k in values], *[F.count(k).alias(f"n_{k}") for k in values])
    # a combination's mean is a fraction: over the least common multiple of counts it would be exact; 18 digits are kept
    each = combo.select("model", "family", *[F.call_function("div", F.col(k) * 2 + F.col(f"n_{k}"), F.when(F.col(f"n_{k}") > 0, F.col(f"n_{k}") * 2)).alias(k) for k in values])
    need = {k: 3 if k in ("RRS", "SRS") else 6 for k in values}
    final = lambda k: F.when(F.count(k) == need[k], F.call_function("div", 2 * F.sum(d38(k)) + F.lit(need[k] * 1_000_000), F.lit(2 * need[k] * 1_000_000).cast("decimal(20,0)"))).cast("long")
    return each.groupBy("model").agg(*[final(k).alias(k) for k in values])


def status(tasks: DataFrame, responses: DataFrame) -> DataFrame:
    """done, stale, none by cell: whether a response has all of the task's uids, any response is there, or none. tasks and responses: KEYS (tasks without model) and uids."""
    cell = ["prompting_condition", "dataset_variant", "pattern_id"]
    models = responses.select("model").distinct()
    grid = tasks.select(*cell, F.col("uids").alias("task_uids")).crossJoin(F.broadcast(models))  # models are few: the grid is what is asked for
    seen = grid.join(responses, ["model", *cell], "left")
    got = seen.groupBy("model", *cell).agg(F.bool_or(F.size(F.array_except("task_uids", "uids")) == 0).alias("all"), F.count("uids").alias("n"))
    return got.select("model", *cell, F.when(F.col("all"), "done").when(F.col("n") > 0, "stale").otherwise("none").alias("status"))


def budget(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by model and condition, with a total for each model (condition null); unknown models cost nothing."""
    rows = requests.join(F.broadcast(prices), "model", "left")  # a price for each model
    priced = rows.withColumns({"pin": F.coalesce("input_per_1m", F.lit(0.0)), "pout": F.coalesce("output_per_1m", F.lit(0.0))})
    model = ["model", "pin", "pout"]
    both = priced.groupingSets([[*model, "prompting_condition"], model], *model, "prompting_condition").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = F.col("input_tokens") * F.col("pin") / 1e6 + F.col("output_tokens") * F.col("pout") / 1e6
    return both.select("model", "prompting_condition", "n", "input_tokens", "output_tokens", F.bround(cost, 6).alias("cost"))


def audit_summary(results: DataFrame) -> DataFrame:
    """Totals and the counterfactual rate by variant."""
    s = results.groupBy("dataset_variant").agg(*[F.sum(c).alias(c) for c in ("total", "judged", "counterfactual")])
    return s.withColumn("rate", share(F.col("counterfactual"), F.col("judged")))


def ordered(rows: DataFrame, column: str, listed: list[str]) -> DataFrame:
    """Rows with rank of a listed order; unknown values come after it by name. Ranks are of the values, which are few, and joined back: no window over the rows."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, listed)), F.col(column)), F.lit(0))
    ranks = rows.select(column).distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.when(at == 0, len(listed) + 1).otherwise(at), F.asc_nulls_last(column))))
    name = f"__{column}"
    ranks = ranks.withColumnRenamed(column, name)
    return rows.join(ranks, F.col(column).eqNullSafe(F.col(name)), "left").drop(name)


def by_rules(rows: DataFrame, *first: str) -> DataFrame:
    """Report order: the given columns, then patterns by number of rules and rule numbers."""
    return rows.orderBy(*first, rule_order(F.col("pattern_id")))


def checked_targets(rows: DataFrame, file: str = "file") -> DataFrame:
    """rows as they are; the run stops with the file's name at a row without target_empty, or with an empty target."""
    why = F.when(F.col("target_empty").isNull(), F.concat(F.col(file), F.lit(": a row has no target_empty"))).when(F.col("target_empty"), F.concat(F.col(file), F.lit(": a row has an empty target")))
    return rows.withColumn("target_empty", F.when(why.isNotNull(), F.raise_error(why).cast("boolean")).otherwise(F.col("target_empty")))


def outcomes(results: DataFrame, kinds: list[str], column: str = "status") -> DataFrame:
    """How often each kind of outcome came, 0 where it did not."""
    every = values(results.sparkSession, [(k,) for k in kinds], column)
    return every.join(results.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def composite_cell(condition: Column, variant: Column) -> Column:
    """Whether a cell enters a composite metric: full texts on five variants, names on ns."""
    return F.when(condition.isin("NRP-full", "ARP-full"), variant.isin("rk", "ns", "gs", "gsc", "nsc")).when(condition.isin("NRP-name", "ARP-name"), variant == "ns").otherwise(False)


def collected_tokens(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """A row for each request file: model, runner, prompting_condition, dataset_variant, pattern_id, n_tasks, input_tokens, output_tokens.

    requests: file, runner, pos (line, blank ones counted), value; the file's folder must not start with "queue". tasks:
    prompting_condition, dataset_variant, pattern_id, pos, expected_output. A request goes with the task at its place; one
    without a task has no output tokens.
    """
    name = request_name(stem(F.col("file")))
    rows = requests.where(~F.element_at(F.split("file", "/"), -2).startswith("queue")).select("file", "runner", F.col("pos").cast("long").alias("pos"), "value", name.alias("f")).where("f IS NOT NULL").select("file", "runner", "pos", "value", "f.*")
    rows = rows.join(tasks.select("prompting_condition", "dataset_variant", "pattern_id", F.col("pos").cast("long").alias("pos"), "expected_output", F.lit(True).alias("__task")), ["prompting_condition", "dataset_variant", "pattern_id", "pos"], "left")
    out = F.when(F.col("__task"), tokens_estimated(expected_text(F.col("expected_output"), F.col("prompting_condition"), F.col("pattern_id")))).otherwise(0)
    keys = ["file", "model", "runner", "prompting_condition", "dataset_variant", "pattern_id"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_tasks"), F.sum(tokens_estimated(input_text(F.col("value")))).alias("input_tokens"), F.sum(out).alias("output_tokens"))
