"""Names of files: fields between double underscores. All functions take and give columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.terms import expanded_rules

_FOUR = ("model", "prompting_condition", "dataset_variant", "pattern_id")


def stem(path: Column) -> Column:
    """A path's last part without its closing suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def _fields(text: Column, names: tuple[str, ...]) -> Column:
    """struct(names) from as many leading fields; null with fewer."""
    f = F.split(text, "__")
    return F.when(F.size(f) >= len(names), F.struct(*[F.get(f, F.lit(n)).alias(c) for n, c in enumerate(names)]))


def eval_name(name: Column) -> Column:
    """Of eval__ and eval-<mode>__ names the four fields, the condition's halves, the pattern's rules and their number."""
    lead = r"^eval(?:-\w+)?__"
    f = F.when(name.rlike(lead), _fields(F.regexp_replace(name, lead, ""), _FOUR))
    c, rules = f["prompting_condition"], expanded_rules(f["pattern_id"])
    whole = F.struct(*[f[x].alias(x) for x in _FOUR], F.when(F.instr(c, "-") > 0, F.substring_index(c, "-", 1)).otherwise(c).alias("presented_rule_type"), F.when(F.instr(c, "-") > 0, F.regexp_replace(c, "^[^-]*-", "")).otherwise("").alias("rule_format"), F.array_join(rules, ",").alias("rules"), F.size(rules).cast("long").alias("n_rule"))
    return F.when(f.isNotNull(), whole)


def task_key(name: Column) -> Column:
    """A response's task key: without prefix and model, then without a closing 14-digit time, then without one closing batch or long hex id."""
    f = F.split(name, "__")
    rest = F.array_join(F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))), "__")
    rest = F.regexp_replace(rest, r"(^|__)\d{14}$", "")
    return F.when(F.size(f) >= 3, F.regexp_replace(rest, r"(^|__)(batch_[0-9a-f]+|[0-9a-f]{16,})$", ""))


def task_name(name: Column) -> Column:
    """struct(prompting_condition, dataset_variant, pattern_id) of task__ names."""
    return F.when(name.startswith("task__"), _fields(F.regexp_replace(name, "^task__", ""), _FOUR[1:]))


def response_name(name: Column) -> Column:
    """The four fields of response__ names."""
    return F.when(name.startswith("response__"), _fields(F.regexp_replace(name, "^response__", ""), _FOUR))


def request_name(name: Column) -> Column:
    """The four fields of batch__ and seq__ names."""
    return F.when(name.rlike("^(batch|seq)__"), _fields(F.regexp_replace(name, "^(batch|seq)__", ""), _FOUR))


def dataset_name(path: Column, variant: str) -> Column:
    """n, fetch_uid, build_uid, rule_dir and the validation file's name of a dataset file's path; missing parts are null."""
    name = F.substring_index(path, "/", -1)
    some = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    out = F.when(F.instr(name, f"dataset__{variant}__") > 0, F.concat(F.substring_index(name, f"dataset__{variant}__", 1), F.lit(f"validation__{variant}__"), F.substring(name, F.instr(name, f"dataset__{variant}__") + len(f"dataset__{variant}__"), F.length(name)))).otherwise(name)
    parts = F.split(path, "/")
    return F.struct(some(r"__n(\d+)__").cast("long").alias("n"), some(r"__(f-[0-9a-f]+)").alias("fetch_uid"), some(r"__(b-[0-9a-f]+)\.json$").alias("build_uid"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("").alias("rule_dir"), out.alias("out_name"))


def uids(name: Column) -> Column:
    """The set of fields that are a letter, a hyphen and eight hex digits."""
    return F.array_sort(F.array_distinct(F.filter(F.split(name, "__"), lambda x: x.rlike("^[a-z]-[0-9a-f]{8}$"))))
