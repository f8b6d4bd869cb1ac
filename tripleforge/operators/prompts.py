"""Prompts, tasks and request rows."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import expanded_rules
from ..plans.patterns import PATTERNS

CONDITIONS = ("NRP-full", "NRP-name", "NRP-def", "ARP-full", "ARP-name", "ARP-def")

# The texts of the prompts.
SYSTEM = "You are a helpful assistant."
ONE_RULE = "Given the following rule and premise knowledge:\n"
MANY_RULES = "Given the following rules and premise knowledge:\n"
NOTE = "Note: The variable names used in {} (e.g., a, b, i, j, k, X, Y, Z, W) are placeholders and do not represent actual classes, properties, or instances. They are used solely for describing the rule structure. "
INFER = "Solely based on {} and the premise knowledge, output the inferred RDFS triples{}. "
TRIPLES = 'Enclose each triple in "<" and ">". Never use the "http://" format in the triple. '
OUTPUT = "Output all triples that can be derived from {} and do not include any additional text or descriptions."
USED = (
    "At the end of your response, list all rule names you used in the format: [used_rules: {0}, ...]. Replace {1}. "
    'Enclose the list in "[" and "]", use the exact key name "used_rules:", and separate each rule name with a comma. Use only rule names from {2}. '
)
USED_NAMES = ("rdfsN", "N with the actual rule numbers you applied", "the following list: rdfs2, rdfs3, rdfs5, rdfs7, rdfs9, rdfs11")
USED_LETTERS = ("ruleX", "X with the actual rule letters you applied (e.g., ruleA, ruleB, ruleC)", "ruleA to ruleF")
EXCEPTION = " The only exception is the [used_rules: ...] line at the end of your response."

SIX = ("rdfs2", "rdfs3", "rdfs5", "rdfs7", "rdfs9", "rdfs11")


def condition_name(text: str) -> str:
    """A prompting condition in its spelling; case does not matter; others are an error."""
    for c in CONDITIONS:
        if c.lower() == text.strip().lower():
            return c
    raise ValueError(f"unknown prompting condition: {text}")


def condition_column(text: Column) -> Column:
    """The same over rows; an unknown one raises."""
    known = F.create_map(*[F.lit(x) for c in CONDITIONS for x in (c.lower(), c)])[F.lower(F.trim(text))]
    return F.when(text.isNull() | known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown prompting condition: "), text)))


#: Rule counts that a condition is defined for.
VALID = {(c, n) for c in CONDITIONS for n in (1, 2, 3)}


def is_valid(condition: str, n_rules: int) -> bool:
    return (condition, n_rules) in VALID


def rule_keys(pattern: str) -> list[str]:
    """Known rules of a pattern id: rdfs2_3 is rdfs2 and rdfs3; none where it is no pattern id."""
    if not re.fullmatch(r"rdfs\d+(_\d+)*", pattern.strip()):
        return []
    return [r for r in (f"rdfs{n}" for n in pattern.strip().removeprefix("rdfs").split("_")) if r in SIX]


def rule_key_column(pattern: Column) -> Column:
    """The same over rows."""
    return F.when(pattern.rlike(r"^\s*rdfs\d+(_\d+)*\s*$"), F.filter(expanded_rules(F.trim(pattern)), lambda r: r.isin(*SIX))).otherwise(F.array().cast("array<string>"))


def rule_text(pattern: str) -> str:
    """`if ... and ... then ...` with class slots in capitals."""
    p = PATTERNS[pattern]
    show = lambda t: f"<{', '.join(x.upper() if x in ('x', 'y', 'z', 'w') else x for x in t)}>"
    return f"if {' and '.join(map(show, p.premise))} then {' and '.join(map(show, p.conclusion))}"


def frame(condition: str, pattern: str, empty: bool = False) -> tuple[str, str]:
    """What stands before and after the premise in a prompt; empty: without the necessary rules, as a template."""
    kind, form = condition_name(condition).split("-")
    keys = rule_keys(pattern) if kind == "NRP" else list(SIX)
    one = kind == "NRP" and len(keys) == 1
    if empty and kind == "NRP":
        rules = ": " if one and form == "full" else ""
    elif form == "name":
        rules = ", ".join(keys)
    elif form == "full":
        rules = "\n".join(f"{k}: {rule_text(k)}" for k in keys)
    else:
        rules = "\n".join(rule_text(k) if kind == "NRP" else f"rule{'ABCDEF'[i]}: {rule_text(k)}" for i, k in enumerate(keys))
    own_line = form == "full" or (form == "def" and not one)
    head = (ONE_RULE if one else MANY_RULES) + ("Rule:" if one else "Rules:") + ("\n" if own_line else " ") + rules + "\nPremise Knowledge: "
    what = "this rule" if one else "these rules"
    how = "" if one else " by combining these rules" if kind == "NRP" else " by selecting and combining these rules as necessary"
    note = "" if form == "name" else NOTE.format("the rule" if one else "these rules")
    tail = "\n" + note + INFER.format(what, how) + TRIPLES
    if kind == "ARP":
        tail += USED.format(*(USED_LETTERS if form == "def" else USED_NAMES))
    tail += OUTPUT.format(what) + (EXCEPTION if kind == "ARP" else "")
    return head, tail


def prompt(condition: str, pattern: str, premise: str) -> str:
    head, tail = frame(condition, pattern)
    return head + premise + tail


def template_id(condition: str, pattern: str = "") -> str:
    """t- and eight hex digits over the system text, the condition and its template without rules and premise: one for all patterns of a condition, but for one rule and for several under NRP."""
    whole = "".join(frame(condition, pattern, empty=True))
    return "t-" + hashlib.sha256("\n---\n".join((SYSTEM, condition_name(condition), whole)).encode()).hexdigest()[:8]


def _frames(spark, patterns: list[str], conditions: list[str]) -> DataFrame:
    rows = [(c, p, *frame(c, p), template_id(c, p)) for p in patterns for c in conditions]
    return spark.createDataFrame(rows, "prompting_condition string, pattern_id string, head string, tail string, template_uid string")


def tasks(entries: DataFrame, conditions: list[str] = list(CONDITIONS)) -> DataFrame:
    """A task for each entry (pattern_id, pos from 0, premise_knowledge, expected_output) and condition; an entry without premise has none, yet keeps its number."""
    frames = F.broadcast(_frames(entries.sparkSession, list(PATTERNS), conditions))  # 19 patterns x 6 conditions at most
    whole = entries.where(F.coalesce("premise_knowledge", F.lit("")) != "")
    return whole.join(frames, "pattern_id").select(
        "pattern_id",
        "prompting_condition",
        "template_uid",
        F.concat(F.lit("request-"), (F.col("pos") + 1).cast("string")).alias("task_id"),
        (F.col("pos") + 1).alias("source_index"),
        F.lit(SYSTEM).alias("system_prompt"),
        F.concat("head", "premise_knowledge", "tail").alias("user_prompt"),
        "premise_knowledge",
        "expected_output",
    )


def batch_request(model: str, temperature: float | None = None, max_tokens: int | None = None) -> Column:
    """JSON line of a batch request; temperature and the token limit only where given."""
    message = lambda role, col: F.struct(F.lit(role).alias("role"), F.col(col).alias("content"))
    body = [F.lit(model).alias("model"), F.array(message("system", "system_prompt"), message("user", "user_prompt")).alias("messages")]
    if temperature is not None:
        body.append(F.lit(temperature).alias("temperature"))
    if max_tokens is not None:
        body.append(F.lit(max_tokens).alias("max_completion_tokens"))
    return F.to_json(F.struct(F.col("task_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(*body).alias("body")))


def sequential_request(model: str, with_system: bool = False) -> Column:
    parts = [F.col("task_id").alias("id"), F.lit(model).alias("model"), F.col("user_prompt").alias("input")]
    return F.to_json(F.struct(*parts, *([F.col("system_prompt").alias("system")] if with_system else [])))
