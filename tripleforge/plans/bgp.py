"""Compiles a pattern into DataFrame joins over a triple table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, stored
from .patterns import DOM, PATTERNS, RAN, SC, SP, TY, Pattern

_SCHEMA = (DOM, RAN, SP, SC)


def facts_of(triples: DataFrame) -> DataFrame:
    """What is no schema triple, stored: the tables behind it are read once, whatever many patterns are matched."""
    return stored(triples.where(~F.col("p").isin(*_SCHEMA)))


def _relation(triples: DataFrame, triple: tuple[str, str, str]) -> DataFrame:
    """Rows of the triple's slots. A slot as predicate ranges over all instance properties."""
    s, p, o = triple
    if len(p) == 1:
        rows = triples.where(~F.col("p").isin(*_SCHEMA, TY)).select(F.col("s").alias(s), F.col("p").alias(p), F.col("o").alias(o))
    else:
        rows = triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    return rows


def differ(groups: tuple[str, ...]) -> list[Column]:
    """Conditions that the slots of each group are pairwise different."""
    return [F.col(g[m]) != F.col(g[n]) for g in groups for m in range(len(g)) for n in range(m + 1, len(g))]


def match(triples: DataFrame, pattern: Pattern | str, is_set: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Distinct slot rows of the premise: an inner equi-join for each triple, the facts first, then one schema relation after another.

    Joins are not recursive: exactly the listed triples, never a closure. Which side is broadcast is left to the planner,
    which knows the sizes of schema relations that are values or stored tables: the facts are then not moved at all. Schema
    relations are not joined with each other, as the planner takes the product of their sizes for that of the join, and would
    move the facts to the few tasks that their properties fill. A row's slots name its triples, so rows are distinct where
    triples are a set (is_set). facts: the triples' facts and types where they are stored by themselves, for many patterns.
    """
    pattern = PATTERNS[pattern] if isinstance(pattern, str) else pattern
    source = lambda t: triples if facts is None or t[1] in _SCHEMA else facts
    order = sorted(pattern.premise, key=lambda t: t[1] in _SCHEMA)
    out = _relation(source(order[0]), order[0])
    for t in order[1:]:
        nxt = _relation(source(t), t)
        out = out.join(nxt, [c for c in nxt.columns if c in out.columns])
    out = reduce(lambda d, c: d.where(c), differ(pattern.distinct), out).select(*pattern.slots)
    return out if is_set else out.distinct()


def beside_schema(schema: DataFrame, facts: DataFrame, pattern: Pattern | str, dress: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """`match` of sets for schema triples so few that they go to all tasks joined with each other. dress adds columns that are made of the schema's slots alone: so they are made for each of its rows, not for each fact. Further columns of facts(s, p, o, ...) are kept."""
    pattern = PATTERNS[pattern] if isinstance(pattern, str) else pattern
    pairs = [(g[m], g[n]) for g in pattern.distinct for m in range(len(g)) for n in range(m + 1, len(g))]
    apart = lambda rows, chosen: reduce(lambda d, c: d.where(F.col(c[0]) != F.col(c[1])), chosen, rows)
    few = [_relation(schema, t) for t in pattern.premise if t[1] in _SCHEMA]
    side = reduce(lambda out, nxt: out.join(nxt, [c for c in nxt.columns if c in out.columns]), few)
    inner = [c for c in pairs if set(c) <= set(side.columns)]
    side, slots = dress(apart(side, inner)), side.columns
    for s, p, o in (t for t in pattern.premise if t[1] not in _SCHEMA):
        kept = [c for c in facts.columns if c not in ("s", "p", "o")]
        of = facts.where(F.col("p") == p) if len(p) > 1 else facts.where(~F.col("p").isin(*_SCHEMA, TY)).withColumn(p, F.col("p"))
        rows = of.select(F.col("s").alias(s), *([p] if len(p) == 1 else []), F.col("o").alias(o), *kept)
        side = rows.join(F.broadcast(side), [c for c in slots if c in rows.columns])
    return apart(side, [c for c in pairs if c not in inner])


def rendered(parts: tuple[tuple[str, str, str], ...], slots=None) -> Column:
    """`<s, p, o>` of each triple, joined by commas; slots maps a slot to its column (its own name by default)."""
    at = lambda t: (slots or {}).get(t, F.col(t)) if len(t) == 1 else F.lit(t)
    return F.concat_ws(", ", *[F.concat(F.lit("<"), at(s), F.lit(", "), at(p), F.lit(", "), at(o), F.lit(">")) for s, p, o in parts])


def entailed(triples: DataFrame, pattern: Pattern | str, is_set: bool = False) -> DataFrame:
    """Slots, premise_knowledge and expected_output of every match."""
    pattern = PATTERNS[pattern] if isinstance(pattern, str) else pattern
    rows = match(triples, pattern, is_set)
    return rows.select(*rows.columns, rendered(pattern.premise).alias("premise_knowledge"), rendered(pattern.conclusion).alias("expected_output"))


def concluded(rows: DataFrame, pattern: Pattern) -> DataFrame:
    """One row (s, p, o) for each concluded triple of each slot row."""
    at = lambda t: F.col(t) if len(t) == 1 else F.lit(t)
    made = [F.struct(at(s).alias("s"), at(p).alias("p"), at(o).alias("o")) for s, p, o in pattern.conclusion]
    return rows.select(F.explode(F.array(*made)).alias("t")).select("t.*").distinct()


def closure(pairs: DataFrame, doublings: int = 30) -> DataFrame:
    """The reflexive transitive closure of pairs(s, o), each pair once; pairs with a null are left out.

    Semi-naive by doubling. Before step k, `known` holds the pairs less than 2^k apart by their shortest way and `far` those
    exactly 2^k apart. The step joins known to far, which gives all pairs less than 2^(k+1) apart, and far to itself, less
    what is known by then. So nothing that was joined before is joined again, a tree's pairs come up once each, and in a
    cycle, whose pairs come back by longer ways, far falls to nothing. New pairs are stored beside
    the earlier ones, which are not written again. An error if pairs are left after as many doublings.
    """
    edges = pairs.select("s", "o").dropna()
    known = [stored(edges.select("s").union(edges.select("o")).distinct().select("s", F.col("s").alias("o")))]
    far = stored(edges.where("s <> o").distinct())
    for _ in range(doublings):
        if far.isEmpty():
            break
        known.append(stored(_chained(reduce(DataFrame.unionAll, known), far, known)))
        longer = stored(_chained(far, far, known))
        discard(far)
        far = longer
    else:
        if not far.isEmpty():
            raise ValueError(f"no end of the hierarchy after {doublings} doublings")
    discard(far)
    return reduce(DataFrame.unionAll, known)


def _chained(left: DataFrame, right: DataFrame, known: list[DataFrame]) -> DataFrame:
    """Pairs from left's s over a shared middle to right's o that are not known, once each."""
    both = left.select("s", F.col("o").alias("via")).join(right.select(F.col("s").alias("via"), "o"), "via").select("s", "o").distinct()
    return both.join(reduce(DataFrame.unionAll, known), ["s", "o"], "left_anti")
