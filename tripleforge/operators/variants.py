"""The seven dataset variants: real, locally and globally shuffled, case-converted, random tokens, random vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import as_kind, deranged, local_name, property_name, property_of, slot_kind
from ..plans.bgp import rendered
from ..plans.patterns import LINKED, PATTERNS, Pattern

ALPHANUMERIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _entries(rows: DataFrame, pattern: Pattern, terms: dict[str, Column], keep: list[str], made: bool = False) -> DataFrame:
    """Entries of the rows that have all terms. made: terms are more than columns; they are computed before the rows are tested, as a filter over them would compute them again."""
    if made:
        rows = rows.select(*keep, F.explode(F.array(F.struct(*[terms[s].alias(s) for s in pattern.slots]))).alias("__t"))
        terms = {s: F.col("__t")[s] for s in pattern.slots}
    whole = reduce(lambda a, b: a & b, [terms[s].isNotNull() & (terms[s] != "") for s in pattern.slots])
    return rows.where(whole).select(*keep, rendered(pattern.premise, terms).alias("premise_knowledge"), rendered(pattern.conclusion, terms).alias("expected_output"))


def plain_terms(pattern: str) -> dict[str, Column]:
    """Rows whose slots hold terms already."""
    return {s: F.col(s) for s in PATTERNS[pattern].terms}


def source_terms(pattern: str, fold: bool = True) -> dict[str, Column]:
    """Terms of rows of a sample: local names of the slots' URIs. In linked patterns i is that of i_dbp, j and k are made of j_label and k_label; in rdfs5 each property is named by its graph's rule."""
    out = {s: local_name(F.col(s)) for s in PATTERNS[pattern].terms}
    if pattern in LINKED:
        out |= {"i": local_name(F.col("i_dbp"))} | {s: property_name(F.col(f"{s}_label"), fold) for s in "jk" if s in out}
    if pattern == "rdfs5":
        out = {s: property_of(F.col(s), F.col(f"{s}_label"), fold) for s in out}
    return out


def real(rows: DataFrame, pattern: str, keep: list[str] = [], terms: dict[str, Column] | None = None) -> DataFrame:
    """Entries as the source has them; rows that lack a term are left out."""
    return _entries(rows, PATTERNS[pattern], terms or plain_terms(pattern), keep, made=terms is not None)


def _locally(p: Pattern, before: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """New terms and whether all swaps change something."""
    terms, ok = dict(before), F.lit(True)
    for group in p.swaps:
        new = F.array(before[group[1]], before[group[0]]) if len(group) == 2 else deranged([before[s] for s in group])
        if len(group) > 2:
            ok = ok & new.isNotNull()
        terms |= {s: new[i] for i, s in enumerate(group)}
    for a, b in p.moved or tuple(g for g in p.swaps if len(g) == 2):
        ok = ok & (before[a] != before[b])
    return terms, ok


def locally_shuffled(rows: DataFrame, pattern: str, keep: list[str] = [], terms: dict[str, Column] | None = None) -> DataFrame:
    """Slots of one kind change places; rows where nothing would change are left out."""
    p = PATTERNS[pattern]
    new, ok = _locally(p, terms or plain_terms(pattern))
    return _entries(rows.where(ok), p, new, keep, made=True)


def globally_shuffled(rows: DataFrame, pattern: str, keep: list[str] = [], converted: bool = False, terms: dict[str, Column] | None = None, spelled: dict[tuple[str, str], Column] = {}) -> DataFrame:
    """All terms of a row are deranged together, in the order of `Pattern.terms`; converted spells each as its new slot's kind. Not for rdfs5 and rdfs11, which have one kind.

    spelled: spellings of a slot's term by kind, (slot, kind) -> column, that are there already. With them, or without spelling,
    rows that the first rotation serves, nearly all, take their terms straight from the columns beside, and only the others
    search a derangement; rows are then read twice.
    """
    p = PATTERNS[pattern]
    if pattern in ("rdfs5", "rdfs11"):
        raise ValueError(f"{pattern} has slots of one kind only")
    before = terms or plain_terms(pattern)
    turned = dict(zip(p.terms, p.terms[1:] + p.terms[:1]))
    beside = {s: spelled.get((t, slot_kind(s))) if converted else before[t] for s, t in turned.items()}
    at_once = all(t is not None for t in beside.values())
    first = reduce(lambda a, b: a & b, [before[s] != before[t] for s, t in turned.items()])
    left = rows.where(~F.coalesce(first, F.lit(False))) if at_once else rows
    moved = left.select(*keep, F.explode(F.array(deranged([before[s] for s in p.terms]))).alias("__d")).where("__d IS NOT NULL")  # exploded, so that what reads it does not repeat it
    new = {s: F.col("__d")[i] for i, s in enumerate(p.terms)}
    searched = _entries(moved, p, {s: as_kind(t, s) for s, t in new.items()} if converted else new, keep, made=converted)
    return _entries(rows.where(first), p, beside, keep).unionByName(searched) if at_once else searched


def _digest(seed: int, *parts: Column | str) -> Column:
    """32 hex digits that the seed and the parts fix, and that any SQL engine finds again."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def _number(digest: Column, at: Column | int, digits: int = 4) -> Column:
    """The number that the digits from place `at` on spell."""
    return F.conv(F.substring(digest, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("long")


def _letters(digest: Column, start: int, n: Column, alphabet: str) -> Column:
    """n letters, each by four digits of the digest."""
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.lit(alphabet), (_number(digest, start + 4 * i) % len(alphabet) + 1).cast("int"), F.lit(1))), "")


def nonsense(spark: SparkSession, pattern: str, n: int = 400, seed: int = 42, cased: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """n rows, or one for each of ids(id), of random tokens that seed and id fix: eight letters or digits, or (cased) one to three words of three to six letters in the spelling of the slot's kind."""
    p = PATTERNS[pattern]

    def word(slot: str, i: Column) -> Column:
        drawn = _digest(seed, slot, F.col("id"), i)
        return _letters(drawn, 5, (_number(drawn, 1) % 4 + 3).cast("int"), ALPHANUMERIC[:26])

    def token(slot: str) -> Column:
        drawn = _digest(seed, slot, F.col("id"))
        if not cased:
            return _letters(drawn, 1, F.lit(8), ALPHANUMERIC)
        return as_kind(F.array_join(F.transform(F.sequence(F.lit(1), (_number(drawn, 1) % 3 + 1).cast("int")), lambda i: word(slot, i)), " "), slot)

    return _entries(spark.range(n) if ids is None else ids.select("id"), p, {s: token(s) for s in p.slots}, ["id"], made=True)


def numbered(names: DataFrame) -> tuple[DataFrame, int, int]:
    """(name, at) with the different names numbered from 0 by the first two digits of their digest and their bytes; how many they are, and of how many bytes.

    Each of the 256 ranges is numbered by itself from the sizes of those before, so no task holds a vocabulary.
    """
    words = names.select("name").where("name <> ''").distinct().withColumn("part", F.substring(F.md5(F.col("name").cast("binary")), 1, 2))
    starts, size, bytes_ = {}, 0, 0
    for r in sorted(words.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("name")).alias("bytes")).collect()):  # 256 rows
        starts[r.part], size, bytes_ = size, size + r.n, bytes_ + r.bytes
    if not size:
        return words.select("name", F.lit(0).cast("long").alias("at")), 0, 0
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    return words.select("name", (start[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1).cast("long").alias("at")), size, bytes_


def _places(seed: int, group: str, size: int) -> Column:
    """A different place under `size` for each slot of the group, all choices alike: a slot draws among the places that are left, and steps over those taken before it."""
    draws = F.array(*[_number(_digest(seed, s, F.col("id")), 1, 15) for s in group])
    step = lambda taken, d: F.concat(taken, F.array(F.aggregate(F.array_sort(taken), F.pmod(d, F.lit(size) - F.size(taken)), lambda at, t: F.when(at >= t, at + 1).otherwise(at))))
    return F.aggregate(draws, F.array().cast("array<bigint>"), step)


#: Vocabularies of at most this many bytes and names go to all tasks. In larger ones a name's share of the draws is too small to make a hot key.
BROADCAST_BYTES, BROADCAST_NAMES = 32 << 20, 1 << 20


def random_vocabulary(spark: SparkSession, pattern: str, vocabulary: dict[str, DataFrame], n: int = 400, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """n rows, or one for each of ids(id), whose slots are drawn from vocabularies (kind -> DataFrame of name), with the pattern's slots kept apart.

    Seed, id and vocabularies fix the rows. Slots that must differ are drawn without putting back, so no row is refused and drawn again.
    A null or empty name is none, and names count once; a vocabulary too small for the slots that must differ is an error. Rows of one id are alike.
    """
    p = PATTERNS[pattern]
    kinds = {}
    for kind in dict.fromkeys(map(slot_kind, p.slots)):
        kinds[kind] = numbered(vocabulary[kind])
        need = max([sum(slot_kind(s) == kind for s in g) for g in p.drawn_distinct] + [1])
        if kinds[kind][1] < need:
            raise ValueError(f"{kind}: {kinds[kind][1]} names for {need} different slots")
    groups = [*p.drawn_distinct, *(s for s in p.slots if not any(s in g for g in p.drawn_distinct))]
    rows = (spark.range(n) if ids is None else ids.select("id")).select("id", *[_places(seed, g, kinds[slot_kind(g[0])][1]).alias(f"at_{g}") for g in groups])
    rows = rows.select("id", *[F.col(f"at_{g}")[i].alias(f"at_{s}") for g in groups for i, s in enumerate(g)])
    for s in p.slots:
        words, size, bytes_ = kinds[slot_kind(s)]
        words = words.select(F.col("name").alias(s), F.col("at").alias(f"at_{s}"))
        rows = rows.join(F.broadcast(words) if bytes_ <= BROADCAST_BYTES and size <= BROADCAST_NAMES else words, f"at_{s}")
    return _entries(rows, p, plain_terms(pattern), ["id"])


def label_metadata(rows: DataFrame, conversion: str) -> dict[str, str]:
    """Whether rows have label columns, and how labels become names."""
    return {"wikidata_label_conversion": conversion} if any(c.endswith("_label") for c in rows.columns) else {}


def build_all(rows: dict[str, DataFrame], vocabulary: dict[str, DataFrame], spark: SparkSession, n: int = 400, linked: bool = True) -> DataFrame:
    """All variants of all patterns (pattern -> sample rows) as one table: pattern_id, dataset_variant, premise_knowledge, expected_output; what a pattern has no variant for is left out."""
    out = []
    for pattern, table in rows.items():
        terms = {fold: source_terms(pattern, fold) if linked else None for fold in (True, False)}
        made = {"rk": real(table, pattern, terms=terms[True]), "ls": locally_shuffled(table, pattern, terms=terms[True])}
        if pattern not in ("rdfs5", "rdfs11"):
            made |= {v: globally_shuffled(table, pattern, converted=v == "gsc", terms=terms[False]) for v in ("gs", "gsc")}
        made |= {"ns": nonsense(spark, pattern, n), "nsc": nonsense(spark, pattern, n, cased=True), "rva": random_vocabulary(spark, pattern, vocabulary, n)}
        out += [d.select(F.lit(pattern).alias("pattern_id"), F.lit(v).alias("dataset_variant"), "premise_knowledge", "expected_output") for v, d in made.items()]
    return reduce(DataFrame.unionByName, out)
