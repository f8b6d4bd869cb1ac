"""Hierarchies of one graph joined through equivalences with another: tables in place of one remote query for each property."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import local_name, property_name
from ..operators.sampling import first_wins, last_wins

SCHEMA_ORG, ONTOLOGY, RESOURCE = "https://schema.org/", "http://dbpedia.org/ontology/", "http://dbpedia.org/resource/"


def equivalents(pairs: DataFrame, namespace: str = ONTOLOGY) -> DataFrame:
    """(property, equivalent): those of pairs(property, equivalent) whose equivalent lies in the namespace, as often as they come; a property without any is simply not there."""
    return pairs.where(F.col("equivalent").startswith(namespace)).select("property", "equivalent")


def schema_equivalences(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(local, property, label) by schema.org local name and (property, local) by property, of rows(pos, property, label, equivalent): for each key the last row counts."""
    local = local_name(F.regexp_replace("equivalent", "/+$", ""))
    named = rows.where(F.col("equivalent").startswith(SCHEMA_ORG)).select("pos", "property", F.coalesce("label", F.lit("")).alias("label"), local.alias("local"))
    named = named.where("property <> '' AND local <> ''")
    by_local = last_wins(named, ["local"], "pos").select("local", "property", "label")
    return by_local, last_wins(named.drop("label"), ["property"], "pos").select("property", "local")


def in_namespace(facts: DataFrame, subjects: str = RESOURCE, objects: str = RESOURCE) -> DataFrame:
    """Triples whose ends are IRIs of the namespaces; both tests reach the scan."""
    return facts.where(F.col("s").startswith(subjects) & F.col("o").startswith(objects))


def name_shaped(iri, namespace: str):
    """Whether what follows the namespace starts with a letter."""
    return F.when(F.instr(iri, namespace) > 0, F.substring_index(iri, namespace, -1)).otherwise("").rlike("^[A-Za-z]")


def hierarchy_facts(hierarchy: DataFrame, same: DataFrame, facts: DataFrame, hops: int = 1) -> DataFrame:
    """a, b, i, i_label, i_dbp, j, j_label (k, k_label with two hops): hierarchy(child, child_label, parent, parent_label) x equivalents x facts(s, p, o).

    A three-way equi-join; hierarchy and equivalents are schema-sized, so the planner broadcasts them where it knows that.
    Nulls of labels are empty; rows with a = b go.
    """
    label = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    chain = hierarchy.select(F.col("child").alias("i"), label("child_label", "i_label"), F.col("parent").alias("j"), label("parent_label", "j_label"))
    if hops == 2:
        chain = chain.join(hierarchy.select(F.col("child").alias("j"), F.col("parent").alias("k"), label("parent_label", "k_label")), "j")
    known = chain.join(same.select(F.col("property").alias("i"), F.col("equivalent").alias("i_dbp")), "i")
    out = known.join(in_namespace(facts).select(F.col("s").alias("a"), F.col("p").alias("i_dbp"), F.col("o").alias("b")), "i_dbp").where("a <> b")
    return out.select("a", "b", "i", "i_label", "i_dbp", "j", "j_label", *(["k", "k_label"] if hops == 2 else []))


def with_classes(rows: DataFrame, edges: DataFrame, slot: str) -> DataFrame:
    """Rows of `hierarchy_facts` with the classes that edges(property, class), domains or ranges, give their i_dbp."""
    return rows.join(edges.select(F.col("property").alias("i_dbp"), F.col("class").alias(slot)), "i_dbp")


def subproperty_chains(hierarchy: DataFrame, schema_pairs: DataFrame, equal: DataFrame) -> DataFrame:
    """source, pos, i, i_label, j, j_label, k, k_label, j_wdt, j_wdt_label: chains of three properties from three places, the first of a name triple kept.

    hierarchy(pos, child, child_label, parent, parent_label); schema_pairs(pos, child, parent), local names; equal(pos, property,
    label, equivalent). wdt3hop: two steps of the hierarchy, three different properties; schema_p1: a schema.org step, then
    from its parent's equivalent a step of the hierarchy; schema_p2: a step of the hierarchy to a property with a schema.org
    equivalent, then a schema.org step. All three names must be there and differ; sources count in this order.
    """
    by_local, by_property = schema_equivalences(equal)
    h = hierarchy.select("pos", *[F.col(c) for c in ("child", "parent")], *[F.coalesce(c, F.lit("")).alias(c) for c in ("child_label", "parent_label")])
    up = h.select(F.col("pos").alias("pos2"), F.col("child").alias("parent"), F.col("parent").alias("top"), F.col("parent_label").alias("top_label"))
    null = F.lit(None).cast("string")
    cols = lambda **c: [(c[n] if n in c else null).alias(n) for n in ("source", "pos", "i", "i_label", "j", "j_label", "k", "k_label", "j_wdt", "j_wdt_label")]
    schema = lambda c: F.concat(F.lit(SCHEMA_ORG), c)
    order = lambda *p: F.struct(*[F.col(x).cast("long").alias(f"p{n}") for n, x in enumerate(p)])
    hops = h.join(up, "parent").where("child <> parent AND parent <> top AND child <> top")
    hops = hops.select(*cols(source=F.lit("wdt3hop"), pos=order("pos", "pos2"), i=F.col("child"), i_label=F.col("child_label"), j=F.col("parent"), j_label=F.col("parent_label"), k=F.col("top"), k_label=F.col("top_label")), F.col("child_label").alias("n1"), F.col("parent_label").alias("n2"), F.col("top_label").alias("n3"))
    s = schema_pairs.select(F.col("pos").alias("spos"), F.col("child").alias("low"), F.col("parent").alias("high"))
    steps = h.where("child <> parent")
    one = s.join(by_local.withColumnRenamed("local", "high"), "high").join(steps.select("pos", F.col("child").alias("property"), "parent", "parent_label"), "property")
    one = one.select(*cols(source=F.lit("schema_p1"), pos=order("spos", "pos"), i=schema(F.col("low")), j=schema(F.col("high")), j_wdt=F.col("property"), j_wdt_label=F.col("label"), k=F.col("parent"), k_label=F.col("parent_label")), F.col("low").alias("n1"), F.col("high").alias("n2"), F.col("parent_label").alias("n3"))
    two = steps.where("child_label <> ''").join(by_property.withColumnRenamed("property", "parent"), "parent").join(s.withColumnRenamed("low", "local"), "local")
    two = two.select(*cols(source=F.lit("schema_p2"), pos=order("pos", "spos"), i=F.col("child"), i_label=F.col("child_label"), j=schema(F.col("local")), j_wdt=F.col("parent"), j_wdt_label=F.col("parent_label"), k=schema(F.col("high"))), F.col("child_label").alias("n1"), F.col("local").alias("n2"), F.col("high").alias("n3"))
    every = hops.unionByName(one).unionByName(two)
    names = [property_name(F.col(n), True) for n in ("n1", "n2", "n3")]
    every = every.select("*", *[x.alias(f"name{n}") for n, x in enumerate(names)]).where("name0 <> '' AND name1 <> '' AND name2 <> '' AND name0 <> name1 AND name1 <> name2 AND name0 <> name2")
    rank = F.array_position(F.array(*map(F.lit, ("wdt3hop", "schema_p1", "schema_p2"))), F.col("source"))
    return first_wins(every, ["name0", "name1", "name2"], [rank, "pos"]).drop("n1", "n2", "n3", "name0", "name1", "name2")


def source_counts(rows: DataFrame) -> DataFrame:
    """source, n."""
    return rows.groupBy("source").agg(F.count("*").alias("n"))


def vocabulary(names: DataFrame, namespace: str, limit: int = 5000, seed: int = 42) -> DataFrame:
    """name: different local names of names(iri, label, lang) with an English label within the namespace and without Arabic letters, limit of them in an order that the seed fixes."""
    rows = names.where(F.col("iri").startswith(namespace) & (F.col("lang") == "en")).select(F.substring_index("iri", namespace, -1).alias("name")).where("name <> ''")
    rows = rows.where(~F.col("name").rlike(r"[؀-ۿ]")).distinct()
    return rows.orderBy(F.xxhash64(F.lit(seed), "name"), "name").limit(limit)
