"""Audits over two graphs: identities, what no graph can hold, names that stand for two things."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tripleforge.functions import terms
from tripleforge.operators import audit, prompts, variants
from tripleforge.plans.bgp import closure
from tripleforge.sources import storage

WD, R, O = terms.WIKIDATA, terms.RESOURCE, audit.ONTOLOGY


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture
def linked_rows(spark):
    """Rows of rdfs7: facts of one graph, the hierarchy of the other."""
    rows = [("s1", R + "A", R + "B", WD + "P1", O + "knows", WD + "P2", "knows", "met by"), ("s2", R + "C", R + "D__1", WD + "P1", O + "knows", WD + "P2", "knows", "met by")]
    return spark.createDataFrame(rows, "source string, a string, b string, i string, i_dbp string, j string, i_label string, j_label string")


def test_two_graphs(spark, linked_rows):
    terms_ = variants.source_terms("rdfs7")
    rk = variants.real(linked_rows, "rdfs7", ["source"], terms_)
    assert rk.where("source = 's1'").first().premise_knowledge == "<knows, rdfs:subPropertyOf, metBy>, <A, knows, B>"
    ls = variants.locally_shuffled(linked_rows, "rdfs7", ["source"], terms_)
    changed = audit.induced(ls, rk, ["source"])
    asks = {(r.source, r.at): r for r in audit.induced_asks(changed, linked_rows, "rdfs7", ["source"]).collect()}
    assert asks["s1", 0].state == "never" and asks["s1", 1].state == "identity" and asks["s1", 1].p == WD + "P2"  # metBy comes from the other graph
    same = spark.createDataFrame([(R + "A", WD + "Q1"), (R + "B", WD + "Q2"), (R + "B", WD + "Q3"), (R + "C", WD + "Q4"), (R + "D__1", WD + "Q5")], "s string, o string")
    graph = spark.createDataFrame([(WD + "Q3", WD + "P2", WD + "Q1")], "s string, p string, o string")
    answers = audit.answered(audit.induced_asks(changed, linked_rows, "rdfs7", ["source"]), graph, same, ["source"])
    got = {r.source: r.verdict for r in audit.judged(answers, ["source"]).collect()}
    assert got == {"s1": "present", "s2": "identity_unresolved"}  # any pair of entities; a name with __ is never resolved
    assert {r.name: r.ids for r in audit.identities(spark.createDataFrame([(R + "B",), (R + "D__1",), (R + "Z",)], "name string"), same).collect()} == {R + "B": [WD + "Q2", WD + "Q3"], R + "Z": []}


def test_bindings_of_global_shuffles(spark):
    rows = spark.createDataFrame([("s1", R + "A", O + "p", R + "B", O + "X"), ("s2", R + "A", O + "p", R + "C", O + "X"), ("s3", R + "E", O + "q", R + "E", O + "Y")], "source string, a string, i string, b string, x string")
    gs = variants.globally_shuffled(rows.withColumn("entry", F.col("source")), "rdfs2", ["entry"], terms=variants.source_terms("rdfs2", False))
    extra = spark.createDataFrame([("bad", "<p, rdfs:domain, X>", ""), ("lost", "<X, rdfs:domain, Nobody>, <B, X, p>", ""), ("torn", "<X, rdfs:domain, A>, <B, Z, p>", "")], "entry string, premise_knowledge string, expected_output string")
    got = {r.entry: r for r in audit.resolved(gs.unionByName(extra), rows, "rdfs2", ["entry"]).collect()}
    assert got["s1"].error is None and {b.slot: b.origin for b in got["s1"].bindings} == {"a": "b", "b": "i", "i": "x", "x": "a"}
    assert {b.slot: b.uri for b in got["s2"].bindings}["a"] == R + "C"
    assert got["bad"].error and got["lost"].error == "no source entry explains the premise" and "two terms" in got["torn"].error
    twice = rows.unionByName(rows.where("source = 's1'").withColumn("source", F.lit("s9")))
    again = {r.entry: r.error for r in audit.resolved(gs, twice, "rdfs2", ["entry"]).collect()}
    assert again["s1"] == "several source entries explain the premise" and again["s2"] is None
    bound = audit.resolved(gs.unionByName(extra), rows, "rdfs2", ["entry"])
    none = spark.createDataFrame([], "s string, p string, o string")
    v = {r.entry: r.verdict for r in audit.judged(audit.answered(audit.classified(bound, "rdfs2", ["entry"]), none, none.select("s", "o"), ["entry"]), ["entry"]).collect()}
    assert v["s1"] == "structural" and v["bad"] == "error"
    r = audit.rates(spark.createDataFrame(list(v.items()), "entry string, verdict string").withColumn("k", F.lit(1)), ["k"]).first()
    assert (r.total, r.judged, r.counterfactual) == (len(v), sum(x != "error" for x in v.values()), sum(x != "error" for x in v.values())) and r.rate == 10**12


def test_interpretations(spark):
    """Two terms that one spelling makes equal: every one-to-one way counts."""
    rows = spark.createDataFrame([("s1", O + "aB", O + "AB", O + "c")], "source string, x string, y string, a string").select("source", F.col("a"), "x", "y")
    entry = spark.createDataFrame([("e", "<AB, rdfs:subClassOf, C>, <A_B, rdf:type, AB>")], "entry string, premise_knowledge string")
    got = audit.interpretations(entry, rows, "rdfs9", ["entry"]).collect()
    assert [r.error for r in got] == ["no source entry explains the premise"]  # nothing is spelled A_B but what stands at its own place
    choices = [[0, 1], [1, 2], [0, 2]]
    out = spark.createDataFrame([(choices,), ([[0], [0]],), ([],)], "c array<array<int>>").select(audit.matchings("c").alias("x")).collect()
    assert [sorted(map(tuple, r.x)) for r in out] == [[(0, 1, 2), (1, 2, 0)], [], [()]]


def test_term_functions(spark):
    text = lambda c: one(spark, c)
    assert text(terms.unwrapped(F.lit(R + R + R + "Germany"))) == R + "Germany" and text(terms.unwrapped(F.lit(R + "x"))) == R + "x"
    assert text(terms.url_encoded(F.lit("É (a),b'c!*~-._+/"))) == "%C3%89%20(a),b'c!*~-._%2B%2F"
    assert text(terms.entity_number(F.lit(WD + "Q42"))) == "Q42" and text(terms.entity_number(F.lit(WD + "P1"))) is None
    assert text(terms.path_safe(F.lit("a b/çd.e"))) == "a_b_d.e"
    assert text(terms.uid("b", F.lit("x"))) == text(terms.uid("b", F.lit("x"))) and len(text(terms.uid("f"))) == 10
    assert text(terms.source_name(F.lit(None).cast("string"), F.array(F.lit("https://query.wikidata.org")))) == "wdt" and text(terms.source_name(F.lit("mine"), F.array(F.lit("dbpedia")))) == "mine"
    assert text(terms.utc_text(F.lit(951_782_399).cast("long"))) == "20000228235959"
    assert [text(terms.duration_text(F.lit(x))) for x in (3.2, 61.0, 3725.9)] == ["3.2s", "1m1s", "1h2m5s"]
    assert text(terms.property_of(F.lit(WD + "P1"), F.lit("crosses river2 (bridge)"))) == "crossesRiver2Bridge" and text(terms.property_of(F.lit(O + "fooBar"), F.lit("x"))) == "fooBar"
    assert text(terms.instance_name(F.lit("Cristián Köln Ørsted (x)"), True)) == "Cristian_Koln_Rsted_(_X_)"
    assert text(terms.class_name(F.lit("Cristián café"), True)) == "CristianCafe"
    assert text(terms.expected_text(F.lit("<a>"), F.lit("ARP-def"), F.lit("rdfs2_11"))) == "<a>\n[used_rules: ruleA, ruleF]" and text(terms.expected_text(F.lit(""), F.lit("ARP-name"), F.lit("rdfs9"))) == "[used_rules: rdfs9]" and text(terms.expected_text(F.lit("<a>"), F.lit("NRP-full"), F.lit("rdfs9"))) == "<a>"
    assert text(terms.input_text(F.lit('{"body":{"messages":[{"content":"a"},{},{"content":"b"}]}}'))) == "a\n\nb" and text(terms.input_text(F.lit('{"system":"s","input":"i"}'))) == "s\ni" and text(terms.input_text(F.lit('{"input":"i"}'))) == "i"
    a, b = "sameAs query error x", "none found"
    assert text(terms.sameas_error(F.lit(a), F.lit(b), F.lit(a))) == a and text(terms.sameas_error(F.lit(b), F.lit(None).cast("string"))) is None
    empty = F.array().cast("array<string>")
    assert text(terms.unresolved_reason(empty, F.lit(a), F.array(F.lit("Q1")), F.lit(None).cast("string"))) == f"s={a}" and text(terms.unresolved_reason(empty, F.lit(None).cast("string"), empty, F.lit(b))) == f"s=unresolved; o={b}"
    for triple, candidate, want in (("a, b, c", " a ,b c\x1c", True), ("a, b, c d", "a b c d", True), ("a, b, c", ", a b c", False), ("a, b, c", "a b c d", False), ("a b, c, d", "a b c d", True), ("x, \\E, y", "x \\E y", True)):
        assert text(terms.flexible(F.lit(candidate), F.lit(triple))) is want, (triple, candidate)


def test_templates():
    ids = {(c, p): prompts.template_id(c, p) for c in prompts.CONDITIONS for p in ("rdfs2", "rdfs9", "rdfs2_3", "")}
    for c in prompts.CONDITIONS:
        assert ids[c, "rdfs2"] == ids[c, "rdfs9"] and ids[c, "rdfs2_3"] == ids[c, ""]  # one for all patterns of a kind
        assert (ids[c, "rdfs2"] == ids[c, "rdfs2_3"]) == c.startswith("ARP")
    assert len(set(ids.values())) == 9 and prompts.rule_keys("rdfs2_4_7") == ["rdfs2", "rdfs7"] and prompts.rule_keys("x2") == []
    assert prompts.is_valid("NRP-def", 3) and not prompts.is_valid("NRP-def", 4)


def test_conditions(spark):
    assert one(spark, prompts.condition_column(F.lit(" nrp-FULL "))) == "NRP-full"
    with pytest.raises(Exception, match="unknown prompting"):
        one(spark, prompts.condition_column(F.lit("x")))
    assert one(spark, prompts.rule_key_column(F.lit("rdfs9_11_4"))) == ["rdfs9", "rdfs11"]


def test_random_vocabulary(spark, monkeypatch):
    """Slots that must differ do, all choices come up alike, and a vocabulary too large to send to all gives the same rows; nulls, empty and repeated names count as the docstring says."""
    from collections import Counter

    words = {k: spark.createDataFrame([(f"{k}{i}",) for i in range(4)] * 2 + [("",), (None,)], "name string") for k in ("instance", "class", "property")}
    rows = variants.random_vocabulary(spark, "rdfs2_3", words, 50).collect()
    assert len(rows) == 50 and all("<" in r.premise_knowledge for r in rows)
    with pytest.raises(ValueError):
        variants.random_vocabulary(spark, "rdfs11", words | {"class": words["class"].where("name < 'class2'")}, 5)
    many = variants.random_vocabulary(spark, "rdfs11", words, 2400).collect()
    seen = Counter(r.premise_knowledge for r in many)  # <x, sc, y>, <y, sc, z>: 4 * 3 * 2 choices
    assert len(seen) == 24 and all(50 < n < 160 for n in seen.values())
    twice = variants.random_vocabulary(spark, "rdfs11", words, ids=spark.createDataFrame([(7,), (7,), (9,)], "id long")).collect()
    assert [r for r in twice if r.id == 7] == [next(r for r in many if r.id == 7)] * 2 and len(twice) == 3
    assert variants.random_vocabulary(spark, "rdfs11", words, ids=spark.range(0)).count() == 0
    monkeypatch.setattr(variants, "BROADCAST_BYTES", 0)
    assert sorted(variants.random_vocabulary(spark, "rdfs2_3", words, 50).collect()) == sorted(rows)


def test_label_metadata(spark):
    assert variants.label_metadata(spark.createDataFrame([(1,)], "i_label int"), "fold") == {"wikidata_label_conversion": "fold"} and variants.label_metadata(spark.range(1), "fold") == {}


def test_all_variants(spark):
    rows = {"rdfs9": spark.createDataFrame([(R + "Café", O + "Cat", O + "Animal"), (R + "X", O + "Dog", O + "Dog")], "a string, x string, y string")}
    words = {k: spark.createDataFrame([(f"{k}{i}",) for i in range(9)], "name string") for k in ("instance", "class", "property")}
    got = variants.build_all(rows, words, spark, n=4)
    n = {r.dataset_variant: r["count"] for r in got.groupBy("dataset_variant").count().collect()}
    assert n == {"rk": 2, "ls": 1, "gs": 1, "gsc": 1, "ns": 4, "nsc": 4, "rva": 4}


def test_closure_of_cycles(spark):
    """Random graphs with cycles, pairs of one node with itself, repeated and null pairs against a search from every node."""
    import random

    draw = random.Random(3)
    for n, m in ((12, 14), (30, 25), (6, 30)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(40, 40), (50, 51), (51, 52), (52, 50)]
        after = {}
        for s, o in edges:
            after.setdefault(s, set()).add(o)
        want = set()
        for v in {x for e in edges for x in e}:
            seen, open_ = {v}, [v]
            while open_:
                for o in after.get(open_.pop(), ()):
                    if o not in seen:
                        seen.add(o)
                        open_.append(o)
            want |= {(str(v), str(o)) for o in seen}
        got = [tuple(r) for r in closure(spark.createDataFrame([*map(lambda e: (str(e[0]), str(e[1])), edges * 2), (None, "1"), ("1", None)], "s string, o string")).collect()]
        assert sorted(got) == sorted(want)
    assert closure(spark.createDataFrame([], "s string, o string")).count() == 0


def test_closure_ends(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)], "s string, o string")
    assert closure(chain).count() == 21 * 22 // 2
    with pytest.raises(ValueError):
        closure(chain, doublings=3)


def test_triples_and_rules_as_written(spark):
    """Names hold commas, ends hold any white space, an empty rule counts."""
    got = one(spark, terms.strict_triples(F.lit("<country, rdfs:domain, Place>, <Paris,_Texas, country, \u00a0United_States\n>, <Paris,_Texas, country,\u00a0 United_States>, <a,b,c>, <a, b>")))
    assert [tuple(t) for t in got] == [("country", "rdfs:domain", "Place"), ("Paris,_Texas", "country", "United_States")]
    assert [tuple(t) for t in one(spark, terms.strict_triples(F.lit("<Paris,_Texas, country, \t United_States\x1c>")))] == [("Paris,_Texas", "country", "United_States")]
    rules = lambda t: one(spark, terms.used_rules(F.lit(t)))
    assert rules("x [used_rules: rdfs2,\nrdfs7]") == ["rdfs2", "rdfs7"] and rules("[used_rules: rdfs2, ]") == ["rdfs2", ""] and rules("[used_rules: ruleA\x1f,ruleX]") == ["rdfs2", "ruleX"]
    assert rules("[used_rules:]") == [] and rules("[used_rules: ]") == [""] and rules("none") == [] and rules("[used_rules: a] [used_rules: b]") == ["a"]
    entry = spark.createDataFrame([("e", "<country, rdfs:domain, Place>, <Paris,_Texas, country, United_States>")], "entry string, premise_knowledge string")
    assert audit.dest_terms(entry, "rdfs2").first().spec_error is None


def test_bindings_stay_linear_where_every_term_is_common(spark):
    """400 sources of 20 names each way: an entry meets its one source, not all that share a term; repeated terms and sources are found as by trying all."""
    n = 20
    rows = [(f"s{a}_{b}", R + f"A{a}", R + f"B{b}", O + "p", O + "X") for a in range(n) for b in range(n)]
    rows += [("dup", R + "A0", R + "B0", O + "p", O + "X"), ("same", R + "A1", R + "A1", O + "p", O + "X")]
    sources = spark.createDataFrame(rows, "source string, a string, b string, i string, x string")
    texts = [(f"e{a}_{b}", f"<X, rdfs:domain, A{a}>, <B{b}, X, p>") for a in range(n) for b in range(0, n, 7)] + [("twice", "<X, rdfs:domain, A3>, <A3, X, X>"), ("none", "<X, rdfs:domain, A3>, <A3, X, Z>")]
    entries = spark.createDataFrame(texts, "entry string, premise_knowledge string")
    got = {r.entry: r.error for r in audit.resolved(entries, sources, "rdfs2", ["entry"]).collect()}
    assert len(got) == len(texts)
    for key, text in texts:
        told = {"x": text.split("domain, ")[1].split(">")[0], "a": text.split("<")[2].split(",")[0], "i": "X", "b": text.rsplit(", ", 1)[1].rstrip(">")}
        fit = sum(all([x.rsplit("/", 1)[1] for x in r[1:]].count(t) == 1 for t in told.values()) for r in rows)
        assert (got[key] is None) == (fit == 1) and (fit < 2 or "several" in got[key]) and (fit or "no source" in got[key]), key


def test_presence_of_asks_that_all_entries_share(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('s', id) END AS s", "'p' AS p", "CASE WHEN id % 3 = 1 THEN 'lost' ELSE 'o' END AS o")
    graph = spark.createDataFrame([("hot", "p", "o")] * 2 + [(f"s{i}", "p", "o") for i in range(2, 3000, 6)] + [("x", "y", "z")], "s string, p string, o string")
    known, n = audit.answers(rows, graph)
    assert n == 3000 and known.count() == 1002 and known.where("s = 'hot' AND o = 'o'").first().hit
    near = audit._near(graph, known, known.count())
    assert near.where("s = 'x'").count() == 0 and near.where("s = 'hot'").count() == 2
    got = audit.looked_up(rows, known, n).collect()
    assert len(got) == 3000 and all(r.hit == (r.id % 3 == 0 or (r.id % 3 == 2 and r.id % 6 == 2)) for r in got)
    assert audit.looked_up(rows.limit(0), *audit.answers(rows.limit(0), graph)).count() == 0


def test_sources_beside_their_entries(spark, linked_rows):
    """Entries that carry their source's columns are asked as by joins with the sources, without any."""
    shared = spark.createDataFrame([("s3", R + "A", R + "A__2", WD + "P1", O + "knows", WD + "P2", "knows", "knows"), ("s4", R + "É, b", R + "B", WD + "P3", O + "knows", WD + "P4", "x", "x")], linked_rows.schema)
    rows, named = linked_rows.unionByName(shared), variants.source_terms("rdfs7")
    joined = audit.induced(variants.locally_shuffled(rows, "rdfs7", ["source"], named), variants.real(rows, "rdfs7", ["source"], named), ["source"])
    sources = variants.real(rows, "rdfs7", rows.columns, named).withColumnRenamed("premise_knowledge", "source_premise").drop("expected_output")
    beside = audit.induced(variants.locally_shuffled(sources, "rdfs7", sources.columns, named), None, ["source"])
    asks = audit.induced_asks(beside, None, "rdfs7", ["source"])
    assert "Join" not in asks._jdf.queryExecution().optimizedPlan().toString()
    want = audit.induced_asks(joined, rows, "rdfs7", ["source"])
    assert asks.columns == want.columns and asks.count() > 4 and sorted(map(repr, asks.collect())) == sorted(map(repr, want.collect()))


def test_asks_are_stored_once(spark, monkeypatch):
    """What is asked is written once, and what can't meet the graph is not shuffled; hits are those of a set, nulls and shared asks too."""
    entries = spark.range(2000).selectExpr("id", "concat('<j, rdfs:subPropertyOf, i>, <b', id, ', ', CASE WHEN id % 10 = 0 THEN 'i' ELSE 'j' END, ', a', id % 7, '>') AS premise_knowledge")
    graph = spark.range(2000).selectExpr("concat('b', id) AS s", "CASE WHEN id % 20 = 0 THEN 'i' ELSE 'k' END AS p", "concat('a', id % 7) AS o").unionByName(spark.createDataFrame([("i", "rdfs:subPropertyOf", "j"), (None, "i", "x")], "s string, p string, o string"))
    tables = []
    monkeypatch.setattr(audit, "stored", lambda d: tables.append(storage.stored(d)) or tables[-1])
    got = audit.present(entries, graph, ["id"])
    assert {(r.id, r.at): r.found for r in got.collect()} == {(n, at): at == 1 and n % 20 == 0 for n in range(2000) for at in (0, 1)}
    assert sum(t.count() for t in tables) < 4500  # 4000 asks, 100 rows of the graph and what shares their hashes
    rows = storage.stored(spark.createDataFrame([(None, "i", "x"), ("i", "rdfs:subPropertyOf", "j"), ("i", None, "j"), *[("b0", "i", "a0")] * 3], "s string, p string, o string"))
    assert sorted(r.hit for r in audit.found(rows, graph).collect()) == [False, False, True, True, True, True]
    assert audit.found(rows.limit(0), graph).count() == 0


def test_tables_and_shuffles_go_with_their_use(spark):
    files = lambda: sum("shuffle" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before, made = files(), []

    def make():
        made.append(storage.stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()))
        return made[0].groupBy("count").agg(F.count("*").alias("n"))

    out = storage.stored_alone(make)
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before and not Path(made[0]._stored_at).exists()
    assert out.agg(F.sum("n")).first()[0] == 7


def test_entries_beside_their_sources(spark, monkeypatch):
    """Entries that carry their source are bound as by the join with all sources: also where sources share terms, an entry repeats one, or another source explains it."""
    rows = [(f"s{n}", R + f"A{n}", R + f"B{n % 4}", O + "p", O + "X") for n in range(8)] + [("dup", R + "A0", R + "B0", O + "p", O + "X"), ("turned", R + "B1", R + "A1", O + "p", O + "X"), ("same", R + "A1", R + "A1", O + "p", O + "X")]
    sources = spark.createDataFrame(rows, "source string, a string, b string, i string, x string")
    texts = "CASE source WHEN 's2' THEN '<X, rdfs:domain, A5>, <B1, X, p>' WHEN 's3' THEN '<X, rdfs:domain, A3>, <A3, X, X>' WHEN 's4' THEN '<X, rdfs:domain, A4>' ELSE concat('<X, rdfs:domain, ', substring_index(a, '/', -1), '>, <', substring_index(b, '/', -1), ', X, p>') END"
    entries = sources.selectExpr("source AS entry", f"{texts} AS premise_knowledge", "struct(*) AS own")
    got, want = (sorted(map(repr, f(e, sources, "rdfs2", ["entry"]).collect())) for f, e in ((audit.resolved_beside, entries), (audit.resolved, entries.drop("own"))))
    assert got == want and len(got) == 11 and sum("error=None" in x for x in got) == 5
    few, one_by_one = sources.where("source IN ('s5', 's6', 's7')"), entries.where("entry IN ('s5', 's6', 's7')")
    monkeypatch.setattr(audit, "resolved", None)  # nothing is left to join
    bound = audit.resolved_beside(one_by_one, few, "rdfs2", ["entry"])
    assert "Join" not in bound._jdf.queryExecution().optimizedPlan().toString() and [r.error for r in bound.collect()] == [None] * 3
