"""Worked examples of term, text and metric functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tripleforge.functions import terms
from tripleforge.operators import prompts, scoring
from tripleforge.plans.patterns import PATTERNS, chosen
from tripleforge.sources.names import eval_name, response_name, task_key, uids


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col).first()[0]


def test_names(spark):
    s = F.col("s")
    assert one(spark, terms.property_name(s), s="crosses river2 (bridge)") == "crossesRiver2Bridge"
    assert one(spark, terms.class_name(s), s="river clyde2 (bridge)") == "RiverClyde2Bridge"
    assert one(spark, terms.instance_name(s), s="river clyde2 (bridge)") == "River_Clyde_2_(_Bridge_)"
    assert one(spark, terms.split_words(s), s="USGovernment A1") == ["US", "Government", "1"]
    for text in ("AB\nc", "AB\n_cD", "AB\r\n x", "ABc_DE f", "a__B  (c)1", "(", " ", "é1B", "AB\nC \n"):
        parts = [w for part in re.split("[ _]+", text) for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|(?:\r\n)?$)|[0-9]+|[()]", part)]
        assert one(spark, terms.split_words(s), s=text) == parts
        assert one(spark, terms.instance_name(s), s=text) == "_".join(w.capitalize() for w in parts)
        words = [w for w in parts if w not in "()"]
        assert one(spark, terms.class_name(s), s=text) == "".join(w.capitalize() for w in words)
        assert one(spark, terms.property_name(s), s=text) == "".join(w.capitalize() if i else w.lower() for i, w in enumerate(words))
    assert one(spark, terms.ascii_fold(s), s="Köln café Ø") == "Koln cafe Ø"
    assert one(spark, terms.local_name(s), s="http://dbpedia.org/resource/AC/DC") == "DC"


def test_derangement(spark):
    def got(*v):
        return one(spark, terms.deranged([F.col(f"c{i}") for i in range(len(v))]), **{f"c{i}": x for i, x in enumerate(v)})

    assert got("p", "q", "r") == ["q", "r", "p"]
    assert got("p", "p", "q") is None
    assert got("p", "p", "q", "q") == ["q", "q", "p", "p"]
    five = got("a", "a", "b", "c", "b")
    assert five is not None and all(x != y for x, y in zip(five, "aabcb")) and sorted(five) == sorted("aabcb")
    random.seed(1)
    for _ in range(10):
        v = [random.choice("ab") for _ in range(5)]
        assert got(*v) is None  # of two values over five places one holds more than half


def test_candidates(spark):
    s = F.col("s")
    assert one(spark, terms.candidates(s), s='< a, b, c > <"d", e, f> <think>') == ["a, b, c", "d, e, f", "think"]
    assert tuple(one(spark, terms.triple_parts(s), s="a, b, c, d")) == ("a", "b", "c, d")
    assert one(spark, terms.strict_triples(s), s="<a, b, c, d>") == []
    assert one(spark, terms.used_rules(s), s="x [used_rules: ruleA, rdfs9] [used_rules: rdfs3]") == ["rdfs2", "rdfs9"]


def test_strict_and_flex(spark):
    row = [("<x, p, y>", "<Alice, rdf:type, Person>", "<Alice,rdf:type,Person> <Alice rdf:type Person>"), ("<x, p, y>", "<Alice, rdf:type, Person>", "<AlicerdftypePerson>")]
    df = spark.createDataFrame(row, "premise_knowledge string, expected_output string, model_output string")
    assert [r.f1_triple for r in scoring.strict(df).collect()] == [0, 0]
    got = scoring.flex(df).collect()
    assert [r.f1_triple for r in got] == [terms.PICO, 0] and got[1].unmatched_candidates == ["AlicerdftypePerson"]


def test_metric_text(spark):
    for n, d, want in ((1, 3, "0.333333333333"), (2, 3, "0.666666666667"), (1, 2, "0.5"), (0, 1, "0"), (1, 1, "1"), (1, 0, "0")):
        assert spark.range(1).select(terms.metric_text(terms.ratio(F.lit(n), F.lit(d)))).first()[0] == want


def test_file_names(spark):
    s = F.col("s")
    stem = "response__m__NRP-full__rva__rdfs2__n100__b-c925b787__t-00000000__batch_ab12__20260101000000"
    assert one(spark, task_key(s), s=stem) == "NRP-full__rva__rdfs2__n100__b-c925b787__t-00000000"
    assert one(spark, response_name(s), s=stem).pattern_id == "rdfs2" and one(spark, eval_name(s), s="a__b") is None
    assert one(spark, uids(s), s=stem) == ["b-c925b787", "t-00000000"]


def test_answer_shapes(spark):
    s = F.col("s")
    assert one(spark, terms.answer_text(s), s='{"choices":[{"message":{"content":null}}],"response":"r"}') == "r"
    assert one(spark, terms.answer_text(s), s='{"response":{"x":1}}') == ""
    assert one(spark, terms.request_id(s), s='{"custom_id":"","id":"i"}') == "i"


def test_prompts():
    assert prompts.rule_text("rdfs2_9") == "if <i, rdfs:domain, X> and <X, rdfs:subClassOf, Y> and <a, i, b> then <a, rdf:type, X> and <a, rdf:type, Y>"
    text = prompts.prompt("ARP-def", "rdfs2", "<p>")
    assert "ruleF: if <X, rdfs:subClassOf, Y>" in text and "Premise Knowledge: <p>\n" in text and text.endswith("at the end of your response.")
    assert prompts.prompt("nrp-name", "rdfs2_3", "<p>").startswith("Given the following rules and premise knowledge:\nRules: rdfs2, rdfs3\nPremise")
    with pytest.raises(ValueError):
        prompts.condition_name("xyz")


def test_patterns():
    assert len(PATTERNS) == 19 and PATTERNS["rdfs3_7"].premise[0][1] == "rdfs:range"
    assert [p.id for p in chosen("rdfs9, rdfs9,rdfs2")] == ["rdfs9", "rdfs2"] and len(chosen("*")) == 19
    with pytest.raises(ValueError):
        chosen("rdfs1")


def test_folds_every_character(spark):
    """All assigned characters, alone and between others, against the rule over whole strings."""
    import sys
    import unicodedata

    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    random.seed(2)
    words = chars + [f"a{c}́{d}" for c, d in zip(chars, random.sample(chars, len(chars)))] + ["", "plain", "각각한글"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for r in df.select("s", terms.ascii_fold(F.col("s")).alias("f")).toLocalIterator():
        assert r.f == "".join(c for c in unicodedata.normalize("NFKD", r.s) if not unicodedata.combining(c)), ascii(r.s)
    assert one(spark, terms.ascii_fold(F.col("s")), s=None) is None


def test_first_derangement(spark):
    """Five to seven values of few kinds against all permutations in the order of their indexes."""
    from itertools import permutations

    random.seed(3)
    for n in (5, 6, 7):
        rows = [tuple(random.choice("abcd"[: random.randint(2, 4)]) for _ in range(n)) for _ in range(120)]
        df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(n)))
        for r in df.select(F.array(*df.columns).alias("v"), terms.deranged([F.col(c) for c in df.columns]).alias("d")).collect():
            v = r.v
            turned = next(([*v[k:], *v[:k]] for k in range(1, n) if all(x != y for x, y in zip(v, [*v[k:], *v[:k]]))), None)
            first = next(([v[i] for i in p] for p in permutations(range(n)) if all(v[i] != x for i, x in zip(p, v))), None)
            assert r.d == (turned or first), v
