"""Divergence audit, quality classifier and hard negatives against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleforge.llm import discriminant, divergence, negatives, packing

SF = "/root/testdata/sf0.01"


def audit_by_hand(rows, top):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    bags = [(lang or "", source or "", collections.Counter(terms.findall(lower(text or "")))) for text, lang, source in rows]
    out = set()
    for lang in {b[0] for b in bags}:
        docs = collections.Counter(t for g, _, b in bags if g == lang for t in b)
        kept = [t for t, n in docs.items() if n >= 3]
        counts = {s: sum((b for g, o, b in bags if (g, o) == (lang, s)), collections.Counter()) for s in {o for g, o, _ in bags if g == lang}}
        counts[None] = sum((b for g, _, b in bags if g == lang), collections.Counter())
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (total[s] + len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // p[b][t]
        for s in counts:
            if s is None:
                continue
            found = {"pair": [(sum(f(s, o, t) for t in kept), o) for o in counts if o not in (s, None)], "term": [(f(s, None, t), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]}
            for part, items in found.items():
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def test_divergence_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["The", "the", "über", "Über", "naïve", "x", "don't", "a_b", "日本", "é", "Z9z", "of", "and", "in\x1cout", " nb"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "", "Ä", "s10"])) for _ in range(120)]
    rows += [(None, "en", "only null"), ("", "fr", "a"), ("lone words", "fr", "b"), ("same same", "es", "only"), ("same", "es", "only"), ("same", "es", "only")] + [("the of " * 5000, "en", "s1")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("g", F.lit("x")).withColumn("term", F.lit(1)).withColumn("n", F.lit(None).cast("int")).repartition(3)
    want = audit_by_hand(rows, 4)
    assert {r[2] for r in want} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in want
    got = divergence.audited(docs, top=4, chunk=3, block=2, span=1).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert set(map(tuple, divergence.audited(docs.coalesce(1), top=4, chunk=1000, block=3).collect())) == want
    assert divergence.audited(docs.limit(0)).collect() == []


def test_divergence_quotients_beyond_64_bits(spark):
    """A count of 2^34 times 10^9 does not fit a long: the quotient is the exact one."""
    big = spark.range(1).select(F.lit((1 << 34) + 5).alias("n"), F.lit((1 << 35) + 11).alias("t"))
    assert big.select(divergence._p("n", "t")).first()[0] == 1 + 10**9 * ((1 << 34) + 6) // ((1 << 35) + 11)
    rows = [("en", 0, 0, 0, 0, 0, g, total, 2, [0], [n]) for g, total, n in ((0, (1 << 35) + 11, (1 << 34) + 5), (1, 10, 3))]
    tiles = spark.createDataFrame(rows, "lang string, a long, b long, span long, chunk long, side int, g long, total long, size long, pos array<int>, n array<long>").coalesce(1)
    p = [[1 + 10**9 * (n + 1) // t, 1 + 10**9 // t] for _, _, _, _, _, _, _, t, _, _, (n,) in rows]
    want = {(0, 1): sum((x - y) ** 2 // y for x, y in zip(*p)), (1, 0): sum((x - y) ** 2 // x for x, y in zip(*p))}
    assert {(r.g, r.h): r.value for r in divergence._tiled(tiles).collect()} == want


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_classifier_on_held_out_documents(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(None, "x y z " * 30), (-5, None), (-6, ""), (-7, " \n"), (-8, "ab " * 200_000), (0, docs.where("doc_id = 0").first().text)], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("x", F.lit("clash")).withColumn("held_out", F.lit(1))
    rows = discriminant.scored(docs, labels.withColumn("y", F.lit(9))).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[-5].score == by[-6].score and by[None].held_out is False and len({r.score for r in rows if r.doc_id == 0}) == 1
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    right = {k: [r.predicted == k for r in held if truth[r.doc_id] == k] for k in (0, 1)}
    assert len(right[0]) > 5 and np.mean(right[0]) > 0.85 and np.mean(right[1]) > 0.97
    # labels of held-out documents are not read
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in discriminant.scored(docs.repartition(5), turned).collect()} == {r.doc_id: r.score for r in rows}


def test_discriminant_by_the_formula(spark, labelled):
    """Moments, shrinkage and densities as written out with inverses and determinants; the chosen point has the least loss."""
    docs, labels = labelled
    rows = discriminant.described(docs)
    model = discriminant.fitted(rows, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [(r.doc_id, np.ldexp(np.array(r.x, float), -discriminant.GRID)) for r in rows.collect()]
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(np.abs(x - discriminant.statistics(text[i])).max() <= 2.0**-discriminant.GRID for i, x in got[:50])
    crc = lambda i: zlib.crc32(str(i).encode())
    train = [(i, x, truth[i]) for i, x in got if i in truth and crc(i) % 5]

    def density(members, alpha, gamma):
        n = [sum(y == k for _, _, y in members) for k in (0, 1)]
        X = [np.array([x for _, x, y in members if y == k]) for k in (0, 1)]
        S = [np.cov(x.T, bias=True) for x in X]
        pooled = (n[0] * S[0] + n[1] * S[1]) / sum(n)
        parts = []
        for x, s in zip(X, S):
            c = (1 - gamma) * ((1 - alpha) * s + alpha * pooled) + gamma * np.diag(np.diag(pooled) + 1e-9)
            parts.append((x.mean(0), np.linalg.inv(c), np.linalg.slogdet(c)[1]))
        return lambda x: np.diff([-0.5 * ((x - m) @ inv @ (x - m) + det) for m, inv, det in parts])[0], np.log((n[1] + 1) / (n[0] + 1))

    f, prior = density(train, model.alpha, model.gamma)
    some = [x for _, x in got[::40]]
    np.testing.assert_allclose(model.difference(np.array(some)), [f(x) for x in some], rtol=1e-6)
    assert abs(model.prior - prior) < 1e-9
    tries, rest = [t for t in train if crc(t[0]) % 25 // 5 == 0], [t for t in train if crc(t[0]) % 25 // 5]

    def loss(alpha, gamma, slope):
        f, prior = density(rest, alpha, gamma)
        return sum(np.logaddexp(0, (1 - 2 * y) * (slope * f(x) + prior)) for _, x, y in tries)

    mine = loss(model.alpha, model.gamma, model.slope)
    assert all(mine <= loss(*p) + 1e-3 for p in ((0.02, 0.01, 1.0), (0.9, 0.3, 1.0), (0.1, 0.1, 0.25), (0.6, 0.01, 0.125)))


def test_classifier_without_a_class_and_with_a_bound(spark, labelled):
    docs, labels = labelled
    few = docs.limit(40)
    n = labels.where("quality = 1").where(discriminant.fold(5) != 0).join(few.select("doc_id"), "doc_id").count()
    one = {r.score for r in discriminant.scored(few, labels.where("quality = 1")).collect()}
    assert len(one) == 1 and abs(one.pop() - (n + 1) / (n + 2)) < 1e-12
    assert {r.score for r in discriminant.scored(few, labels.limit(0)).collect()} == {0.5}
    assert discriminant.scored(docs.limit(0), labels).collect() == []
    drawn = discriminant.sample(labels, 60).groupBy("y").count().collect()
    assert {r.y for r in drawn} == {0, 1} and all(10 <= r["count"] <= 60 for r in drawn)
    twice = labels.union(labels).union(labels.where("doc_id % 2 = 0").withColumn("quality", 1 - F.col("quality"))).union(labels.where("quality = 1").withColumn("doc_id", F.lit(None).cast("long")))
    assert discriminant.sample(twice).where("doc_id % 2 = 0").count() == 0 and discriminant.sample(twice).count() == discriminant.sample(labels).where("doc_id % 2 <> 0").count()


def mined_by_hand(rows, every):
    kept: dict = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = (int(np.fmod(label + 1, 10)) if i % 7 == 0 else label, [int(np.floor(np.float64(x) * 256)) for x in v])
        kept[i] = min(kept.get(i, w), w)
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1]))
    out = set()
    for a in (i for i in kept if i % every == 0):
        order = sorted((i for i in kept if i != a), key=lambda i: (-score(a, i), i))
        for p in [i for i in order if kept[i][0] == kept[a][0]][:5]:
            s = score(a, p)
            there = [i for i in order if kept[i][0] != kept[a][0] and 30 * s <= 100 * score(a, i) <= 90 * s][:10]
            out |= {(a, p, r, i, s, score(a, i)) for r, i in enumerate(there, 1)}
    return out


KIND = "vec_id long, embedding array<float>, label int"


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-2, 3, 3) / rng.choice([1, 3]))], int(rng.integers(0, 4))) for i in range(300)]  # few values: many ties
    rows += [(300 + i, [1.0, 0.5], 9) for i in range(40)]  # shorter vectors, equal ones, label 9 moves to 0
    rows += [(10, [1.0, None, 0.0], 1), (500, None, 1), (510, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (520, [float("nan"), 0.0, 0.0], 2), (530, [float("inf"), 0.0, 0.0], 2), (540, [], 2), (20, [2.0, 2.0, 2.0], 0), (20, [2.0, 2.0, 2.0], 0)]
    df = spark.createDataFrame(rows, KIND).withColumn("slot", F.lit("x")).withColumn("score", F.lit(1)).repartition(4)
    want = mined_by_hand(rows, 10)
    assert len(want) > 500
    assert set(map(tuple, negatives.mined(df, 10).collect())) == want
    assert set(map(tuple, negatives.mined(df, 10, block=7).collect())) == want
    assert negatives.mined(df.limit(0), 10).collect() == [] and negatives.mined(df.where("vec_id = 3"), 10).collect() == []


def test_negatives_beyond_double_precision(spark):
    """Scores past 2^53 are exact, past 2^63 the nearest long."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 3e6], int(i % 3)) for i in range(80)]
    want = mined_by_hand(rows, 10)
    assert max(w[4] for w in want) > 1 << 53
    assert set(map(tuple, negatives.mined(spark.createDataFrame(rows, KIND), 10).collect())) == want
    huge = [(0, [1e30], 1), (1, [1e30], 1), (2, [1.0], 2), (3, [-1e30], 1)]
    assert negatives.mined(spark.createDataFrame(huge, KIND), 10).collect() == []
    assert negatives.products(np.array([[2.0**140], [3.0]]), np.array([[2.0**140], [-(2.0**140)], [5.0]])).tolist() == [[(1 << 63) - 1, -(1 << 63), (1 << 63) - 1], [(1 << 63) - 1, -(1 << 63), 15]]


def test_ids_equal_the_tokenizer_around_every_control_and_space():
    e = packing.Encoder(packing.tokenizer_path())
    odd = [chr(c) for c in (*range(0x21), *range(0x7F, 0xA1), 0xAD, 0x180E, 0x1680, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF)]
    rng = random.Random(1)
    texts = [f"a{c}b" for c in odd] + [c for c in odd] + [f"Don't{c}{d}it's x" for c in "\x1c\x1d\x1e\x1f" for d in odd]
    texts += ["".join(rng.choices([*odd, "a", "é", "the", "7", "!", "'s", "\u0301"], k=30)) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_placement_by_a_plain_search_of_all_levels():
    """Each piece goes where the sum of squared counts of partly filled windows is least, the fullest window at equal cost, a new one last."""
    rng = random.Random(2)
    for window in (8, 50):
        p, count = packing.Packer(window), collections.Counter()
        for n in range(3000):
            size = rng.randint(1, window)
            if size == window:
                p.place((n, 0, size), size)
                continue
            costs = {}
            for fill in [0, *(f for f, k in count.items() if k and f + size <= window)]:
                after = count.copy()
                after[fill] -= fill > 0
                after[fill + size] += fill + size < window
                costs[fill] = sum(k * k for k in after.values())
            fill = max(f for f in costs if costs[f] == min(costs.values()))
            count[fill] -= fill > 0
            count[fill + size] += fill + size < window
            p.place((n, 0, size), size)
            assert {f: k for f, k in count.items() if k} == {f: int(k) for f, k in enumerate(p.level) if k}
            assert all(len(p.open[f]) == count[f] for f in range(1, window))


def test_rows_without_an_id_are_spread_over_parts(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    per = collections.Counter(r.sequence_id >> 32 for r in packing.packed(df, parts=4).collect())
    assert sorted(per) == [0, 1, 2, 3] and max(per.values()) < 1.3 * min(per.values())
