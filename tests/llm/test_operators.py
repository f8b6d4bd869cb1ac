"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tripleforge.llm import components, fingerprints, langid, licenses, linededup, lm, mixing, packing, quality, simhash, url_filters

A = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near an old stone bridge that crosses a cold river in spring and nobody hears"
ROWS = [
    (1, A, "en", "s1", 10), (2, A, "en", "s1", 10), (3, A + " today", "en", None, 5), (4, None, "de", "s2", None), (5, "", None, "s2", 0), (6, " \n\t", "de", "s3", 3),
    (7, "line of text number one here\nanother longer line of text is here\n" * 3, "en", "s1", 9), (8, "line of text number onE here\nx\nanother longer line of text is herex!", "en", "s1", 9),
    (None, "word " * 400, "en", "s4", 4), (9, "ÀÉ ﬁ 𝒳 ünïcode straße " * 20, "de", "s4", 4), (10, "z" * 30_000, "fr", "s4", 4), (10, "z" * 30_000, "fr", "s4", 4), (11, "%%% ### *** 123", "fr", "s4", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_words long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_rules_and_reputation(spark):
    urls = [(1, "HTTP://A.Example.COM/en/7x"), (2, "http://b.net/de/1?q"), (3, "https://x.example.net/de/8"), (4, "no scheme"), (5, None), (6, "http://h?x"), (7, "http://bad.org/1"), (8, "http://bad.org/2"), (8, "http://bad.org/2")]
    urls += [(100 + i, f"http://bad.org/{i}") for i in range(40)] + [(200 + i, f"http://b.net/{i}") for i in range(40)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    marks = spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(200 + i, 0) for i in range(40)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filters.judge(pages, marks).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict, got[3].rule, got[3].verdict) == ("net/de/", "allow", "example.net/de/8", "block")
    assert (got[4].host, got[5].path, got[6].host, got[6].path, got[4].verdict) == ("", "", "h", "", "allow")
    assert got[8].verdict == "block" and got[8].rule is None and got[7].bad_rate > 0.8
    assert url_filters.judge(pages.limit(0), marks).count() == 0
    assert url_filters.judge(pages, marks.limit(0)).where("rule IS NULL AND verdict <> 'allow'").count() == 0


def test_reputation_over_the_whole_chain(spark):
    """Labels to verdicts: a page counts once, bad hosts go, hosts with few pages follow their domain, against the formula by hand."""
    rows, labels, n = [], [], 0
    for host, good, bad in (("spam.bad.co.uk", 2, 60), ("new.bad.co.uk", 0, 0), ("one.bad.co.uk", 1, 2), ("fine.org", 80, 4), ("b.fine.org", 0, 1), ("other.co.uk", 40, 3), ("bücher.de", 30, 1)):
        for k in range(max(good + bad, 1)):
            n += 1
            rows += [(n, f"https://{host}/x/{n}?q")] * (1 + 4 * (host == "b.fine.org"))  # repeated pages
            labels += [(n, int(k >= good) ^ 1 if good + bad else None, None)] * 2
    rows += [(None, "https://fine.org/x/1"), (n + 1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("mean", F.lit(0))
    marks = spark.createDataFrame(labels + [(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    outcomes = url_filters.outcomes_of(url_filters.parsed(pages), marks)
    assert outcomes.where('page_id IS NOT NULL').count() == n - 1  # the page without a label has none
    got = {r.host: r for r in url_filters.judge(pages, outcomes).collect()}
    assert got["spam.bad.co.uk"].verdict == "block" and got["fine.org"].verdict == got["other.co.uk"].verdict == got["b.fine.org"].verdict == "allow"
    assert got["new.bad.co.uk"].bad_rate > 0.5 > got["other.co.uk"].bad_rate  # its domain's reputation, not the suffix's
    counts = {r.host: (r.n, r.x) for r in url_filters.reputation(url_filters.parsed(pages), outcomes).collect()}
    assert counts["b.fine.org"] == (1, 1) and counts["spam.bad.co.uk"] == (62, 60) and counts["new.bad.co.uk"] == (0, 0)

    def weight(groups):
        N, X, k = sum(a for a, _ in groups), sum(b for _, b in groups), sum(a > 0 for a, _ in groups)
        pq = X / N * (1 - X / N)
        room = pq * (N - sum(a * a for a, _ in groups) / N - (k - 1))
        rho = min(max((sum(b * b / a for a, b in groups if a) - X * X / N - pq * (k - 1)) / room, 1e-9), 1.0) if room > 0 else 1e-9
        return min(max((1 - rho) / rho, 2.0), 200.0)

    level = lambda of: {g: tuple(map(sum, zip(*[v for h, v in counts.items() if of(h) == g]))) for g in {of(h) for h in counts}}
    domain = lambda h: ".".join(h.split(".")[-3:]) if h.endswith(".co.uk") else ".".join(h.split(".")[-2:])
    suffix = lambda h: "co.uk" if h.endswith(".co.uk") else h.split(".")[-1]
    doms, sufs = level(domain), level(suffix)
    N, X = (sum(v[i] for v in sufs.values()) for i in (0, 1))
    ks, kd, kh = weight(list(sufs.values())), weight(list(doms.values())), weight(list(counts.values()))
    for h, (a, b) in counts.items():
        m = (X + 1) / (N + 2)
        for (x, y), k in ((sufs[suffix(h)], ks), (doms[domain(h)], kd), ((a, b), kh)):
            m = (m * k + y) / (k + x)
        if h in got:
            assert abs(got[h].bad_rate - m) < 1e-6


def test_quality(docs, empty):
    got = {(r.doc_id, r.n_bytes): r for r in quality.measured(docs).collect()}
    for d, text, *_ in ROWS:
        words = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        r = got[d, len((text or "").encode())]
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        inside = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(inside))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
    assert got[1, len(A)].base_failed and not got[4, 0].kept
    assert quality.measured(empty).count() == 0 and quality.keep(docs).columns == docs.columns
    noise = "".join(chr(33 + x % 90) for x in np.random.default_rng(1).integers(0, 1 << 30, 9000))
    import zstandard

    assert not quality.measure(" ".join(noise[i : i + 7] for i in range(0, 9000, 7)), zstandard.ZstdCompressor(level=3))[6]


def test_quality_bands_reject_what_the_counts_keep():
    import zstandard

    rng = np.random.default_rng(7)
    pick = lambda letters, n: "".join(letters[int(x)] for x in rng.integers(0, len(letters), n))
    split = lambda t: " ".join(t[i : i + 7] for i in range(0, len(t), 7))
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    judged = lambda t: quality.measure(t, zstandard.ZstdCompressor(level=3))
    clean = [t for t in docs["text"] if t and not judged(t)[5]]
    prose = "\n".join(clean).encode("ascii", "replace").decode()[:9000]
    junk = {
        "hex words": split(pick("0123456789abcdef", 5700)), "letters": split(pick("abcdefghijklmnopqrstuvwxyz", 5200)),
        "half base64": prose[:3000] + " " + split(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2600)),
        "template": "\n".join(f"Item {i * 37 % 1000} was sold {i} times" for i in range(200)),
    }
    for name, text in junk.items():
        got = judged(text)
        assert not got[5] and not got[6], (name, got)
    assert sum(judged(t)[6] for t in clean) >= 0.95 * len(clean)
    # chunks count from one on, and the last one ends with the text
    assert [judged(prose[:n].ljust(n, "x"))[9] for n in (4095, 4096, 4097, 8192, 8193)] == [0, 1, 2, 2, 3]


def test_order_minhash(spark, docs, empty):
    got = fingerprints.fingerprinted(docs).collect()
    assert len(got) == len(ROWS)
    ids = sorted({r[0] for r in ROWS if r[0]})
    texts = {r[0]: r[1] or "" for r in ROWS}
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        if r.doc_id is not None:
            a, n = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
            q = len(a) // 4
            assert r.edited_sha256 == hashlib.sha256((a[: len(a) - q] + n[:q]).encode()).hexdigest() and r.n_chars == len(a)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1 and by[5][0].fingerprint == ""
    assert fingerprints.fingerprinted(empty).count() == 0
    # order and multiplicity count: the same words in another order share little
    words = [f"w{i}" for i in range(300)]
    two = spark.createDataFrame([(" ".join(words), " ".join(words[150:] + words[:150]), " ".join(words[::-1]))], "a string, b string, c string")
    sig = {c: fingerprints.signature(c) for c in "abc"}
    near, far = two.selectExpr(f"{fingerprints.likeness(sig['a'], sig['b'])} AS x", f"{fingerprints.likeness(sig['a'], sig['c'])} AS y").first()
    assert far < 0.05 < near < 0.9


def slow_signature(text):
    """The signature by hand: numbered k-mers, bins, two minimal ones, their order in the text."""
    import struct

    import regex

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    low, top = (1 << 28) - 1, 64 - fingerprints.BINS_LOG2

    def chained(*parts):
        h = 42
        for x in parts:
            h = xxhash.xxh64_intdigest(x, h)
        return signed(h)

    number = lambda x: struct.pack("<q", x)
    edge = fingerprints.BOUNDARY.replace(r"\\x{250}-\\x{10FFFF}", "ɐ-\U0010ffff").replace(r"\\-", r"\-")
    pieces = [x.encode() for x in regex.findall(rf"\S{{1,12}}+(?!\S)\s?|[^\s{edge}]{{0,11}}+\S\s?|\s{{1,12}}", text, flags=regex.ASCII)]
    grams = [pieces[i : i + 3] for i in range(len(pieces) - 2)] if len(pieces) >= 3 else [pieces] if pieces else []
    seen: collections.Counter = collections.Counter()
    values = []
    for i, g in enumerate(grams):
        h = chained(*g) & ~low
        n = seen[h]
        seen[h] += 1
        values.append(((chained(number(h >> 28), struct.pack("<i", n)) & ~low) if n else h) | i)
    bins = collections.defaultdict(list)
    for v in sorted(values):
        if len(bins[v >> top]) < 2:
            bins[v >> top].append(v)
    m = [v for b in sorted(bins) for v in bins[b]]
    out = []
    for j, v in enumerate(m):
        if v == bins[v >> top][0]:
            w = m[(j + 1) % len(m)]
            a, b = (v, w) if v & low < w & low else (w, v)
            h = chained(number(v >> 28)) if len(m) == 1 else chained(number(a >> 28), number(b >> 28))
            out.append((((v >> top) + (1 << (fingerprints.BINS_LOG2 - 1))) << 16) | (h & 65535))
    return "".join(f"{x:06X}" for x in out)


def test_order_minhash_against_the_signature_by_hand(spark):
    texts = ["", "one", "one two", A, A + " " + A, "x y " * 50, "漢字かな交じり文" * 9, "a" * 100 + "0" + "b" * 40, "tabs\t\tand\n\nlines   of  blanks", "0123456789abc" * 30]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr("i", f"{fingerprints.shown(fingerprints.signature('t'))} AS f").collect()
    assert {r.i: r.f for r in got} == {i: slow_signature(t) for i, t in enumerate(texts)}


def test_order_minhash_follows_edit_distance_without_blanks(spark):
    rng = np.random.default_rng(8)
    cjk = "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, 3000))
    code = "".join("abcdefghijklmnopqrstuvwxyzABCDEF0123456789"[int(x)] for x in rng.integers(0, 42, 6000))
    like = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").selectExpr(f"{fingerprints.likeness(fingerprints.signature('a'), fingerprints.signature('b'))} AS x").first().x
    for text in (cjk, code):
        one = like(text, "X" + text)
        cut = lambda k, t=text: "".join(c if int(x) else "" for c, x in zip(t, np.random.default_rng(9).integers(0, k, len(t))))
        some, many = like(text, cut(100)), like(text, cut(10))
        assert one > 0.9 and one >= some > many and some > 0.6 and like(text, text[::-1]) < 0.05
    words = [f"w{i}" for i in range(30)]  # short texts: order counts there too
    blocks = [words[i : i + 5] for i in range(0, 30, 5)]
    assert like(" ".join(words), " ".join(w for b in blocks[::-1] for w in b)) < 0.25


def test_next_document(spark):
    rows = [(5, "five a"), (5, "five b"), (7, "seven"), (2, "two"), (None, "none"), (9, "nine")]
    got = fingerprints.next_ids(spark.createDataFrame(rows, "doc_id long, t string").selectExpr("doc_id", "length(t) AS n"), rows=1)
    assert {(r.doc_id, r.next_id, r.q) for r in got.collect()} == {(2, 5, 0), (5, 7, 1), (7, 9, 1), (9, 2, 1)}
    least = min((t for d, t in rows if d == 5), key=lambda t: np.int64(np.uint64(xxhash.xxh64_intdigest(t, 42))))
    out = {(r.doc_id, r.edited_sha256) for r in fingerprints.fingerprinted(spark.createDataFrame([(2, "twelve words"), *rows[:2]], "doc_id long, text string")).collect()}
    assert (2, hashlib.sha256(("twelve wo" + least[:3]).encode()).hexdigest()) in out


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(3)
    many = spark.createDataFrame([(i, "w " * int(rng.integers(1, 40)), f"s{int(rng.integers(0, 9)) // 2}") for i in range(3000)], "doc_id long, text string, source string")
    for table in (docs, many):
        got = mixing.mixed(table).collect()
        sizes: dict = {}
        for r in got:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
        names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
        w, left, goal, free = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}, set(names)
        while True:  # reshare until none is above
            level = left / sum(w[s] for s in free) if free else 0
            over = [s for s in free if level * w[s] > 2 * sizes[s]]
            if not over:
                goal |= {s: level * w[s] for s in free}
                break
            for s in over:
                goal[s] = 2.0 * sizes[s]
                left -= goal[s]
                free.discard(s)
        for r in got:
            assert abs(r.target - goal[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        if table is many:
            taken: dict = {}
            for r in got:
                taken[r.source] = taken.get(r.source, 0) + r.taken
            assert all(abs(taken[s] - goal[s]) <= 40 for s in names)
    assert mixing.mixed(empty).count() == 0
    assert mixing.mix(many).count() == sum(r.times for r in mixing.mixed(many).collect())


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    got = simhash.grouped(docs).collect()
    fp = {r[0]: slow_fingerprint(r[1]) for r in ROWS}
    assert all(r.fp % (1 << 64) == fp[r.doc_id] for r in got) and len(got) == len(ROWS)
    own = {r.doc_id: r.component_id for r in got}
    assert own[2] == 1 and own[5] == own[6] == own[4] == 4
    assert simhash.grouped(empty).count() == 0
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 4} and 2 not in {r.doc_id for r in kept.collect()}
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 2, dtype=np.uint64)) for b in base for _ in range(2)], axis=None))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    pairs = {(int(i), int(j)) for a, b in simhash.GrayIndex(codes).search(most=500) for i, j in zip(a, b)}
    assert pairs == {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 3}
    some = np.arange(0, len(codes), 7)  # several runs at once: no pair over a border
    runs = np.append(some, len(codes))
    got = {(int(i), int(j)) for a, b in simhash.GrayIndex(codes, runs).search() for i, j in zip(a, b)}
    assert got == {(i, j) for i, j in pairs if i // 7 == j // 7}
    label = simhash.linked(codes, np.array([0, len(codes)]))
    assert all(label[i] == label[j] for i, j in pairs)
    hot = np.unique(np.concatenate([codes, (codes & ~np.uint64(0xFFFF)) | np.uint64(77)]))  # one value of a block in half of all codes
    near = [(i, j) for i in range(len(hot)) for j in range(i + 1, len(hot)) if int(hot[i] ^ hot[j]).bit_count() <= 3]
    forest = list(range(len(hot)))

    def find(i):
        while forest[i] != i:
            i = forest[i]
        return i

    for i, j in near:
        forest[find(j)] = find(i)
    for split in (simhash.SPLIT, 20):
        edges = simhash.links(spark.createDataFrame([(int(c.astype(np.int64)),) for c in hot], "fp long").repartition(3), split)
        roots = {r.node: r.root for r in components.components(edges).collect()}
        root = [roots.get(int(c.astype(np.int64)), int(c.astype(np.int64))) for c in hot]
        assert len({(find(i), root[i]) for i in range(len(hot))}) == len({find(i) for i in range(len(hot))}) == len(set(root))


def test_simhash_dedup_keeps_a_row_of_each_group(spark):
    B = "entirely other words stand in this one and no copy of it is found elsewhere in the table at all"
    rows = [(1, A, "x"), (10, A, "x"), (10, B, "y"), (None, A, "n"), (None, "a third text that has no number but also no copy of itself anywhere", "n"), (None, "a third text that has no number but also no copy of itself anywhere", "n"), (20, B, "z"), (1, A, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("row", F.lit(1))
    got = simhash.dedup(table)
    assert got.columns == table.columns
    assert sorted((r.doc_id or 0, r.text[:5]) for r in got.collect()) == [(0, "a thi"), (1, A[:5]), (10, B[:5])]
    assert simhash.dedup(table.limit(0)).count() == 0


def test_licenses(spark, empty):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/y.py", "text\nLicensed under the Apache License, Version 2.0.\nmore words"), ("z/x.py", None), (None, "code"), ("top.txt", ""), ("a/b/x.py", "code")]
    got = {r.path: r for r in licenses.inherited(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/b/x.py"].license == "MIT" and got["a/b/x.py"].license_dir == "a" and got["a/b/y.py"].license == "Apache-2.0" and got["a/b/y.py"].license_dir is None
    assert got["z/x.py"].license is None and got[None].license is None
    assert licenses.inherited(empty.selectExpr("source AS path", "text")).count() == 0
    ties = [("p/LICENSE", "Released under the MIT License."), ("p/COPYING", "Licensed under the Apache License, Version 2.0"), ("p/q/r/s.py", "x"), ("LICENSE.txt", "Licensed under the ISC License"), ("u/v.py", "x")]
    table = spark.createDataFrame(ties, "path string, text string").withColumn("key", F.lit(1)).withColumn("dir", F.lit("z"))
    got = {r.path: (r.license, r.license_dir) for r in licenses.inherited(table).collect()}
    assert got["p/q/r/s.py"] == ("MIT", "p") and got["u/v.py"] == ("ISC", "")  # of equal cosines the last name; the root's licence where nothing is nearer
    mit = licenses.TEMPLATES["MIT"][0]
    assert licenses.Matcher().own("Copyright (c) 2020 A. Nyone\n\n" + "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70)))[::2] == ("MIT", True)


def test_license_headers_in_use():
    gpl = "{0} This program is free software: you can redistribute it and/or modify\n{0} it under the terms of the GNU {2}General Public License as published by\n{0} the Free Software Foundation, either version {1} of the License, or\n{0} (at your option) any later version.\n\ncode = 1"
    want = {
        "# SPDX-License-Identifier: Apache-2.0\ncode": "Apache-2.0", "/* SPDX-License-Identifier: MIT */": "MIT", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "# spdx-license-identifier: (Zlib OR MIT)": "Zlib",
        "intro\nThis project is licensed under the MIT License - see the LICENSE file for details\nmore": "MIT",
        "#!/bin/sh\n" + gpl.format("#", 3, ""): "GPL-3.0", gpl.format(" *", 2, ""): "GPL-2.0", gpl.format("//", 3, "Affero "): "AGPL-3.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n" + "words of it\n" * 5000: "AGPL-3.0",
        "a plain text that mentions its license and nothing else of use": None,
    }
    m = licenses.Matcher()
    assert {t[:60]: m.own(t)[0] for t in want} == {t[:60]: w for t, w in want.items()}
    assert m.own("Released under the MIT License.\n" + " \n" * 30_000)[2]  # a licence file of any length


def test_licence_cosines_by_brute_force(spark):
    """Scores of all documents against dense vectors over the whole vocabulary, and licences against a walk up the path."""
    import math
    import re

    term, m = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*"), licenses.Matcher()
    base = [(n, t) for n, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
    tags = [(n, f"SPDX-License-Identifier: {n}{e}") for n in sorted(licenses.TEMPLATES) for e in ("", "-only", "-or-later")]
    bags = [term.findall(t.lower()) for _, t in base]
    weight = lambda t: math.log((1 + len(base)) / (1 + sum(t in b for b in bags))) + 1

    def dense(text, vocabulary):
        words = term.findall(text.lower())
        return np.array([words.count(t) * weight(t) for t in vocabulary])

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "text").where("text IS NOT NULL").collect()
    spoken = [r.text for r in rows if re.search("(?i)licen[sc]e|spdx|permission is hereby", r.text)]
    texts = spoken[:40] + [t for _, t in base] + ["// SPDX-License-Identifier: GPL-3.0-or-later", "see the licence", "SPDX-License-Identifier: MIT\nLicensed under the Apache License"]
    for text in texts:
        for part in [text, *text.split("\n")[:6]]:
            words = sorted(set(term.findall(part.lower())))
            score, name = m.best(part)
            if not words:
                assert score == 0
                continue
            cosines = []
            for n, t in base + tags:
                vocabulary = sorted(set(words) | set(term.findall(t.lower())))
                x, y = dense(part, vocabulary), dense(t, vocabulary)
                cosines.append((x @ y / np.linalg.norm(x) / np.linalg.norm(y), n))
            top = max(c for c, _ in cosines)
            assert abs(score - top) < 1e-9 and name in {n for c, n in cosines if c > top - 1e-9}

    rng = np.random.default_rng(5)
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "Licensed under the ISC License", "code", "", None]
    files = []
    for _ in range(300):
        depth = int(rng.integers(0, 5))
        folder = "/".join("abc"[int(rng.integers(0, 3))] for _ in range(depth))
        name = ["LICENSE", "COPYING.txt", "x.py", "y.py", "z/"][int(rng.integers(0, 4))]
        files.append((f"{folder}/{name}" if folder else name, notices[int(rng.integers(0, 6))]))
    files += files[:40]
    own = {(p, t): m.own(t) for p, t in files}
    licensed = {}
    for (p, _), (name, score, whole) in own.items():
        if name and (whole or re.search(licenses.FILE_NAME, p)):
            folder = p.rpartition("/")[0]
            licensed[folder] = max(licensed.get(folder, (0.0, "")), (score, name))
    want = []
    for p, t in files:
        name, folder, come = own[p, t][0], p, None
        while not name and folder:
            folder = folder.rpartition("/")[0]
            if folder in licensed:
                name, come = licensed[folder][1], folder
        want.append((p, name, come))
    got = [(r.path, r.license, r.license_dir) for r in licenses.inherited(spark.createDataFrame(files, "path string, text string")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len({w[2] for w in want}) > 5


def test_line_links(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        lines = []
        for _ in range(5):
            t = list("abcdefghij klmnop qrstu"[: int(rng.integers(14, 22))] + str(int(rng.integers(0, 6))) * 3)
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(0, len(t)))] = "éxyz"[int(rng.integers(0, 4))]
            lines.append("".join(t))
        rows.append((i, "\n".join(lines)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    one = table.selectExpr("explode(split(text, '\n')) AS l").where("length(l) >= 16").distinct()
    want = one.crossJoin(one.withColumnRenamed("l", "m")).where("l < m AND levenshtein(l, m) <= 2").collect()
    assert linededup.line_links(table)[2].count() == len(want) > 20
    near = collections.defaultdict(set)
    for a, b in want:
        near[a].add(b)
        near[b].add(a)
    first: dict = {}
    for d, text in rows:
        for p, line in enumerate(text.split("\n")):
            first.setdefault(line, (d, p))
    for r in linededup.decisions(table).collect():
        lines = rows[r.doc_id][1].split("\n")
        drop = [p for p, x in enumerate(lines) if len(x) >= 16 and (first[x] != (r.doc_id, p) or any(first[y] < first[x] for y in near[x]))]
        assert r.dropped == drop and r.n_lines == 5 and r.n_links == sum(len(near[x]) for x in lines if len(x) >= 16)
    got = {r.doc_id: r.text for r in linededup.dedup(docs).collect()}
    assert got[7] == "line of text number one here\nanother longer line of text is here\n" and got[8] == "x" and got[4] is None and got[2] == ""
    assert linededup.decisions(empty).count() == 0


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    shared = "a line that both documents hold"
    rows = [(1, "a clean opening that nobody repeats\n" + shared), (1, "quite another text stands up here\n" + shared), (None, "first unnamed document, all its own\n" + shared), (None, "words 12345 found in no other place\n" + shared), (None, "words 12345 found in no other place\n" + shared)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text.split("\n") for r in linededup.dedup(table).collect()]
    assert sorted(lines[0] for lines in got) == sorted(t.split("\n")[0] for _, t in rows)  # clean lines stay, equal rows alike
    assert sum(shared in lines for lines in got) == 1
    assert sorted(tuple(r.dropped) for r in linededup.decisions(table).collect()) == [(), (1,), (1,), (1,), (1,)]


def test_line_dedup_of_short_lines(spark):
    table = spark.createDataFrame([(1, "Home\nx\n\n版权所有\nabcde\n \u3000"), (2, "Home\n\n版权所有\nabXde\nx\nabc\n \u3000"), (3, "abd\nHomes\nabcdefg")], "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in linededup.decisions(table).collect()} == {1: [], 2: [0, 2, 3, 4], 3: [2]}
    words = sorted({"".join("ab"[int(x)] for x in np.random.default_rng(i).integers(0, 2, 5 + i % 4)) for i in range(60)})
    one = spark.createDataFrame([(w,) for w in words], "l string")
    want = one.crossJoin(one.withColumnRenamed("l", "m")).where("l < m AND levenshtein(l, m) <= 2").count()
    assert linededup.line_links(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"))[2].count() == want


def test_line_distance(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(500):
        a = "".join("abé"[int(x)] for x in rng.integers(0, 3, int(rng.integers(1, 25))))
        b = list(a)
        for _ in range(int(rng.integers(0, 4))):
            b.insert(int(rng.integers(0, len(b) + 1)), "abc"[int(rng.integers(0, 3))]) if rng.random() < 0.5 else b and b.pop(int(rng.integers(0, len(b))))
        a, b = sorted((a, "".join(b)), key=len)
        if a and len(b) - len(a) <= 2:
            rows.append((a, b))
    d = linededup.distance("a", "b")
    assert spark.createDataFrame(rows, "a string, b string").where(f"({d} <= 2) <> (levenshtein(a, b) <= 2) OR (levenshtein(a, b) <= 2 AND {d} <> levenshtein(a, b))").count() == 0


def test_lm(spark, docs, empty):
    got = lm.scored(docs, share=20).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    bag = lambda t: collections.Counter([*(t or "").encode().lower().split(), lm.END])
    counts: collections.Counter = collections.Counter()
    for r in ROWS:
        if not held(r[0]):
            counts.update(bag(r[1]))
    N, V = sum(counts.values()), len(counts)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), sum(bag(t).values())) for d, t, *_ in ROWS)
    for r in got:
        own = bag(next(t for d, t, *_ in ROWS if d == r.doc_id))
        want = sum(n * np.log10((counts[w] + 0.1) / (N + 0.1 * (V + 1))) for w, n in own.items())
        assert r.train_tokens == N and abs(r.base_score - want) < 1e-6 and r.held_out == held(r.doc_id)
        assert r.n_known == sum(n for w, n in own.items() if counts[w])
        assert abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity
    # neither what is broadcast nor how rows are dealt changes a score; extra columns with clashing names are ignored
    rounded = lambda rows: sorted((str(r.doc_id), round(r.score, 4)) for r in rows)
    other = docs.withColumn("word", docs.lang).withColumn("row", docs.n_words).repartition(7)
    assert rounded(lm.scored(other, head=3, share=20).collect()) == rounded(got)
    assert lm.scored(empty).count() == 0


def test_lm_slices_change_nothing(spark, docs, monkeypatch):
    """Sums are the same wherever the slices of a chunk's tokens end."""

    def got():
        rows = [tuple(r) for r in lm.scored(docs.limit(60), head=40, share=20).collect()]
        return sorted(((x is None, x, *r[:4], *(round(v, 8) for v in r[4:7])) for x, *r in rows), key=repr)

    whole = got()
    monkeypatch.setattr(lm, "SLICE", 7)
    assert got() == whole


def test_lm_probabilities_against_the_restaurants(spark):
    """Scores of a small corpus against the formula written out with the sampled seatings; all words' probabilities and the rest add up to one."""
    rng = np.random.default_rng(1)
    words = [b"a", b"bb", b"cat", b"dog", b"eel"]
    rows = [(i, " ".join(words[int(x)].decode() for x in rng.choice(5, 12, p=[0.5, 0.2, 0.15, 0.1, 0.05]))) for i in range(60)] + [(1000, "cat zzqx dog")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.trained(lm.stored(lm.chunked(table)), share=14)
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 10 == 0}
    pairs: collections.Counter = collections.Counter()
    for d, t in rows:
        seq = [lm.END, *t.encode().split(), lm.END]
        for u, w in zip(seq, seq[1:]):
            if d not in held:
                pairs[u, w] += 1
    total = collections.Counter()
    for (u, _), n in pairs.items():
        total[u] += n
    assert set(model.known) == {u for u in total if total[u] * 14 >= model.N} and lm.END in model.known and b"eel" not in model.known
    Row = collections.namedtuple("Row", "c u a p")
    own = {bytes(r.word): Row(r.c, np.frombuffer(bytes(r.pairs), lm._PAIR)["u"].tolist(), np.frombuffer(bytes(r.a), "<f4").tolist(), np.frombuffer(bytes(r.p), "<f8").tolist()) for r in model.words.collect()}
    names = {i: u for u, i in model.known.items()}
    for w, r in own.items():
        assert r.c == sum(n for (_, x), n in pairs.items() if x == w)
        assert set(r.u) - {lm.ROOT} == {model.known[u] for u, x in pairs if x == w and u in model.known}

    def prob(u, w):
        i = model.known.get(u, lm.ROOT)
        a = dict(zip(own[w].u, own[w].a)).get(i, 0.0)
        return a + np.mean([b * p for b, p in zip(model.opens[:, i if i != lm.ROOT else -1], own[w].p)])

    for u in [*model.known, b"eel"]:
        assert 0.9 < sum(prob(u, w) for w in own) < 1  # the rest is for words of other spellings
    for i, u in names.items():  # a seat of a dish of n customers gives between n - n * d and n - d of the restaurant's
        for (x, w), n in pairs.items():
            if x == u:
                a = dict(zip(own[w].u, own[w].a))[i]
                assert 0 <= a * (min(model.strengths) + total[u]) <= n - 0.05 + 1e-3
    for r in lm.scored(table, share=14, head=2).collect():
        seq = [lm.END, *dict(rows)[r.doc_id].encode().split(), lm.END]
        assert abs(r.score - sum(np.log10(prob(u, w)) for u, w in zip(seq, seq[1:]))) < 1e-4
        assert abs(r.known_score - sum(np.log10(prob(u, w)) for u, w in zip(seq, seq[1:]) if own[w].c)) < 1e-4


def test_lm_rarer_words_have_restaurants(spark):
    """Words under 1 / SHARE of the tokens have restaurants of their own: what followed them is told from what did not."""
    rng = np.random.default_rng(6)
    held = [d for d in range(10**6, 10**6 + 200) if zlib.crc32(str(d).encode()) % 10 == 0][:4]
    train = [d for d in range(200) if zlib.crc32(str(d).encode()) % 10][:100]
    rows = [(d, " ".join([*("w%d" % x for x in rng.integers(0, 20, 600)), *(["eel fox"] if i % 10 == 0 else ["ant gnu"] if i % 10 == 1 else [])])) for i, d in enumerate(train)]
    asked = ["eel fox", "eel gnu", "ant gnu", "ant fox"]
    got = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows + list(zip(held, asked)), "doc_id long, text string")).where(f"doc_id >= {10**6}").collect()}
    assert {r.train_tokens for r in got.values()} == {60140} and 10 * lm.SHARE < 60140
    eel_fox, eel_gnu, ant_gnu, ant_fox = (got[d].score for d in held)
    assert eel_fox > eel_gnu + 1 and ant_gnu > ant_fox + 1
    assert len({round(got[d].base_score, 6) for d in held}) == 1


def test_lm_rarer_words_as_frequent_ones(spark, docs, monkeypatch):
    """Restaurants in their own groups give about what those in their dishes' rows give, however rows and groups are dealt."""
    scores = lambda rows: sorted((str(r.doc_id), round(r.score, 4)) for r in rows)
    far = lm.scored(docs, frequent=20).collect()
    monkeypatch.setattr(lm, "LEAST", 3)
    assert scores(lm.scored(docs.repartition(7), frequent=20).collect()) == scores(far)
    near = lm.scored(docs, frequent=10**6).collect()
    mean = lambda rows, held: sum(r.score for r in rows if r.held_out == held) / sum(r.n_tokens for r in rows if r.held_out == held)
    for held in (False, True):
        assert abs(mean(far, held) - mean(near, held)) < 0.1
    cut = lm.scored(docs, share=20).collect()
    assert mean(cut, False) < mean(far, False) - 0.1


def test_lm_likeliest():
    """The grid's strength against the one found by golden section."""
    rng = np.random.default_rng(7)
    d, theta = 0.4, 30.0
    c, t = rng.integers(1, 300, 200), np.zeros(200, np.int64)
    for j in range(200):
        for i in range(int(c[j])):
            t[j] += rng.random() < (theta + d * t[j]) / (theta + i)
    values = lm.likelihoods(c[:120], t[:120], d) + lm.likelihoods(c[120:], t[120:], d)
    assert abs(np.log(lm.likeliest(values) / lm.strength(c, t, d))) < 0.02
    assert lm.likeliest(np.zeros(len(values))) == lm.STRENGTH


def test_lm_strength():
    """The strength against the seatings' probability written out as a product, and against the one that seated them."""
    rng = np.random.default_rng(5)
    d, theta = 0.4, 30.0
    c, t = np.zeros(200), np.zeros(200)
    for j in range(200):
        c[j] = rng.integers(1, 300)
        for i in range(int(c[j])):
            t[j] += rng.random() < (theta + d * t[j]) / (theta + i)
    got = lm.strength(c, t, d)

    def likely(x):
        return sum(np.log(x + d * np.arange(1, tj)).sum() - np.log(x + np.arange(1, cj)).sum() for cj, tj in zip(c, t))

    assert likely(got) >= max(likely(got * f) for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2)) and theta * 0.85 < got < theta * 1.15
    assert lm.strength(np.zeros(0), np.zeros(0), d) == lm.strength(np.ones(9), np.ones(9), d) == lm.STRENGTH


def test_lm_tells_gibberish_from_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(4)
    held = [d for d in range(10**6, 10**6 + 200) if zlib.crc32(str(d).encode()) % 10 == 0][:4]
    prose = [r.text for r in docs.where("length(text) BETWEEN 500 AND 3000").orderBy("doc_id").limit(4).collect()]
    nonsense = [" ".join("".join("qxzjkvwy"[int(x)] for x in rng.integers(0, 8, 7)) for _ in range(66)) for _ in range(2)]
    rows = [(held[0], " ".join(prose[0].split()[::2])), (held[1], nonsense[0]), (held[2], nonsense[1]), (held[3], " ".join(prose[1].split()[::2]))]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.scored(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).where(f"doc_id >= {10**6}").collect()}
    assert min(got[held[0]], got[held[3]]) > max(got[held[1]], got[held[2]]) + 1


def test_tables_of_a_dish():
    """Draws against all seatings of a dish, one by one, and the saddle point against the exact numbers."""

    def seatings(c, d):
        every = [((1,), 1.0)]
        for n in range(1, c):
            every = [x for s, w in every for x in [*(((*s[:i], s[i] + 1, *s[i + 1 :]), w * (s[i] - d)) for i in range(len(s))), ((*s, 1), w)]]
        return every

    d, others, base, theta, n = 0.6, 7.0, 0.05, 5.0, 5
    ways = lm.stirling(d)
    exact = collections.Counter()
    for s, w in seatings(n, d):
        exact[len(s)] += w * np.prod([(theta + d * (others + i)) * base for i in range(len(s))])
    u, v = lm.uniforms(np.arange(40_000), np.uint64(3))
    got = np.bincount(lm.draw(np.full(40_000, n), np.full(40_000, others), np.full(40_000, base), d, ways, u, v).astype(int), minlength=n + 1) / 40_000
    total = sum(exact.values())
    assert all(abs(got[t] - exact[t] / total) < 0.01 for t in range(1, n + 1))
    big = lm.stirling(d, 400)
    for c, o, b in ((250, 50.0, 0.2), (400, 3.0, 0.01), (400, 900.0, 0.3)):
        p = big[c, 1 : c + 1] + np.cumsum(np.log((theta + d * (o + np.arange(c))) * b))
        p = np.exp(p - p.max())
        p /= p.sum()
        t = np.arange(1, c + 1)
        got = lm.draw(np.full(40_000, c), np.full(40_000, o), np.full(40_000, b), d, ways, u, v)
        assert abs(got.mean() - (p * t).sum()) < 0.03 * (p * t).sum() + 0.3, (c, o, b)
        assert abs(got.std() - np.sqrt((p * t**2).sum() - (p * t).sum() ** 2)) < 0.4 + 0.1 * got.std()
    keys, _ = lm.spelled([b"banana", b"bandana", b"ban"])
    every, n = np.unique(keys, return_counts=True)
    m = lm.ByteModel(every, n, 1)
    ctx = sum(c << (8 * i) for i, c in enumerate(reversed(b"an")))
    assert abs(m.probability(np.array([(ctx << 8) | c for c in range(256)], np.uint64), 3).sum() - 1) < 1e-9


def test_packing_holds_few_rows_and_no_old_cache():
    import pyarrow as pa

    sizes = [b.num_rows for b in packing._sliced(iter([pa.record_batch({"x": list(range(1300))})]))]
    assert sum(sizes) == 1300 and max(sizes) <= packing.SLICE
    packing.encoder(packing.tokenizer_path())
    packing.forget()
    assert not packing._encoders


def test_packing(docs, empty):
    path = packing.tokenizer_path()
    got = packing.packed(docs, path).collect()
    e = packing.Encoder(path)
    ids = {r[0]: [*e.whole.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in ROWS}
    windows, per = collections.defaultdict(list), collections.Counter()
    for r in got:
        own = ids[r.doc_id]
        part = np.array(own[r.start : r.start + r.length], "<u4").tobytes()
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(part) and len(part) == 4 * r.length > 0
        windows[r.sequence_id].append((r.offset, r.length))
        per[r.doc_id] += r.length
    copies = collections.Counter(r[0] for r in ROWS)
    assert all(per[d] == copies[d] * len(ids[d]) for d in ids)
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.packed(empty, path).count() == 0
    full = sum(n for w in windows.values() for _, n in w)
    assert len(windows) == -(-full // 2048)
    for t in ["it's don't I'LL", "naïve ÀÉ ﬁ ß İst ΣΑΣ", "<|startoftext|> x<|endoftext|>", "“q” \x00 a\x85b"]:
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids


def test_language_id(spark, docs, empty):
    rng = np.random.default_rng(0)
    kinds = {"aa": ["ba", "ko", "mi", "ru"], "bb": ["scht", "ung", "ein", "ver"], "cc": ["eau", "oué", "ière", "ç"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k], 3)) for _ in range(30)), k) for i in range(240) for k in [["aa", "bb", "cc"][i % 3]]]
    rows += [(1000, None, "aa"), (1001, "12 % ½", "bb"), (None, rows[0][1], None), (1002, "BA " * 5000, None)]
    got = {r.doc_id: r for r in langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 240]
    assert held and all(r.lang_pred == ["aa", "bb", "cc"][r.doc_id % 3] for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identified(empty).count() == 0 and langid.identified(docs).count() == len(ROWS)


def test_language_sample_keeps_every_language(spark):
    rows = [(i, "ba ko mi ru " * 20, "aa") for i in range(40)] + [(101, "scht ung ein ver " * 3000, "bb"), (103, "", "bb")]
    rows += [(200 + i, "eau oui mer " * (9000 if i < 3 else 10), "cc") for i in range(60)] + [(None, "été ñandú", "dd"), (None, "été ñandú", "dd"), (None, "çà", "dd")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1600)
    size = collections.Counter()
    for r in got:
        size[r.lang] += len(r.text.encode())
        assert len(r.text.encode()) <= 102
    assert set(size) == {"aa", "bb", "cc", "dd"} and max(size.values()) <= 1602 and size["cc"] > 1500 and sum(r.lang == "dd" for r in got) == 2
    one = langid.fitted([("aa", "ba ko")] * 4 + [("bb", "scht ung"), ("cc", ""), ("cc", "12")] + [("cc", "")] * 2 + [("cc", "eau")])
    assert one.model.langs == ["aa", "bb", "cc"]


def test_pipeline(spark, tmp_path):
    """Each stage on the smallest tables, by its contract."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    sets = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, sets[-1], "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        sets.append(spark.read.parquet(str(tmp_path / name)))
    first, kept, lines, near, mixed, packed = ({r.doc_id: r for r in s.collect()} for s in sets)
    assert all(s.columns == columns for s in sets[:5])
    assert set(kept) == {r.doc_id for r in quality.measured(docs).collect() if r.kept} and set(lines) == set(kept)
    groups = {r.doc_id: r.component_id for r in simhash.grouped(sets[2]).collect()}
    assert set(near) == set(groups.values()) and set(mixed) <= set(near) and set(packed) == set(mixed)


def slow_kneser_ney(samples, order, langs):
    """log2 P(last byte | bytes before) of any string by the formulas, from counts in dictionaries."""
    models = []
    for lang in langs:
        full = collections.Counter()
        opening = [collections.Counter() for _ in range(order)]
        for w in samples[lang]:
            s = b" " + w + b" "
            for end in range(1, len(s)):
                for n in range(1, min(order, end + 1) + 1):
                    if n == order:
                        full[s[end + 1 - n : end + 1]] += 1
                    elif n == end + 1:  # it opens the word: nothing stands before it
                        opening[n - 1][s[: end + 1]] += 1
        levels = [None] * order
        levels[order - 1] = full
        for n in range(order - 1, 0, -1):
            c = collections.Counter(opening[n - 1])
            for longer in levels[n]:
                c[longer[1:]] += 1
            levels[n - 1] = c
        models.append(levels)

    def prob(levels, s):
        n = len(s)
        if not n:
            return 1 / 256
        c = levels[n - 1]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
        total, kinds = sum(v for k, v in c.items() if k[:-1] == s[:-1]), sum(k[:-1] == s[:-1] for k in c)
        low = prob(levels, s[1:])
        return low if not total else max(c[s] - d, 0) / total * (c[s] > 0) + d * kinds / total * low

    return lambda s: [prob(levels, s) for levels in models]


def test_kneser_ney_by_the_formulas():
    samples = {"aa": [b"bako", b"miru", b"bako", b"ba", b"komi"], "bb": [b"schein", b"ung", b"ein", b"ver", b"b\xc3\xa4r"], "cc": [b"x"]}
    m = langid.KneserNey(samples, 3)
    slow = slow_kneser_ney(samples, 3, m.langs)
    for w in (b"bako", b"ungbako", b"x", b"q", b"veru", b"\xc3\xa4"):
        s = b" " + w + b" "
        want = [0.0] * 3
        for end in range(1, len(s)):
            want = [x + np.log2(p) for x, p in zip(want, slow(s[max(0, end - 2) : end + 1]))]
        assert np.allclose(m.words([w])[0], want, atol=1e-4), (w, m.words([w])[0], want)


def test_clashing_columns(spark, docs):
    odd = docs.withColumn("mix_source", F.lit("s")).withColumn("doc", F.lit(1)).withColumn("cuts", F.lit("x")).withColumn("row", F.lit(2)).withColumn("kept", F.lit(False))
    for stage in (mixing.mix, linededup.dedup, simhash.dedup, quality.keep):
        got = stage(odd)
        assert got.columns == odd.columns and got.count() == stage(docs).count()


def test_clashing_columns_and_many_rows_without_ids(spark, docs, empty):
    """Signatures, mixing and packing are those of the plain table whatever other columns there are; rows without source or id count."""
    more = docs.withColumns({c: F.lit("clash") for c in ("n", "head", "of", "th", "size", "bucket", "h", "part", "ids", "start", "target", "taken", "tail", "key")})
    for f in (fingerprints.fingerprinted, mixing.mixed, packing.packed):
        want = f(docs)
        cols = [c for c in want.columns if c in ("doc_id", "n_chars", "fingerprint", "edited_fingerprint", "near_next", "source_size", "length", "ids_crc32", "offset")]
        assert sorted(map(repr, f(more).select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect())) and f(empty).count() == 0
    none = spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('word ', id) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source")
    got = mixing.mixed(none).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.min("taken").alias("low"), F.max("taken").alias("high")).collect()
    assert len(got) == 1 and got[0].source_size == 800 and got[0].low == got[0].high  # rows of one id, none included, go together
    assert packing.packed(none).where("start = 0").count() == 400


def test_quality_counts_lines_and_chunks():
    import zstandard

    text = "one line here\n\n  \none line here\nother\none line here\n\n  "
    got = quality.measure(text, zstandard.ZstdCompressor(level=3))
    assert got[3] == 2  # blank lines are no repeats
    low = quality.measure("\n".join(f"Item {i} of the long list was sold" for i in range(400)), zstandard.ZstdCompressor(level=3))
    assert not low[6] and low[7] < quality.limits(low[10])[0] and low[8] > quality.BAD_SHARE * low[9]  # repetitive: under the band as a whole and by chunks
