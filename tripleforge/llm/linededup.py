"""Line dedup by a segment-partition edit join, by DataFrame and SQL functions alone.

Lines that are not blank are deduplicated over all documents; blank ones (white space alone) are left alone. A line is
dropped if an equal line, or a different line at most EDITS edits away, stands earlier (by doc_id, then line number; of
different texts with one doc_id or none, by two hashes of the text before the line number). Equal lines are found at any length, different ones from 2 * EDITS + 1 code points on, the least
length that leaves a character for every segment.

Equal lines are one class (by two hashes); only its first line goes on. The edit join cuts a line into EDITS + 1
segments. Of two lines within EDITS edits, the longer one holds at least one segment of the shorter one, near where it
stood: so each line is indexed by its segments, with their number and its length, and probes the substrings of every
length that it could match, at the places that the multi-match-aware rule allows. An edit changes the counts of at most
two letters by one: matches whose counts of LETTERS, modulo MODULO, differ by more than 2 * EDITS in all leave within the
join, and those whose counts of LATER do so leave when the texts are there; the others are verified by a banded
bit-parallel edit distance (one 64-bit word for the band, one step a column).

The join's rows name a line by its first hash alone; both hashes come back with the texts, so lines that share it are told
apart there. Every link between lines of different first hashes is found. Hot lines cost one row from the class on; hot segments are pruned by
counts inside the join, and Spark may split their partitions.

Defined results: a null text has one empty line and nothing is dropped; null doc_ids come last; equal rows (id and text)
drop the same lines, and rows of one doc_id (or none) with different texts are documents of their own; extra columns are ignored by `line_links` and `decisions` and kept by `dedup`; an empty table gives
an empty result. Texts and lines are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprints import let
from .util import DOC_KEY, fresh, stored

EDITS, BROADCAST_ROWS = 2, 500_000
LETTERS, LATER, BITS = "eationsrld", " umcpgvfbhkwyz", 3
MODULO = 1 << BITS


def lines_of(docs: DataFrame) -> DataFrame:
    """line, h, h2, ord (the document's key and the line number) of every line that is not blank."""
    rows = docs.selectExpr(f"{DOC_KEY} AS doc", "text").selectExpr("doc", "posexplode(split(text, '\\n', -1)) AS (pos, line)").where(F.col("line").rlike(r"(?U)\S"))
    return rows.selectExpr("line", "xxhash64(line) AS h", "hash(line) AS h2", "named_struct('doc', doc, 'pos', pos) AS ord")


def distance(a: str, b: str, edits: int = EDITS) -> str:
    """SQL for the edit distance of two strings where it is at most `edits`, else any larger number; length(a) <= length(b) <= length(a) + edits.

    Columns are b's characters. The word holds rows j - edits .. j + edits of column j: bit r of `vp` and `vn` says that the
    cell is one more or less than the one above it. `sc` follows the diagonal that ends in the last cell.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    match = " | ".join(f"CASE WHEN get(x, j - {edits} + {r}) = y[j] THEN {1 << r}L ELSE 0L END" for r in range(width))
    d0 = "((((m & z.vp) + z.vp) ^ z.vp) | m | z.vn)"
    hp, hn = f"((z.vn | ~(d | z.vp)) & {full}L)", "(d & z.vp)"
    step = let("m", f"({match})", let("d", f"({d0} & {full}L)", f"named_struct('vp', ({hn} | ~(shiftright(d, 1) | {hp})) & {full}L, 'vn', shiftright(d, 1) & {hp}, 'sc', z.sc + CASE WHEN j >= e AND (shiftright(d, {edits} - e) & 1L) = 0L THEN 1 ELSE 0 END)"))
    start = f"named_struct('vp', {((1 << (edits + 1)) - 1) << edits}L, 'vn', 0L, 'sc', e)"
    chars = lambda t: f"regexp_extract_all({t}, '(?s).', 0)"
    body = f"CASE WHEN size(y) = 0 THEN 0 ELSE aggregate(sequence(0, size(y) - 1), {start}, (z, j) -> {step}, z -> z.sc) END"
    return let("x", chars(a), let("y", chars(b), let("e", "size(y) - size(x)", body)))


def _segments(length: str, edits: int) -> list[tuple[int, str, str]]:
    """(number, start, size) of each segment of a line: SQL over its length."""
    n = edits + 1
    size = lambda i: f"(({length}) div {n} + CASE WHEN {i} > {n} - ({length}) % {n} THEN 1 ELSE 0 END)"
    start = lambda i: f"(1 + {i - 1} * (({length}) div {n}) + greatest(0, {i - 1} - ({n} - ({length}) % {n})))"
    return [(i, start(i), size(i)) for i in range(1, n + 1)]


def line_links(docs: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """occurrences (h, h2, ord), classes (h, h2, first, n) and links (h, h2, g, g2: two different lines within `edits`), all stored."""
    lines = lines_of(docs)
    occ = stored(lines.drop("line"))
    classes = stored(occ.groupBy("h", "h2").agg(F.min("ord").alias("first"), F.count("*").alias("n")))
    c = classes.select(F.col("h").alias("ch"), F.col("h2").alias("ch2"), F.col("first"))
    tries, bounds, shorter = [], [], 1 << BITS * len(LETTERS)  # this bit beside the counts: the other line is a shorter one
    for less in range(edits + 1):
        for i, s, n in _segments(f"len - {less}", edits):
            bounds += [f"CAST(4 * {s} - 3 AS INT) AS s{less}_{i}", f"CAST(4 * {n} AS INT) AS n{less}_{i}"]
            low, high = max(-(i - 1), less - (edits + 1 - i)), min(i - 1, less + (edits + 1 - i))
            tries += [(less, i, move) for move in range(low, high + 1)]
    own = {(0, i, 0) for i in range(1, edits + 2)}  # the keys in the index: where a line of equal length has the segment in place
    tries.sort(key=lambda t: t not in own)  # stable: the index keys come first
    # Four bytes a character: a segment is cut out without counting characters from the line's start. No segment is empty, so
    # none moves out of the line. `name` tells number and length. Bounds are columns, to keep the generated method small.
    key = lambda less, i, move: f"xxhash64(name + ({i - less * (edits + 2)}), substring(wide, s{less}_{i} + ({4 * move}), n{less}_{i}))"
    # Letters leave one after the other: each is counted in what the ones before it left. A higher-order function also keeps
    # the counts out of the generated method of the keys, which is interpreted if it grows beyond 8,000 bytes.
    then = f"(z.c << {BITS}) | ((z.n - octet_length(z.rest)) & {MODULO - 1})"
    counts = f"aggregate(split('{LETTERS}', ''), named_struct('rest', line, 'n', octet_length(line), 'c', 0L), (z, x) -> named_struct('rest', replace(z.rest, x, ''), 'n', octet_length(z.rest), 'c', {then}), z -> {then})"
    rows = lines.where(F.length("line") > 2 * edits).selectExpr("h", "h2", "ord", f"{counts} AS cnt", "encode(line, 'UTF-32') AS wide")
    # keys move instead of texts: they are shorter, and index and probe share their exchange
    rows = rows.selectExpr("*", "octet_length(wide) div 4 AS len").selectExpr("*", f"CAST({edits + 2} * len AS INT) AS name", *bounds)
    keyed = rows.selectExpr("h", "h2", "ord", "cnt", f"array({', '.join(key(*t) for t in tries)}) AS keys")
    one = keyed.join(c, (keyed.h == c.ch) & (keyed.h2 == c.ch2) & (keyed.ord == c["first"])).select("h", "cnt", "keys")
    index = one.selectExpr("h", "cnt", f"explode(slice(keys, 1, {len(own)})) AS key")
    probe = one.selectExpr("h AS g", "cnt", f"posexplode(slice(keys, 1, {len(tries)})) AS (k, pkey)")
    longer = ", ".join(str(k) for k, t in enumerate(tries) if t[0])
    probe = probe.selectExpr("g", f"cnt | CASE WHEN k IN ({longer}) THEN {shorter} ELSE 0 END AS mark", "pkey")
    ahead = f"(mark >= {shorter} OR h < g)"
    apart = lambda i: f"((shiftright(cnt, {BITS * i}) - shiftright(mark, {BITS * i})) & {MODULO - 1})"
    differ = " + ".join(f"least({apart(i)}, {MODULO} - {apart(i)})" for i in range(len(LETTERS)))
    pairs = index.join(probe, F.expr(f"key = pkey AND {ahead} AND {differ} <= {2 * edits}"))
    pairs = stored(pairs.select("h", "g").distinct())
    wanted = stored(pairs.select("h").union(pairs.select("g")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    text = stored(lines.join(wanted, "h", "left_semi").groupBy("h", "h2").agg(F.min("line").alias("line")))
    other = text.select(F.col("h").alias("g"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    checked = pairs.join(text, "h").join(other, "g").where(f"length(other) - length(line) BETWEEN 0 AND {edits}")
    checked = checked.where(F.expr(" + ".join(f"abs(octet_length(line) - octet_length(other) + octet_length(replace(other, '{x}', '')) - octet_length(replace(line, '{x}', '')))" for x in LATER) + f" <= {2 * edits}"))
    links = checked.where(F.expr(f"{distance('line', 'other', edits)} <= {edits}")).select("h", "h2", "g", "g2")
    return occ, classes, stored(links)


def _verdicts(docs: DataFrame, edits: int) -> DataFrame:
    """doc (the key), dropped (line numbers), n_links for documents with repeated or linked lines."""
    occ, classes, links = line_links(docs, edits)
    ends = links.union(links.select("g", "g2", "h", "h2"))
    a, b = classes.select("h", "h2", "first"), classes.select(F.col("h").alias("g"), F.col("h2").alias("g2"), F.col("first").alias("theirs"))
    near = ends.join(a, ["h", "h2"]).join(b, ["g", "g2"]).groupBy("h", "h2").agg(F.max((F.col("theirs") < F.col("first")).cast("int")).alias("near"), F.count("*").alias("links"))
    status = classes.join(near, ["h", "h2"], "left").where("n > 1 OR links IS NOT NULL").select("h", "h2", "first", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("links", F.lit(0)).alias("links"))
    hit = occ.join(status, ["h", "h2"])
    return hit.groupBy("ord.doc").agg(F.sort_array(F.collect_set(F.when((F.col("ord") != F.col("first")) | (F.col("near") == 1), F.col("ord.pos")))).alias("dropped"), F.sum("links").alias("n_links"))


def decisions(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_links, dropped for every row of docs(doc_id, text)."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", f"{DOC_KEY} AS doc", "CAST(coalesce(octet_length(text) - octet_length(replace(text, '\\n', '')) + 1, 1) AS BIGINT) AS n_lines")
    out = rows.join(_verdicts(docs, edits), "doc", "left")
    return out.selectExpr("doc_id", "n_lines", "CAST(coalesce(size(dropped), 0) AS BIGINT) AS n_dropped", "coalesce(n_links, 0) AS n_links", "coalesce(dropped, CAST(array() AS ARRAY<INT>)) AS dropped")


def dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs with the dropped lines taken out of text; n_chars, if there, is counted again; every row stays."""
    key, cuts = fresh(docs, "doc"), fresh(docs, "cuts")
    v = _verdicts(docs, edits).where("size(dropped) > 0").select(F.col("doc").alias(key), F.col("dropped").alias(cuts))
    out = docs.join(v, F.expr(DOC_KEY) == v[key], "left")
    cut = F.expr(f"CASE WHEN {cuts} IS NULL THEN text ELSE array_join(filter(split(text, '\\n', -1), (l, i) -> NOT array_contains({cuts}, i)), '\\n') END")
    out = out.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
