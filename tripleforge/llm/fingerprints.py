"""Order MinHash document fingerprints, by SQL functions alone.

A text is cut into symbols, every code point being in exactly one: a word of up to PIECE characters with at most one white
space after it, or a run of white space. Longer runs without white space are cut by what stands there, after a character
of BOUNDARY (vowels, digits, marks and all characters beyond Latin script, so that texts without blanks come apart into
characters), so an insertion moves the cuts near it alone. K neighbouring symbols are a k-mer, and a k-mer found again
gets the next occurrence number, so that repeats count. One random order (a hash of k-mer and number) is dealt into BINS
bins; from each bin the two minimal numbered k-mers are taken (where it holds one, as in short texts, the next bin's least
joins it), put back into the order of the text, and hashed as a tuple: a component of the signature. Components differ where k-mers differ in content, multiplicity or order, so the
share of equal components follows edit distance rather than set overlap.

A row costs a few passes over an array of 64-bit numbers (36 bits of hash, 28 of place); nothing is exploded, and texts
move once. `let` binds an intermediate value to a lambda variable, so that it is computed once a row.

Defined results: a null text is empty; an empty text has an empty fingerprint; two empty fingerprints have likeness 1,
one empty and one not 0. Rows with a null doc_id have no place in the order: no tail is added to them and near_next is
0. Of repeated doc_ids the next document is the one whose text has the least XXH64; every row is returned. A single document is its own
next one. An empty table gives an empty result. Extra columns are ignored. A very long text is one row, read whole; beyond
2^28 symbols places are no longer told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import stored

PIECE, K, BINS_LOG2 = 12, 3, 6
BOUNDARY = r"aeiouyAEIOUY0-9.,;:!?/+=_%&#\\-\\x{250}-\\x{10FFFF}"
_LOW = (1 << 28) - 1


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def signature(text: str, k: int = K, bins_log2: int = BINS_LOG2) -> str:
    """SQL for array<int> of components (bin << 16 | 16 bits of the tuple's hash), in the order of bins; text: SQL for a string."""
    top = 64 - bins_log2
    gram = ", ".join(f"p[i + {j}]" for j in range(k))
    short = ", ".join(f"get(p, {j})" for j in range(k))
    numbers = f"CASE WHEN size(p) >= {k} THEN transform(sequence(0, size(p) - {k}), i -> (xxhash64({gram}) & ~{_LOW}L) | i) WHEN size(p) > 0 THEN array(xxhash64({short}) & ~{_LOW}L) ELSE array() END"
    starts = "filter(sequence(0, size(s) - 1), j -> j = 0 OR shiftright(s[j], 28) <> shiftright(s[j - 1], 28))"
    run = "coalesce(get(st, g + 1), size(s)) - st[g]"
    again = f"flatten(transform(filter(sequence(0, size(st) - 1), g -> {run} > 1), g -> transform(slice(s, st[g] + 2, {run} - 1), (v, o) -> (xxhash64(shiftright(v, 28), o + 1) & ~{_LOW}L) | (v & {_LOW}L))))"
    numbered = f"CASE WHEN size(s) = 0 THEN s ELSE {let('st', starts, f'CASE WHEN size(st) = size(s) THEN s ELSE sort_array(concat(transform(st, b -> s[b]), {again})) END')} END"
    minimal = f"filter(al, (v, j) -> j < 2 OR shiftright(al[j - 2], {top}) <> shiftright(v, {top}))"
    heads = f"filter(sequence(0, size(m) - 1), j -> j = 0 OR shiftright(m[j - 1], {top}) <> shiftright(m[j], {top}))"
    a, b = "shiftright(m[j], 28)", "shiftright(n, 28)"
    pair = f"CASE WHEN (m[j] & {_LOW}L) < (n & {_LOW}L) THEN xxhash64({a}, {b}) ELSE xxhash64({b}, {a}) END"
    tuple_hash = f"CASE WHEN size(m) = 1 THEN xxhash64({a}) ELSE {let('n', 'coalesce(get(m, j + 1), m[0])', pair)} END"
    parts = f"CASE WHEN size(m) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE transform({heads}, j -> CAST(shiftleft(shiftright(m[j], {top}) + {1 << (bins_log2 - 1)}, 16) | ({tuple_hash} & 65535L) AS INT)) END"
    pieces = f"regexp_extract_all({text}, '\\\\S{{1,{PIECE}}}+(?!\\\\S)\\\\s?|[^\\\\s{BOUNDARY}]{{0,{PIECE - 1}}}+\\\\S\\\\s?|\\\\s{{1,{PIECE}}}', 0)"
    return let("p", pieces, let("s", f"sort_array({numbers})", let("al", numbered, let("m", minimal, parts))))


def shown(parts: str) -> str:
    """SQL for the fingerprint string of a signature: six hex digits a component."""
    return f"array_join(transform({parts}, c -> lpad(hex(c), 6, '0')), '')"


def likeness(a: str, b: str) -> str:
    """SQL for the share of equal components among the bins that either signature fills."""
    filled = f"size(array_union(transform({a}, c -> shiftright(c, 16)), transform({b}, c -> shiftright(c, 16))))"
    return f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1.0D ELSE CAST(size(array_intersect({a}, {b})) AS DOUBLE) / {filled} END"


def next_ids(ids: DataFrame, rows: int = 200_000) -> DataFrame:
    """(doc_id, next_id, q): each distinct id's successor, the last one's being the first; q: a quarter of the longest text of the id.

    Ids are dealt into ranges; a window runs within a range, and the ranges' first ids close the gaps.
    """
    one = stored(ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n").alias("n")))
    one = stored(one.repartitionByRange(max(1, -(-one.count() // rows)), "doc_id").withColumn("range", F.spark_partition_id()))
    first = one.groupBy("range").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("range")  # over ranges, a row for each
    after = first.select(F.col("range"), F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("after"))
    lead = F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id"))
    out = one.withColumn("lead", lead).join(F.broadcast(after), "range")  # a row for each range of `rows` ids
    return out.select("doc_id", F.coalesce("lead", "after").alias("next_id"), F.floor(F.col("n") / 4).cast("int").alias("q"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    as_it_is = dict(docs.select("doc_id").dtypes).get("doc_id") == "bigint"  # an alias that changes nothing would keep Spark from sharing the exchange of texts
    texts = docs.select(F.col("doc_id") if as_it_is else F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    after = stored(next_ids(texts.select("doc_id", F.length("text").alias("n"))))
    named = texts.where("doc_id IS NOT NULL")  # dealt by doc_id once, for both joins
    heads = named.join(after.select(F.col("doc_id").alias("of"), F.col("next_id"), "q"), named.doc_id == F.col("next_id")).select("of", F.expr("substring(text, 1, q)").alias("head"), F.xxhash64("text").alias("th"))
    heads = heads.groupBy("of").agg(F.min_by("head", F.struct("th", "head")).alias("head"))
    both = named.join(heads, named.doc_id == heads.of, "left").select("doc_id", "text", F.length("text").alias("n"), "head")
    both = both.unionByName(texts.where("doc_id IS NULL").select("doc_id", "text", F.length("text").alias("n"), F.lit(None).cast("string").alias("head")))
    both = both.selectExpr("doc_id", "text", "n", "concat(substring(text, 1, n - n div 4), substring(coalesce(head, ''), 1, n div 4)) AS edited")
    parts = stored(both.selectExpr("doc_id", "xxhash64(text) AS th", "CAST(n AS BIGINT) AS n_chars", "sha2(edited, 256) AS edited_sha256", f"{signature('text')} AS a", f"{signature('edited')} AS b"))
    following = parts.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id")).agg(F.min_by("a", "th").alias("c"))
    out = parts.join(after.select("doc_id", "next_id"), "doc_id", "left").join(following, "next_id", "left")
    return out.selectExpr("doc_id", "n_chars", "edited_sha256", f"{shown('a')} AS fingerprint", f"{shown('b')} AS edited_fingerprint", f"{likeness('a', 'b')} AS near_edited", f"CASE WHEN c IS NULL THEN 0.0D ELSE {likeness('a', 'c')} END AS near_next")
