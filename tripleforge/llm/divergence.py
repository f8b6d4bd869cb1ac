"""Source divergence audit: how far the word use of sources of a language lies apart, in exact whole numbers.

Tasks count terms of whole texts and hand on sums by (lang, source, term), so a frequent term or a hot source is a row
for each task. A language keeps the terms of at least MIN_DOCUMENTS rows; a hash deals them into vocabulary chunks of
about CHUNK terms, numbered inside a chunk. Each group (a source of a language) has one packed count vector a chunk.

Pairs come from a two-dimensional tiling: groups stand in blocks of BLOCK, and a vector is replicated to the tiles of its
block with every block of the language, each pair of blocks once. A task reads the sorted chunks of a tile one after the
other, holds those vectors alone and adds both directions to the tile's matrix; SPAN chunks are a task's share, so that a
language with few sources is spread as well. The sums of the shares give the matrix.

With p = 1 + floor(10^9 (count + 1) / (N + V)) the squares and sums fit 64 bits while V < 10^9: p is below 10^9 + 2, and
the sum of (p-q)^2/q over a vocabulary at most (10^9 + 2 V)^2. Quotients are taken with decimals, as counts may pass 2^33.

Defined results: null text, lang and source are ''; an empty text has no term but its row's group occurs; a long text is
counted in pieces cut between terms; repeated rows are documents of their own; a language without kept terms gives pairs
of value 0; a group alone in its language has no pair; ties rank by the item's bytes; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import stored

MIN_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms of a vocabulary chunk (expected), groups of a block, chunks of a task's share of a tile.
CHUNK, BLOCK, SPAN = 4096, 64, 4
#: Entries a task holds before it hands on its sums, bytes of a text counted at once.
HELD, PIECE = 400_000, 1 << 20
FIELDS = "lang string, source string, part string, item string, value long, rank int"
#: ASCII that is no letter becomes a blank, A-Z becomes a-z; bytes of other characters stay.
_TERMS = bytes(32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if b <= 90 else b for b in range(256))


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some PIECE bytes at a time."""
    data, at = data.translate(_TERMS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows by group and term, and for every group a row without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of: dict = {}
        d_of: dict = {}
        held = 0

        def sums():
            for (lang, source), n in n_of.items():
                size, docs_with = len(n) + 1, d_of[lang, source]
                cols = [pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), pa.array([None, *n], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs_with.__getitem__, n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            n_of.clear()
            d_of.clear()

        for b in batches:
            langs, sources = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, text in enumerate(b.column(0)):
                group = (langs[i], sources[i])
                if group not in n_of:
                    n_of[group], d_of[group], held = Counter(), Counter(), held + 1
                n, d = n_of[group], d_of[group]
                before, seen = len(n), set()
                for words in _pieces(text.as_py()):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                held += len(n) - before
                if held > HELD:
                    yield from sums()
                    held = 0
        if n_of:
            yield from sums()

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return texts.select(F.col("text").cast("binary").alias("text"), "lang", "source").mapInArrow(run, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def _p(count, total):
    return (F.lit(1) + F.expr(f"CAST((CAST({SCALE} AS DECIMAL(18,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({total} AS DECIMAL(20,0)) AS BIGINT)")).cast("long")


def _tiled(vectors: DataFrame) -> DataFrame:
    """(lang, g, h, value) of every ordered pair of groups from replicated vectors (lang, a, b, span, chunk, side, g, total, size, pos, n), by successive chunks."""
    fields = "lang string, g long, h long, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk, sides, sums = None, None, ({}, {}), {}

        def rows(side: dict):
            keys = sorted(side)
            size = next((side[k][1] for k in keys), 0)
            out = np.zeros((len(keys), size), np.int64)
            for i, k in enumerate(keys):
                total, _, pos, n = side[k]
                if size:
                    out[i] = 1 + SCALE // total
                    out[i, pos] = 1 + SCALE * (n + 1) // total if n.max(initial=0) < 1 << 32 else [1 + SCALE * (int(x) + 1) // total for x in n]
            return keys, out

        def add():
            keys_a, a = rows(sides[0])
            keys_b, b = (keys_a, a) if tile[1] == tile[2] else rows(sides[1])
            for i, g in enumerate(keys_a):
                d = a[i] - b
                d *= d
                there, back = (d // b).sum(1), (d // a[i]).sum(1)
                for j, h in enumerate(keys_b):
                    if g != h:
                        sums[g, h] = sums.get((g, h), 0) + int(there[j])
                        if tile[1] != tile[2]:
                            sums[h, g] = sums.get((h, g), 0) + int(back[j])
            sides[0].clear()
            sides[1].clear()

        def out():
            cols = [[tile[0]] * len(sums), [g for g, _ in sums], [h for _, h in sums], list(sums.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["lang", "g", "h", "value"])
            sums.clear()

        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            scalars = zip(*(c[k].to_pylist() for k in ("lang", "a", "b", "span", "chunk", "side", "g", "total", "size")))
            for i, (lang, a, b, span, ch, side, g, total, size) in enumerate(scalars):
                if ((lang, a, b, span), ch) != (tile, chunk):
                    if tile is not None:
                        add()
                        if (lang, a, b, span) != tile:
                            yield from out()
                    tile, chunk = (lang, a, b, span), ch
                sides[side][g] = (total, size, np.array(c["pos"][i].as_py() or [], np.int64), np.array(c["n"][i].as_py() or [], np.int64))
        if tile is not None:
            add()
            yield from out()

    return vectors.mapInArrow(run, fields)


def audited(docs: DataFrame, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """FIELDS: the parts `pair` and `term` of docs(text, lang, source)."""
    # one exchange by (lang, term): sums of a group, then of the language, whose first row stands for the term
    word = Window.partitionBy("lang", "term")
    sums = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = sums.withColumn("lang_docs", F.sum("docs").over(word)).withColumn("lang_n", F.sum("n").over(word)).withColumn("first", F.row_number().over(word.orderBy("source")) == 1)
    sums = stored(sums.where((F.col("lang_docs") >= MIN_DOCUMENTS) | F.col("term").isNull()).drop("docs", "lang_docs"))
    found = sums.where("term IS NOT NULL")
    once = F.when(F.col("first") & F.col("term").isNotNull(), True)
    sizes = sums.groupBy("lang").agg(F.count(once).alias("v"), F.coalesce(F.sum(F.when(once, F.col("lang_n"))), F.lit(0)).alias("lang_total"))
    sizes = stored(sizes.withColumn("chunks", F.greatest(F.ceil(F.col("v") / chunk), F.lit(1)).cast("long")))  # a row for each language

    # groups: their totals over kept terms, their numbers in the language
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = sums.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(sizes, "lang").withColumn("g", number)
    groups = stored(groups.select("lang", "source", "g", "v", "chunks", (F.col("total") + F.col("v")).alias("total"), (F.col("lang_total") + F.col("v")).alias("lang_total")))

    # terms: those a group uses beyond its language, the first ranks alone
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    terms = terms.select("lang", "source", "term", _p("n", "total").alias("p"), _p("lang_n", "lang_total").alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # pairs: every group has a packed vector for every chunk, which goes to the tiles of its block
    at = found.join(groups.select("lang", "source", "g", "chunks"), ["lang", "source"]).select("lang", "g", "term", "n", "first", F.pmod(F.xxhash64("term"), "chunks").alias("chunk"))
    at = at.repartition("lang", "chunk").withColumn("pos", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    packed = stored(at.groupBy("lang", "chunk", "g").agg(F.collect_list(F.struct("pos", "n")).alias("at"), F.count(F.when(F.col("first"), True)).alias("firsts")))
    held = packed.groupBy("lang", "chunk").agg(F.sum("firsts").alias("size"))
    grid = groups.select("lang", "g", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    grid = grid.join(held, ["lang", "chunk"], "left").join(packed.drop("firsts"), ["lang", "chunk", "g"], "left")
    blocks = groups.groupBy("lang").agg(F.floor(F.max("g") / block).alias("last"))
    mine = F.floor(F.col("g") / block)
    grid = grid.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    grid = grid.select("lang", F.least(mine, "other").alias("a"), F.greatest(mine, "other").alias("b"), F.floor(F.col("chunk") / span).alias("span"), "chunk", (mine > F.col("other")).cast("int").alias("side"), "g", "total", F.coalesce("size", F.lit(0)).alias("size"), F.col("at.pos").alias("pos"), F.col("at.n").alias("n"))
    matrix = _tiled(grid.repartition("lang", "a", "b", "span").sortWithinPartitions("lang", "a", "b", "span", "chunk", "side", "g")).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "g", "source")
    pairs = matrix.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
