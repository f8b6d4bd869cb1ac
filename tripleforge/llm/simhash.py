"""SimHash near-dedup with a hierarchical index in Gray order.

A fingerprint has a bit for each that over half the shingles' XXH64 values have. Equal fingerprints are one row from then
on. Two fingerprints that differ in at most three bits agree in one of four 16-bit blocks, so each goes to four keys.
Under a key, fingerprints stand in Gray order, in which neighbours share bits: sixteen neighbours make a node that holds
the bits they all share (mask and pattern), sixteen nodes the node above, up to one root a key. A search adds up
differences from the root down, each node only in bits that its parent lacks, and drops a node with all below it once
the sum passes the limit or all below it stands before the one that searches. Many keys are searched at once. A key with
over SPLIT fingerprints is cut by further blocks. Links under a key leave as a forest, never as all pairs, and meet in
`components`.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer than
three words make one shingle; a null doc_id takes part but names no component unless all of its component are null;
repeated rows stay; an empty table gives an empty result. Texts are read whole; memory holds a batch of texts or one
key's distinct fingerprints (8 bytes each). `dedup` keeps one row of each component with all its columns, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import DOC_KEY, fresh, partitions, stored

SHINGLE, LIMIT, BLOCKS, FAN, SPLIT, BUFFER = 3, 3, 4, 16, 8192, 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower changes A-Z alone, bytes.split cuts at ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    h = np.fromiter((digest(b" ".join(g), 42) for g in zip(*[words[i:] for i in range(shingle)])), np.uint64, len(words) - shingle + 1)
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (DOC_KEY), fp (the 64 bits as a signed long) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.select("doc_id", F.expr(DOC_KEY).alias("key"), "text").mapInArrow(run, "doc_id long, key struct<none: boolean, oid: long, t1: long, t2: int>, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of the codes in Gray order: the number whose Gray code each is."""
    r = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """owner and value of every number in the ranges start .. start + count - 1."""
    owner = np.repeat(np.arange(len(starts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class GrayIndex:
    """Trees over codes in Gray order, one for each run of codes; runs: their starts, then the end.

    levels[0] are the codes; a node above holds the bits that `fan` neighbours of its run share, up to one root a run.
    """

    def __init__(self, codes: np.ndarray, runs: np.ndarray | None = None, fan: int = FAN):
        runs = np.array([0, len(codes)]) if runs is None else runs
        self.run = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
        self.levels = [(codes, np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF)), None, None)]
        self.ends = [np.arange(1, len(codes) + 1)]  # the codes below a node end here
        while len(codes) and np.diff(runs).max() > 1:
            pattern, mask = self.levels[-1][:2]
            nodes = -(-np.diff(runs) // fan)
            owner, at = _ranges(np.zeros(len(nodes), np.int64), nodes)
            first = runs[owner] + at * fan
            last = np.minimum(first + fan, runs[owner + 1])
            both = np.bitwise_and.reduceat(pattern & mask, first)
            some = np.bitwise_or.reduceat(pattern & mask, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(both ^ some)
            self.levels.append((both & shared, shared, first, last))
            self.ends.append(self.ends[-1][last - 1])
            runs = np.concatenate([[0], np.cumsum(nodes)])

    def search(self, limit: int = LIMIT, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) places of codes i < j of one run at most limit bits apart, a block of codes at a time."""
        codes, top = self.levels[0][0], len(self.levels) - 1
        block = max(1, most // FAN)
        for at in range(0, len(codes), block):
            who = np.arange(at, min(at + block, len(codes)))
            node = self.run[who] if top else who
            yield from self._down(who, node, np.zeros(len(who), np.int64), None, top, limit, most)

    def _down(self, who, node, acc, parent, level, limit, most):
        if len(who) > most:  # halves keep the frontier bounded
            h = len(who) // 2
            for part in (slice(0, h), slice(h, None)):
                yield from self._down(who[part], node[part], acc[part], None if parent is None else parent[part], level, limit, most)
            return
        pattern, mask, first, last = self.levels[level]
        own = mask[node] if parent is None else mask[node] & ~parent
        acc = acc + np.bitwise_count((self.levels[0][0][who] ^ pattern[node]) & own)
        ok = (acc <= limit) & (self.ends[level][node] > who + 1)  # later codes alone
        who, node, acc = who[ok], node[ok], acc[ok]
        if not level:
            yield who, node
        elif len(who):
            owner, child = _ranges(first[node], last[node] - first[node])
            yield from self._down(who[owner], child, acc[owner], mask[node][owner], level - 1, limit, most)


def linked(codes: np.ndarray, runs: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each code the place of the least code that links reach within its run; codes of a run stand together in Gray order; runs: starts, then the end."""
    label = np.arange(len(codes))
    for i, j in GrayIndex(codes, runs).search(limit):
        while True:
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label[:] = label[label]
    return label


def _bits(name: str, low: int, width: int):
    return F.shiftrightunsigned(name, low).bitwiseAND((1 << width) - 1)


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b): a forest of links under every key of the distinct fingerprints fps(fp).

    A key is a block and its value. Of a key with over `split` fingerprints the other bits are cut into blocks again, one of
    which two linked ones share as well, and each of those is a key of its own.
    """
    width = 64 // BLOCKS
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _bits("fp", b * width, width).alias("value")) for b in range(BLOCKS)])).alias("k")).select("fp", "k.block", "k.value")
    hot = stored(keys.groupBy("block", "value").count().where(F.col("count") > split).select("block", "value"))
    if hot.isEmpty():
        keys = keys.select("fp", "block", F.col("value").cast("long"), F.lit(0).alias("part"))
    else:
        rest = F.when(F.col("block") == 0, F.shiftrightunsigned("fp", width))  # the bits beside the block's, together
        for b in range(1, BLOCKS):
            high = F.shiftleft(F.shiftrightunsigned("fp", (b + 1) * width), b * width) if b < BLOCKS - 1 else F.lit(0)
            rest = rest.when(F.col("block") == b, high.bitwiseOR(_bits("fp", 0, b * width)))
        less = (64 - width) // BLOCKS
        marked = keys.join(hot.withColumn("hot", F.lit(True)), ["block", "value"], "left").withColumn("rest", rest)
        part = F.when(F.col("hot"), F.array(*[F.struct(F.lit(p + 1).alias("part"), _bits("rest", p * less, less).alias("more")) for p in range(BLOCKS)])).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("more"))))
        keys = marked.select("fp", "block", "value", F.explode(part).alias("s")).select("fp", "block", (F.shiftleft(F.col("s.more"), width) + F.col("value")).cast("long").alias("value"), "s.part")

    def flush(held: list) -> pa.RecordBatch:
        codes, key = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((gray_rank(codes), key))
        codes, key = codes[order], key[order]
        runs = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(codes)]])
        label = linked(codes, runs)
        own = np.flatnonzero(label != np.arange(len(codes)))
        return pa.RecordBatch.from_arrays([pa.array(codes[own].view(np.int64)), pa.array(codes[label[own]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, at = [], 0, None  # whole keys, then the last one, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            codes, block, value, part = (b.column(i).to_numpy() for i in range(4))
            key = np.cumsum((np.diff(block, prepend=-1) != 0) | (np.diff(value, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
            start = (block[0], value[0], part[0])
            key += (held[-1][1][-1] if held else 0) - (at == start)
            at = (block[-1], value[-1], part[-1])
            cut = int(np.searchsorted(key, key[-1]))
            if n + cut >= BUFFER and cut:
                yield flush([*held, (codes[:cut].view(np.uint64), key[:cut])])
                held, n, codes, key = [], 0, codes[cut:], key[cut:]
            elif n >= BUFFER and not cut and key[-1] != held[-1][1][-1]:
                yield flush(held)
                held, n = [], 0
            held.append((codes.view(np.uint64), key))
            n += len(codes)
        if held:
            yield flush(held)

    dealt = keys.repartition(partitions(fps.sparkSession), "block", "value", "part").sortWithinPartitions("block", "value", "part")
    return dealt.select("fp", "block", "value", "part").mapInArrow(run, "a long, b long")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, fp) for every row, and (fp, root, component_id) for every fingerprint, both stored."""
    fps = stored(fingerprints(docs))
    codes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(codes.select("fp")))
    named = codes.join(roots, codes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps, stored(named.join(ids, "root").select("fp", "root", "component_id"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs(doc_id, text)."""
    fps, table = _groups(docs)
    return fps.join(table, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the least doc_id (none comes last), then of the least hash of its text; of equal rows one."""
    fps, table = _groups(docs)
    kept = fps.join(table, "fp").groupBy("root").agg(F.min("key").alias("kept")).select("kept")
    row, name = fresh(docs, "row"), fresh(docs, "kept")
    rows = docs.withColumn(row, F.expr(DOC_KEY)).join(stored(kept.withColumnRenamed("kept", name)), F.col(row) == F.col(name), "left_semi")
    return rows.dropDuplicates([row]).select(*[F.col(f"`{c}`") for c in docs.columns])
