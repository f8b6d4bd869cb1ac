"""Hard-negative mining by blocked dense products of anchors and candidates.

Components are taken as whole numbers floor(256 x). Anchors go out in blocks of about BLOCK rows, each a broadcast of
bounded size, against every candidate partition: a tile is one product of some anchors by a batch of candidates in
float64, which is exact while |a| |b| < 2^53 (Cauchy-Schwarz bounds every partial sum); tiles whose norms pass that are
multiplied as Python integers. The first pass keeps for each anchor the POSITIVES best rows of its label in the task;
such lists merge, so a shuffle of them alone takes the best of all tasks. The second pass gives every (anchor, positive)
its window of scores and keeps the NEGATIVES best rows of other labels inside it, merged alike. Nothing is sampled or
cut: a running last place only spares the rows that lie below it, and ties at it stay until ids decide.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component take no part; rows of one
vec_id are one row, that with the least label, then vector; missing components of shorter vectors count as 0; scores
beyond 64 bits are the nearest long; anchors without a positive, and positives without a negative, give no row; ties go
to the smaller vec_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import stored

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Anchors of one broadcast (expected), scores of one tile.
BLOCK, TILE = 16_384, 1 << 21
_LEAST, _MOST, _EXACT = -(1 << 63), (1 << 63) - 1, float(1 << 52)
FIELDS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with moved labels and whole components, one of each vec_id."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    # products of components beyond 1e300 pass 64 bits whatever they are exactly
    rows = rows.select("vec_id", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label"), F.expr("transform(v, x -> greatest(least(x * 256, 1e300D), -1e300D))").alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")


def _matrix(vectors) -> np.ndarray:
    """Vectors of whole components as rows, shorter ones filled with 0."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out)


def _of_batch(column: pa.ListArray) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == sizes[0]).all():
        return np.floor(column.flatten().to_numpy().reshape(len(sizes), -1))
    return _matrix(column.to_pylist())


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as exact longs, the nearest long beyond."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    with np.errstate(over="ignore", invalid="ignore"):
        norms = [float(np.sqrt((m * m).sum(1)).max(initial=0)) for m in (a, b)]
    if norms[0] * norms[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m] for m in (a, b))
    return np.array([[min(max(sum(x * y for x, y in zip(u, v)), _LEAST), _MOST) for v in right] for u in left], np.int64).reshape(len(left), len(right))


class Best:
    """For each slot the `most` best (score, id) offered so far: higher scores first, then smaller ids."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.last = np.full(slots, _LEAST)  # the score of a full slot's last place
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, least: np.ndarray | None = None) -> None:
        """A tile: scores[i, j] of slots[i] and ids[j] where allowed, from least[i] on."""
        bar = self.last[slots] if least is None else np.maximum(self.last[slots], least)
        ok = allowed & (scores >= bar[:, None])
        crowded = np.flatnonzero(ok.sum(1) > 4 * self.most)
        if len(crowded):  # at first no place is taken: the tile's own last place is the bar
            some = np.where(ok[crowded], scores[crowded], _LEAST)
            at = some.shape[1] - self.most
            ok[crowded] &= scores[crowded] >= np.partition(some, at, axis=1)[:, at, None]
        i, j = np.nonzero(ok)
        if not len(i):
            return
        slot, score, ident = np.concatenate([self.slot, slots[i]]), np.concatenate([self.score, scores[i, j]]), np.concatenate([self.id, ids[j]])
        order = np.lexsort((ident, ~score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        opens = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(opens, np.diff(np.r_[opens, len(slot)]))
        full, keep = place == self.most - 1, place < self.most
        self.last[slot[full]] = score[full]
        self.slot, self.score, self.id = slot[keep], score[keep], ident[keep]


def _pass(rows: DataFrame, members: list, windows: list | None) -> DataFrame:
    """A block of anchors over all rows: (slot, vec_id, score) of each task's best. A slot is an anchor, or with windows (anchor's place, low, high) a window."""
    ids, labels, matrix = np.array([r.vec_id for r in members], np.int64), np.array([r.label for r in members], np.int64), _matrix([r.v for r in members])
    bounds = None if windows is None else np.array(windows, np.int64).reshape(-1, 3)
    sent = rows.sparkSession.sparkContext.broadcast((ids, labels, matrix, bounds))  # about BLOCK rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix, bounds = sent.value
        best = Best(len(ids), POSITIVES) if bounds is None else Best(len(bounds), NEGATIVES)
        # windows are sorted by anchor: those of anchor i are first[i] to first[i + 1]
        first = None if bounds is None else np.searchsorted(bounds[:, 0], np.arange(len(ids) + 1))
        for b in batches:
            if not b.num_rows:
                continue
            cand, kind, vectors = b.column(0).to_numpy(), b.column(1).to_numpy(), _of_batch(b.column(2))
            step = max(1, TILE // len(cand))
            for at in range(0, len(ids), step):
                here = np.arange(at, min(at + step, len(ids)))
                scores = products(matrix[here], vectors)
                same = labels[here][:, None] == kind
                if bounds is None:
                    best.offer(here, scores, same & (ids[here][:, None] != cand), cand)
                    continue
                for k in range(int((first[here + 1] - first[here]).max(initial=0))):  # the k-th window of every anchor that has one
                    mine = np.flatnonzero(first[here] + k < first[here + 1])
                    slots = first[here[mine]] + k
                    best.offer(slots, scores[mine], ~same[mine] & (scores[mine] <= bounds[slots, 2][:, None]), cand, bounds[slots, 1])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (best.slot, best.id, best.score)], names=["slot", "vec_id", "score"])

    return rows.mapInArrow(run, "slot long, vec_id long, score long")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= most)


def _window(score: int) -> tuple[int, int]:
    """Least and greatest x with LOW * score <= 100 x <= HIGH * score."""
    return -(-LOW * score // 100), HIGH * score // 100


def mined(rows: DataFrame, every: int = 100, block: int = BLOCK) -> DataFrame:
    """FIELDS for the rows whose vec_id is divisible by `every`, against all of rows(vec_id, embedding, label)."""
    rows = stored(prepared(rows))
    spark = rows.sparkSession
    anchors = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-anchors.count() // block))
    out = []
    for n in range(blocks):
        members = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).orderBy("vec_id").collect()  # about `block` rows
        positives = _ranked(_pass(rows, members, None), POSITIVES).orderBy("slot", "rank").collect()  # POSITIVES a member at most
        if not positives:
            continue
        windows = [(p.slot, *_window(p.score)) for p in positives]
        known = spark.createDataFrame([(i, members[p.slot].vec_id, p.vec_id, p.score) for i, p in enumerate(positives)], "slot long, anchor_id long, positive_id long, positive_score long")
        found = _ranked(_pass(rows, members, windows), NEGATIVES).join(F.broadcast(known), "slot")
        out.append(stored(found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], FIELDS)
