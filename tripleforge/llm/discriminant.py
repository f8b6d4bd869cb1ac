"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text gives the statistics of FEATURES: shares under the arcsine root (which steadies the variance of a share
and keeps an absent thing at 0 for any length), means under a logarithm, the entropy of the bytes and the spread of word
lengths. Length itself is none, so that a clean text is not judged by it. They are rounded to 2^-GRID and stored once,
so texts are read once.

Each class has a mean and a covariance that shrinks by `alpha` to the pooled one and by `gamma` to the pooled diagonal.
Its Cholesky factor is computed once and kept in the model: a document's Mahalanobis distance is the squared norm of one
triangular solution, its log density half of that and of the factor's log determinant. The score is the logistic of
the difference of log densities, times a slope, plus the log ratio of the classes. alpha, gamma and the slope are those
of GRIDS with the least log loss on every fifth training document, for which the others give the moments; the last model
takes both.

Labels are learned from a bounded sample: of the distinct labelled doc_ids, those in training whose hash lies under the
threshold that leaves SAMPLE of them expected (all, where there are fewer); it is broadcast, so no document is shuffled.
Counts, sums and sums of products are integers and summed exactly, so the model does not depend on the order of rows.

Defined results: a null or empty text has statistics of 0 and a score like any other; a doc_id whose labels differ
counts as none; a null doc_id is never learned from; repeated rows are judged alike and each counts in the moments; with
one class missing (or no label) the densities cancel and the score is the smoothed share of class 1; an empty table gives
an empty result; extra columns are ignored. A text is read whole, as one value in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import repeat_words
from .util import stored

#: Labelled doc_ids to learn from (the documented bound), score from which a document is good, bits behind the point.
SAMPLE, GOOD, GRID = 200_000, 0.3, 16
#: Fixed values tried: shrinkage to the pooled covariance, to its diagonal, slope of the log densities.
GRIDS = ((0.02, 0.1, 0.3, 0.6, 0.9), (0.01, 0.1, 0.3), (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125))
FEATURES = ("word_chars", "markup", "calls", "capitals", "digits", "points", "not_ascii", "repeated_next", "in_repeated_windows", "seen_words", "commonest_word", "single_characters", "words_a_line", "repeated_lines", "entropy", "word_spread")
FIELDS = "doc_id long, held_out boolean, score double, predicted int, log_density_difference double"
_KINDS = (b"#*$%&|<>{}[]\\^~=_+@`/", b"!?", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".,;:'\"()-", b" \t\n\x0b\x0c\r", bytes(range(128, 256)))
_CLASSES = np.array([[float(b in kind) for kind in _KINDS] for b in range(256)])


def share(part: float, whole: float) -> float:
    return float(np.arcsin(np.sqrt(min(part / whole, 1.0)))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    held = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    markup, calls, upper, lower, digits, points, blank, high = held @ _CLASSES
    visible, letters, p = len(data) - blank, upper + lower + high, held[held > 0] / len(data)
    words = data.split()
    n, counts, sizes = len(words), Counter(words), np.fromiter(map(len, words), float, len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        float(np.log1p(visible / max(n, 1))), share(markup, visible), share(calls, visible), share(upper, letters), share(digits, visible), share(points, visible), share(high, visible),
        share(sum(map(eq, words, words[1:])), n), share(repeat_words(words), n), share(n - len(counts), n), share(max(counts.values(), default=0), n), share(int((sizes == 1).sum()), n),
        float(np.log1p(n / max(len(lines), 1))), share(len(lines) - len(set(lines)), len(lines)), float(-(p * np.log2(p)).sum()), float(sizes.std()) if n else 0.0,
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row in units of 2^-GRID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.round(np.ldexp(statistics(t), GRID)).astype(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<long>")


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, y, tries): distinct training doc_ids with their one label, about `most` at the most; tries marks those that choose the model."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(fold(5) != 0)
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y", (F.floor(fold(25) / 5) == 0).alias("tries"))
    # drawn within each class, so that a rare one is not thinned by the other
    share_of = {r.y: min(1.0, most / 2 / r.n) for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if all(v == 1.0 for v in share_of.values()):
        return marks
    at = F.pmod(F.xxhash64("doc_id", F.lit("discriminant")), F.lit(1 << 30)) / float(1 << 30)
    return marks.where(at < F.create_map(*[F.lit(v) for kv in share_of.items() for v in kv])[F.col("y")])


def _moments(learned: DataFrame, d: int) -> dict:
    """{(tries, y): (n, sums, sums of products)} as exact integers: summed in tasks, then as decimals."""
    m = d + d * (d + 1) // 2
    above = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.int64).reshape(-1, d)
            kind = np.array(b.column(1).to_pylist(), np.int64).reshape(-1)
            for k in np.unique(kind):
                z = x[kind == k]
                n, sums, squares = total.get(int(k), (0, np.zeros(d, object), np.zeros((d, d), object)))
                for at in range(0, len(z), 4096):  # products below 2^48, so 2^12 of them fit
                    part = z[at : at + 4096]
                    sums, squares = sums + part.sum(0), squares + part.T @ part
                total[int(k)] = (n + len(z), sums, squares)
        rows = [(k, i, str(v)) for k, (n, s, q) in total.items() for i, v in enumerate([n, *s, *q[above]])]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["k", "i", "v"])

    kinds = learned.select("x", (F.col("y") + 2 * F.col("tries").cast("int")).cast("long").alias("k"))
    got: dict = {}
    for r in kinds.mapInArrow(run, "k long, i long, v string").groupBy("k", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # 4 (1 + m) rows
        got.setdefault(r.k, [0] * (1 + m))[r.i] = int(r.v)
    out = {}
    for k in range(4):
        v = got.get(k, [0] * (1 + m))
        q = np.zeros((d, d), object)
        q[above] = v[1 + d :]
        out[bool(k // 2), k % 2] = (v[0], np.array(v[1 : 1 + d], object), q + np.triu(q, 1).T)
    return out


def _added(a, b):
    return tuple(x + y for x, y in zip(a, b))


class Discriminant:
    """Means, Cholesky factors and log determinants of both classes, with slope and log ratio."""

    def __init__(self, classes, alpha: float, gamma: float, slope: float):
        (n0, s0, q0), (n1, s1, q1) = classes
        self.alpha, self.gamma, self.slope, self.prior = alpha, gamma, slope, float(np.log((n1 + 1) / (n0 + 1)))
        self.parts = None
        if min(n0, n1) < 2:
            return
        # n * squares - sums^2 is exact; it is rounded once, by the division
        spread = [np.array((n * q - np.outer(s, s)) / (n * n << 2 * GRID), float) for n, s, q in classes]
        pooled = (n0 * spread[0] + n1 * spread[1]) / (n0 + n1)
        ridge = np.diag(np.diag(pooled) + 1e-9)
        self.parts = []
        for (n, s, _), own in zip(classes, spread):
            factor = np.linalg.cholesky((1 - gamma) * ((1 - alpha) * own + alpha * pooled) + gamma * ridge)
            self.parts.append((np.array(s / (n << GRID), float), factor, 2 * float(np.log(np.diag(factor)).sum())))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0 for rows of statistics."""
        if self.parts is None:
            return np.zeros(len(x))
        logs = []
        for mean, factor, log_det in self.parts:
            z = (x - mean).T.copy()
            for i in range(len(z)):  # forward substitution, row by row for all documents
                z[i] = (z[i] - factor[i, :i] @ z[:i]) / factor[i, i]
            logs.append(-0.5 * ((z * z).sum(0) + log_det))
        return logs[1] - logs[0]

    def logit(self, difference: np.ndarray) -> np.ndarray:
        return self.slope * difference + self.prior


def _chosen(tried: DataFrame, moments: dict, d: int) -> tuple[float, float, float]:
    """The point of GRIDS with the least log loss, summed in tasks in whole millionths."""
    alphas, gammas, slopes = GRIDS
    models = [Discriminant((moments[False, 0], moments[False, 1]), a, g, 1.0) for a, g in product(alphas, gammas)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros((len(models), len(slopes)), np.int64)
        for b in batches:
            x = np.ldexp(np.array(b.column(0).to_pylist(), float).reshape(-1, d), -GRID)
            side = 1.0 - 2.0 * np.array(b.column(1).to_pylist(), float).reshape(-1)
            for i, m in enumerate(models):
                diff = m.difference(x)
                for j, slope in enumerate(slopes):
                    loss[i, j] += np.round(np.minimum(np.logaddexp(0, side * (slope * diff + m.prior)), 1e6) * 1e6).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(loss.size), pa.int64()), pa.array(loss.ravel(), pa.int64())], names=["i", "loss"])

    rows = tried.select("x", "y").mapInArrow(run, "i long, loss long").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    best = min(rows, key=lambda r: (r.loss, r.i)).i if rows else 0
    return list(product(alphas, gammas, slopes))[best]


def fitted(rows: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Discriminant:
    """The model from described rows and labels(doc_id, quality)."""
    d = len(FEATURES)
    learned = rows.join(F.broadcast(sample(labels, most)), "doc_id")  # at most `most` doc_ids, but for the draw's spread
    learned = stored(learned.select("x", "y", "tries"))
    moments = _moments(learned, d)
    point = _chosen(learned.where("tries"), moments, d)
    return Discriminant([_added(moments[False, y], moments[True, y]) for y in (0, 1)], *point)


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """FIELDS for every row of docs(doc_id, text); labels(doc_id, quality) are read for training rows alone."""
    rows = stored(described(docs))
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, labels, most))  # two factors of len(FEATURES)^2
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            diff = m.difference(np.ldexp(np.array(b.column(1).to_pylist(), float).reshape(-1, d), -GRID))
            score = 0.5 * (1 + np.tanh(0.5 * m.logit(diff)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array((score >= GOOD).astype(np.int32), pa.int32()), pa.array(diff, pa.float64())], names=[f.split()[0] for f in FIELDS.split(", ")])

    return rows.select("doc_id", "x", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")).mapInArrow(run, FIELDS)
