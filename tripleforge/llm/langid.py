"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Each language has a model of order ORDER over the UTF-8 bytes of lower-cased words; a word is read between two blanks, so
contexts do not reach over words and a word's score can be kept. The highest order uses counts, lower orders
continuation counts, with one absolute discount for each order and language. For every byte string seen in any language
the interpolated log probabilities of all languages stand in one table of sorted hash keys; an unseen string takes its
suffix's values and its context's backoff weights. The language with the lowest cross-entropy for each byte wins.
`score` is the calibrated posterior of that choice: the softmax of the total differences times a slope fitted on
training documents that the counts did not see. `rejected` marks a choice under the score that fits REJECT.

The models are fitted on a bounded sample: for each language, different documents in hash order up to SAMPLE_BYTES of
text (the documented bound), of each its first SAMPLE_BYTES / SHARES at most, so that no long one takes the place of all
others and every language with a training row is learned; of each language's documents with a letter every fifth fits
the slope, the others the counts. Everything else is done for every row, on whole texts.

Defined results: a null text or one without a letter gives "und" and score 0; no training row gives "und" for all;
repeated rows are judged alike; ties go to the first language by code point; an empty table gives an empty result; extra
columns are ignored; a very long text is scored whole, as one Python object of its task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import stored

ORDER, SAMPLE_BYTES, SHARES, REJECT, CACHE, BROADCAST_ROWS = 5, 1_500_000, 16, 0.6, 300_000, 500_000
FIELDS = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


_ASCII = bytes(c if c < 128 and chr(c).isalpha() else 32 for c in range(256))
_GAPS = re.compile(r"[\W\d_]+").sub


def cut(text: str) -> list[bytes]:
    """Words: runs of letters, in lower case; none where the text has no letter."""
    if text.isascii():
        return text.lower().encode().translate(_ASCII).split()
    if not any(map(str.isalpha, text)):
        return []
    return _GAPS(" ", text.lower()).encode("utf-8", "surrogatepass").split()


def keys_of(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the words and their closing blank, the strings of 1..order bytes that end there as numbers (0 where too short); the owner of each byte."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    start = np.zeros(len(data), np.int64)
    blank = np.flatnonzero(data == 32)
    start[blank] = 1
    owner = np.cumsum(start) - 1  # the blank before a word opens it
    place = np.arange(len(data)) - blank[owner]  # bytes since the opening blank
    here = np.arange(1, len(data))
    closing = data[here] == 32
    since = np.where(closing, np.arange(len(data))[here] - blank[owner[here] - 1], place[here])
    out = np.zeros((order, len(here)), np.uint64)
    value = np.zeros(len(here), np.uint64)
    for n in range(order):
        far = here - n
        ok = (since >= n) & (far >= 0)
        value = np.where(ok, value | (data[np.maximum(far, 0)] << np.uint64(8 * n)), value)
        out[n] = np.where(ok, value | (np.uint64(n + 1) << np.uint64(56)), 0)
    return out, np.where(closing, owner[here] - 1, owner[here])


class KneserNey:
    """levels[n]: sorted keys of n+1 bytes, log probabilities [keys, languages], log backoff weights of the key as a context."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        L = len(self.langs)
        self.levels: list = []
        if not L:
            return
        counts: list[dict] = []
        for lang in self.langs:
            words = Counter(samples[lang])
            kinds, times = list(words), np.array(list(words.values()), float)
            keys, owner = keys_of(kinds, order) if kinds else (np.zeros((order, 0), np.uint64), np.zeros(0, np.int64))
            level = [None] * order
            top = keys[order - 1] > 0
            level[order - 1] = _summed(keys[order - 1][top], times[owner[top]])
            for n in range(order - 2, -1, -1):
                longer = level[n + 1][0]
                ended = np.unique(longer)  # continuation counts: different bytes before the string
                cont = (ended & np.uint64((1 << (8 * (n + 1))) - 1)) | (np.uint64(n + 1) << np.uint64(56))
                # strings that open a word have nothing before them: they count as they come
                opens = (keys[n] > 0) & ((keys[n + 1] == 0) if n + 1 < order else True)
                level[n] = _summed(np.concatenate([cont, keys[n][opens]]), np.concatenate([np.ones(len(cont)), times[owner[opens]]]))
            counts.append(level)
        below = np.full((1, L), 1 / 256.0)
        for n in range(order):
            every = np.unique(np.concatenate([c[n][0] for c in counts]))
            full = np.zeros((len(every), L))
            for i, c in enumerate(counts):
                full[np.searchsorted(every, c[n][0]), i] = c[n][1]
            context, where = np.unique(self._context(every, n), return_inverse=True)
            total, kinds = np.zeros((len(context), L)), np.zeros((len(context), L))
            np.add.at(total, where, full)
            np.add.at(kinds, where, full > 0)
            n1, n2 = (full == 1).sum(0), (full == 2).sum(0)
            d = np.clip(n1 / np.maximum(n1 + 2.0 * n2, 1), 0.1, 0.9)
            gamma = np.where(total > 0, d * kinds / np.maximum(total, 1e-300), 1.0)
            if n:
                low = self._lookup(n - 1, (every & np.uint64((1 << (8 * n)) - 1)) | (np.uint64(n) << np.uint64(56)), below)
            else:
                low = np.broadcast_to(below, full.shape)
            p = np.maximum(full - d, 0) / np.maximum(total, 1e-300)[where] + gamma[where] * low
            self.levels.append((every, np.log2(p).astype(np.float32), context, np.log2(gamma).astype(np.float32)))
            below = p

    def _context(self, keys: np.ndarray, n: int) -> np.ndarray:
        """The string without its last byte, which is the lowest one."""
        return ((keys & np.uint64((1 << (8 * (n + 1))) - 1)) >> np.uint64(8)) | (np.uint64(n) << np.uint64(56))

    def _lookup(self, n: int, keys: np.ndarray, probs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.levels[n][0], keys), len(probs) - 1)
        return np.where((self.levels[n][0][at] == keys)[:, None], probs[at], np.exp2(self._log(n, keys)))

    def _log(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Log probabilities [keys, languages] of strings of n+1 bytes."""
        every, logs, context, gamma = self.levels[n]
        out = np.empty((len(keys), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(every, keys), max(len(every) - 1, 0))
        hit = every[at] == keys if len(every) else np.zeros(len(keys), bool)
        out[hit] = logs[at[hit]]
        miss = ~hit
        if miss.any():
            k = keys[miss]
            c = self._context(k, n)
            ca = np.minimum(np.searchsorted(context, c), max(len(context) - 1, 0))
            g = np.where((context[ca] == c)[:, None], gamma[ca], np.float32(0)) if len(context) else np.zeros((len(k), len(self.langs)), np.float32)
            low = self._log(n - 1, (k & np.uint64((1 << (8 * n)) - 1)) | (np.uint64(n) << np.uint64(56))) if n else np.float32(-8.0)
            out[miss] = g + low
        return out

    def words(self, kinds: list[bytes]) -> np.ndarray:
        """Log2 probabilities [words, languages]."""
        keys, owner = keys_of(kinds, self.order)
        out = np.zeros((len(kinds), len(self.langs)))
        length = (keys > 0).sum(0)
        for n in range(1, self.order + 1):
            here = length == n
            if here.any():
                np.add.at(out, owner[here], self._log(n - 1, keys[n - 1][here]).astype(float))
        return out


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every, where = np.unique(keys, return_inverse=True)
    return every, np.bincount(where, times, len(every))


class Judge:
    """A model with its slope, and a cache of word scores."""

    def __init__(self, model: KneserNey, slope: float, reject: float):
        self.model, self.slope, self.reject = model, slope, reject
        self.cache: dict[bytes, np.ndarray] = {}

    def totals(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """For each text the summed log2 probabilities by language and the number of bytes; None without a letter."""
        if not self.model.langs:
            return [None] * len(texts)
        bags = [Counter(cut(t)) if t else Counter() for t in texts]
        new = [w for w in dict.fromkeys(w for b in bags for w in b) if w not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(dict.fromkeys(w for b in bags for w in b))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.cache.update(zip(part, self.model.words(part)))
        out = []
        for b in bags:
            if not b:
                out.append(None)
                continue
            times = np.array(list(b.values()), float)
            out.append((times @ np.array([self.cache[w] for w in b]), int(sum(n * (len(w) + 1) for w, n in b.items()))))
        return out

    def __call__(self, text_totals) -> tuple[str, float, float | None, bool]:
        if text_totals is None or not self.model.langs:
            return "und", 0.0, None, True
        total, size = text_totals
        best = int(np.argmax(total))
        score = float(1 / np.exp2((total - total[best]) * self.slope).sum())
        return self.model.langs[best], score, float(-total[best] / size), score < self.reject


def sample(docs: DataFrame, n_bytes: int = SAMPLE_BYTES) -> list:
    """Rows (lang, text) of the training sample: for each language different documents with a letter in hash order, each cut to its share, while the running size starts within the bound."""
    known = docs.where(F.col("text").rlike(r"\p{L}")).where("lang IS NOT NULL AND coalesce(crc32(CAST(doc_id AS STRING)) % 4, 0) <> 2")
    known = known.select("lang", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text", F.lit("langid")).alias("h"))
    most = max(n_bytes // SHARES, 1)
    sizes = known.groupBy("lang", "h").agg(F.least(F.max(F.octet_length("text")), F.lit(most)).cast("long").alias("size"))  # repeated rows once
    # hash order by ranges of the hash: a first cut by a threshold from the totals keeps the window small. Shares being
    # capped, at least 4 * SHARES documents are expected under it.
    totals = sizes.groupBy("lang").agg(F.sum("size").alias("total"))
    cut_at = totals.select("lang", F.least(F.lit(1.0), 4.0 * n_bytes / F.greatest(F.col("total"), F.lit(1))).alias("part"))
    few = sizes.join(cut_at, "lang").where((F.col("part") >= 1) | ((F.col("h") / float(1 << 63)) < 2 * F.col("part") - 1))
    order = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = few.withColumn("before", F.sum("size").over(order) - F.col("size")).where(F.col("before") < n_bytes)
    few = stored(few.select("lang", "h", F.least(F.col("size"), F.lit(n_bytes) - F.col("before")).cast("int").alias("take")))
    small = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few  # else the texts are dealt by language and hash
    rows = known.join(small, ["lang", "h"]).select("lang", "h", F.expr("CAST(substring(text, 1, take) AS STRING)").alias("text"))
    return rows.dropDuplicates(["lang", "h"]).orderBy("lang", "h").select("lang", "text").collect()


def fitted(rows: list, order: int = ORDER, reject: float = REJECT) -> Judge:
    """A judge from (lang, text) rows; every fifth row of a language, of those with a letter, fits the slope."""
    counted: dict[str, list[bytes]] = {}
    held = []
    seen_of: Counter = Counter()
    for r in rows:
        words = cut(r[1])
        if not words:
            continue
        seen_of[r[0]] += 1
        if seen_of[r[0]] % 5 == 0:
            held.append(r)
        else:
            counted.setdefault(r[0], []).extend(words)
    judge = Judge(KneserNey(counted, order), 1.0, reject)
    if held and len(judge.model.langs) > 1:
        seen = [(t, judge.model.langs.index(r[0])) for r, t in zip(held, judge.totals([r[1] for r in held])) if t is not None and r[0] in judge.model.langs]
        if seen:
            gaps = np.array([t[0] - t[0].max() for t, _ in seen])
            true = np.array([k for _, k in seen])

            def loss(s: float) -> float:
                z = gaps * s
                return float(-(z[np.arange(len(true)), true] - np.log2(np.exp2(z).sum(1))).mean())

            judge.slope = min((2.0 ** -k for k in range(0, 11)), key=loss)
    judge.cache.clear()
    return judge


def identified(docs: DataFrame, order: int = ORDER, n_bytes: int = SAMPLE_BYTES, reject: float = REJECT) -> DataFrame:
    """FIELDS for every row of docs(doc_id, text, lang); lang is read for training rows alone."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(sample(docs, n_bytes), order, reject))  # bounded by n_bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        for b in batches:
            ids, out = b.column(0), []
            texts, held = b.column(1).to_pylist(), b.column(2)
            for at in range(0, len(texts), 256):
                out += [judge(t) for t in judge.totals(texts[at : at + 256])]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([ids, held, *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]], names=[f.split()[0] for f in FIELDS.split(", ")])

    held = F.expr("coalesce(crc32(CAST(doc_id AS STRING)) % 4, 0) = 2")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")).mapInArrow(run, FIELDS)
