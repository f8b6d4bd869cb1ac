"""LM scoring: a hierarchical Pitman-Yor model of words after a word.

A token is drawn in the restaurant of the word before it (the end of a text for the first word). Every word has a
restaurant of its own; their common parent is the root restaurant. (A caller may ask for `share`: then the tokens after
words under 1 / share of the training tokens sit directly in the root.) A new table of the root draws its word's spelling from byte
restaurants: contexts of up to ORDER - 1 bytes, the parent of each being the context without its first byte, down to the
uniform distribution. A blank closes a word; the end of a text is the empty word. So every string of bytes has a
probability, an unseen word that of its spelling, and a text's score is log10 of the product over its tokens.

Seatings are sampled by Gibbs: a dish's customers in a restaurant all leave and sit down again at once, the number of
their tables being drawn from its exact conditional distribution (generalised Stirling numbers times the odds of each
new table; beyond EXACT customers by the saddle point of the same distribution, some two tables off where few tables
are expected and the discount is near one), given the tables of all other dishes.
Words are dealt to groups by a hash, and a group is one row of packed arrays: its words as dishes, with their customers
in the restaurants of frequent contexts (1 / SHARE of the training tokens, so SHARE words at most), and the restaurants of
its own rarer words. Of the latter only dishes with two customers or more are drawn (one customer has one table): a sweep
sends them the root's probabilities of their dishes, the next one draws by these, and the one after takes the tables into
the root. What tasks share are the frequent restaurants' table totals of the sweep before, the byte restaurants and a few
sums. The totals of a sweep's own changes are thus seen by the next one. After BURN sweeps the predictive probabilities of
KEPT sweeps are averaged; in the first of them the root still has one table for each dish of the rarer words' restaurants.
Discounts are n1 / (n1 + 2 n2) of a level's customers (frequent contexts, rarer ones, root); strengths are those that make
the tables of the sweep before likeliest, on a grid for the rarer words (STRENGTH in the byte restaurants); draws depend on
the word, its context, the sweep and the seed alone.

Texts are cut into words once: a chunk of documents becomes its distinct words and the numbers of its tokens, and later
passes read chunks. A chunk sends each group its words there and their different pairs, and after the sweeps gets back, in
the same order, what scores them; so nothing is looked up outside it and no table of words goes through the driver. Rows
of chunks and groups, and of groups and groups, are as many as the product of their numbers, each in proportion to the
tokens. Two words of one hash fall into one group, where they are seen: then all are dealt again by another hash.

Defined results: a null text is empty: one token, the end. A document whose crc32 of doc_id mod 10 is 0 is held out; a
null doc_id counts as training. Repeated rows count and are scored as often as they come. Without training tokens all
counts are 0, base_score uses N = V = 0 and score is the spelling's alone. Ties of counts do not matter. An empty table gives an empty result; extra columns are ignored.
A very long text is read and scored whole: it is a chunk of its own in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util
from .util import discard

ORDER, STRENGTH, BURN, KEPT, EXACT = 3, 5.0, 1, 2, 200
SHARE, CANDIDATES = 4096, 1 << 18
CHUNK_TOKENS, CHUNK_WORDS = 2_000_000, 300_000
#: Training tokens of a group of words, on average.
GROUP = 1 << 21
#: Groups of a small table; tasks that add up totals; rounds of scoring, each with a share of the chunks.
LEAST, TOTALS, ROUNDS = 8, 16, 2
#: Tokens that are added up at once when a chunk is scored.
SLICE = 1 << 17
END = b""
#: Context number of words without a number: rarer ones, or those whose tokens sit in the root restaurant.
ROOT = 65535
HELD = "coalesce(crc32(CAST(doc_id AS STRING)) % 10, 1) = 0"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written and read back; the shuffle files of the write are deleted."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return util.stored(df)
    finally:
        spark.conf.set(_CLEANUP, before)


# --- the restaurants ---


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S[c, t]: weight of all ways to seat c customers of a dish at t tables, for c up to `most`."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], np.log(np.maximum(c - d * t, 1e-300)) + s[c, 1 : c + 2])
    return s


def uniforms(*parts) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for each row of integer parts: a hash, so that they do not depend on what stands beside the row."""
    with np.errstate(over="ignore"):
        x = np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(32)) + np.float64(0.5)) / 2**32, ((x & np.uint64(0xFFFFFFFF)) + np.float64(0.5)) / 2**32


def draw(c: np.ndarray, others: np.ndarray, base: np.ndarray, d: float, ways: np.ndarray, u: np.ndarray, v: np.ndarray, theta: float = STRENGTH) -> np.ndarray:
    """Tables of dishes with c customers: P(t) ~ S[c, t] * product over i < t of (theta + d * (others + i)) * base.

    others: the restaurant's tables of other dishes; base: the parent's probability of the dish; u, v: uniform numbers.
    """
    t = np.minimum(c, 1).astype(np.float64)
    base = np.maximum(base, 1e-300)
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few], kind="stable")]
    cuts = np.flatnonzero(np.diff(c[few])) + 1
    for group in np.split(few, cuts):
        n = int(c[group[0]]) if len(group) else 1
        for at in np.split(group, range(2_000_000 // n, len(group), 2_000_000 // n)):
            p = ways[n, 1 : n + 1] + np.cumsum(np.log((theta + d * (others[at, None] + np.arange(n))) * base[at, None]), 1)
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
            t[at] = 1 + (p[:, :-1] < (u[at] * p[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        n, o, b = c[many].astype(np.float64), others[many], base[many]

        def curve(x):  # x: log of the saddle point's distance from one; with its tables, and log of the saddle's width
            part = -np.expm1(d * x)
            tables = n * part * np.exp((1 - d) * x) / (d * -np.expm1(x))
            return tables, part, np.log(np.maximum(1 + (1 - d) * np.expm1(-x) - n / np.maximum(tables, 1e-300), 1e-12))

        def slope(x):  # of log P by the number of tables
            tables, part, _ = curve(x)
            (ta, _, wa), (tb, _, wb) = curve(x * 1.001), curve(x * 0.999)
            width = (wb - wa) / np.maximum(tb - ta, 1e-12) / 2
            return np.log(part / d) - np.log(tables + 0.5) + np.log((theta + d * (o + tables)) * b) - np.where(tables > 1, width, 0.0)

        low, high = np.full(len(n), -300.0), np.full(len(n), -1e-9)
        for _ in range(60):
            mid = (low + high) / 2
            up = slope(mid) > 0
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        spread = np.sqrt(np.maximum((curve(mid * 0.99)[0] - curve(mid * 1.01)[0]) / np.maximum(slope(mid * 1.01) - slope(mid * 0.99), 1e-12), 0))
        t[many] = np.clip(np.rint(curve(mid)[0] + 0.5 + spread * np.sqrt(-2 * np.log(u[many])) * np.cos(2 * np.pi * v[many])), 1, n)
    return t


def discount(n1: float, n2: float) -> float:
    return min(max(n1 / max(n1 + 2 * n2, 1), 0.05), 0.95)


def strength(c: np.ndarray, t: np.ndarray, d: float) -> float:
    """The strength under which seatings of c customers at t tables in each of a level's restaurants are likeliest, from 0.1 to 10 ** 7; STRENGTH where no restaurant says anything."""
    c, t = (x[c > 1].astype(np.float64) for x in (c, t))
    if not len(c):
        return STRENGTH
    gammas = lambda x: float(sum(map(lgamma, x.tolist())))

    def fit(x: float) -> float:
        theta = exp(x)
        return gammas(theta / d + t) - len(t) * lgamma(theta / d + 1) - gammas(theta + c) + len(c) * lgamma(theta + 1)

    low, high = log(0.1), log(1e7)
    for _ in range(40):  # golden section: one maximum
        a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
        low, high = (a, high) if fit(a) < fit(b) else (low, b)
    return exp((low + high) / 2)


class ByteModel:
    """Byte restaurants of contexts of 0 .. ORDER-1 bytes. Strings are numbers of their bytes; sorted arrays by length, of 256 ** ORDER strings at most."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sweep: int, before: ByteModel | None = None, order: int = ORDER, theta: float = STRENGTH):
        self.order, self.theta = order, theta
        self.levels: list = [None] * order
        keys, counts = keys.astype(np.uint64), counts.astype(np.float64)
        for n in range(order - 1, -1, -1):  # strings of n+1 bytes
            short = keys & np.uint64((1 << (8 * n)) - 1)
            context, where = np.unique(keys >> np.uint64(8), return_inverse=True)
            base = before.probability(short, n) if before and n else np.full(len(keys), 1 / 256.0)
            old = before.tables(keys, n) if before else np.ones(len(keys))
            total = np.bincount(where, old, len(context))[where] if len(keys) else old
            d = discount((counts == 1).sum(), (counts == 2).sum())
            t = draw(counts, np.maximum(total - old, 0), base, d, stirling(d), *uniforms(np.uint64(sweep), np.uint64(n), keys), theta)
            self.levels[n] = (keys, counts, t, context, np.bincount(where, counts, len(context)), np.bincount(where, t, len(context)), d)
            if n:  # the tables are the parent's customers
                keys, back = np.unique(short, return_inverse=True)
                counts = np.bincount(back, t, len(keys))

    def tables(self, keys: np.ndarray, n: int) -> np.ndarray:
        every, _, t = self.levels[n][:3]
        if not len(every):
            return np.ones(len(keys))
        at = np.minimum(np.searchsorted(every, keys), len(every) - 1)
        return np.where(every[at] == keys, t[at], 1.0)

    def probability(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Predictive probabilities of the last bytes of strings of `length` bytes, given those before."""
        p = np.full(len(keys), 1 / 256.0)
        for n in range(length):
            k = keys & np.uint64((1 << (8 * (n + 1))) - 1)
            every, c, t, context, cu, tu, d = self.levels[n]
            if not len(every):
                continue
            ca = np.minimum(np.searchsorted(context, k >> np.uint64(8)), len(context) - 1)
            known = context[ca] == k >> np.uint64(8)
            at = np.minimum(np.searchsorted(every, k), len(every) - 1)
            own = np.where(every[at] == k, c[at] - d * t[at], 0.0)
            p = np.where(known, (np.maximum(own, 0) + (self.theta + d * tu[ca]) * p) / (self.theta + cu[ca]), p)
        return p


def spelled(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words and their closing blanks the string of the `order` bytes that end there (blanks before the word), and the word's place."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = b" " * (order - 1)
    data = np.frombuffer(b"".join([pad + w + b" " for w in words]), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.arange(len(owner)) + (owner + 1) * (order - 1)
    keys = np.zeros(len(owner), np.uint64)
    for i in range(order):
        keys |= data[ends - i] << np.uint64(8 * i)
    return keys, owner


def spelling(words: list[bytes], model: ByteModel | None) -> np.ndarray:
    """Each word's spelling probability."""
    keys, owner = spelled(words, model.order if model else ORDER)
    if model:
        every, back = np.unique(keys, return_inverse=True)
        logs = np.log(np.maximum(model.probability(every, model.order), 1e-300))[back]
    else:
        logs = np.full(len(keys), -np.log(256.0))
    return np.exp(np.maximum(np.bincount(owner, logs, len(words)), -690.0))


# --- chunks of documents ---


class _Numbers(dict):
    """Numbers of words in the order of their first coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunked(docs: DataFrame) -> DataFrame:
    """A row for each chunk of documents: its number, its distinct words (joined by blanks) with their training counts, and of its documents doc_id, held, size and token numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        numbers, rows, size = _Numbers(), [], 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate([r[2] for r in rows])
            sizes = np.array([len(r[2]) for r in rows], np.int32)
            counts = np.bincount(tokens[np.repeat(np.array([not r[1] for r in rows]), sizes)], minlength=len(numbers)).astype("<u4")
            cols = [[(task << 32) | made], [b" ".join(numbers)], [counts.tobytes()], [int(counts.sum(dtype=np.int64))], [[r[0] for r in rows]], [[r[1] for r in rows]], [sizes.tobytes()], [_packed(tokens.astype("<u4"))]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["chunk", "words", "counts", "n", "ids", "held", "sizes", "tokens"])

        for b in batches:
            for doc_id, text, held in zip(*(c.to_pylist() for c in b.columns)):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower changes A-Z alone, bytes.split cuts at ASCII white space
                words.append(END)
                rows.append((doc_id, held, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))))
                size += len(words)
                if size >= CHUNK_TOKENS or len(numbers) >= CHUNK_WORDS:
                    yield out()
                    made += 1
                    numbers.clear()
                    rows, size = [], 0
        if rows:
            yield out()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr(HELD).alias("held"))
    return docs.mapInArrow(run, "chunk long, words binary, counts binary, n long, ids array<long>, held array<boolean>, sizes binary, tokens binary")


def _each(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch; arrays of numbers from binary columns, words split."""
    for r in range(b.num_rows):
        yield tuple(b.column(i)[r].as_py() for i in range(b.num_columns))


def contexts(chunks: DataFrame, N: int, share: int) -> list[bytes]:
    """Words with 1 / share of the N training tokens, by their exact counts: each holds that share of some chunk, so only those are counted."""

    def reported(batches: Iterator[pa.RecordBatch], known=None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, counts, n in _each(b):
                words, counts = np.array(words.split(b" "), object), np.frombuffer(counts, "<u4").astype(np.int64)
                own = np.flatnonzero((counts * share >= n) & (counts > 0)) if known is None else np.fromiter((i for i, w in enumerate(words) if w in known), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words[own], pa.binary()), pa.array(counts[own])], names=["word", "c"])

    table = chunks.select("words", "counts", "n")
    some = stored(table.mapInArrow(reported, "word binary, c long").select("word").distinct())
    if some.count() <= CANDIDATES:
        known = chunks.sparkSession.sparkContext.broadcast(frozenset(bytes(r.word) for r in some.collect()))
        every = table.mapInArrow(lambda batches: reported(batches, known.value), "word binary, c long")
    else:

        def all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for words, counts, _ in _each(b):
                    yield pa.RecordBatch.from_arrays([pa.array(words.split(b" "), pa.binary()), pa.array(np.frombuffer(counts, "<u4").astype(np.int64))], names=["word", "c"])

        every = table.mapInArrow(all_words, "word binary, c long").join(some, "word", "left_semi")
    rows = every.groupBy("word").agg(F.sum("c").alias("c")).where(F.col("c") * share >= N).select("word").collect()  # share words at most
    discard(some)
    return sorted(bytes(r.word) for r in rows)


_PAIR = np.dtype([("u", "<u2"), ("n", "<u4")])


def _blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of data up to each end (in items)."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def _before(tokens: np.ndarray, end: int) -> np.ndarray:
    """The token before each; every document closes with the end, which so stands before the next one's first word."""
    return np.concatenate([[end], tokens[:-1]])


def _context_of(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((known.get(w, ROOT) for w in words), np.int64, len(words))


# --- groups of words ---


#: A row's group (of words, or the chunk it goes to), what it is, where it comes from, its arrays (pickled).
_ROW = "g long, kind int, src long, data binary"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]
#: Kinds of rows: a group's state, tables (first: customers) of dishes in other groups' restaurants, the root's probabilities for such restaurants, places of the chunks' words and pairs in the group's; of the last state the words and their contexts, totals of a task.
_STATE, _TABLES, _ODDS, _PLACES, _WORDS, _TOTALS = range(6)
#: Kinds of totals: context customers, context tables, root's (customers, tables, tokens, words), strings, customers by number (1 and 2 of pairs, of the root, of pairs after rarer words), likelihood of strengths of rarer words, words of equal hash.
_C, _T, _ROOT, _STRINGS, _FEW, _LIKELY, _SAME = range(7)
_RARE = 1 << 62


def _packed(data) -> bytes:
    raw = pickle.dumps(data, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes):
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of g, kind, src and arrays."""
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([_packed(r[3]) for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from zero on in few bytes."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as their steps: np.cumsum gives them back."""
    return _small(np.diff(x, prepend=0))


def _whole(m: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Numbers from their halves (frexp); 4-byte numbers end at 1e-38."""
    return np.ldexp(m.astype(float), e)


def _split(joined: bytes, n: int) -> list[bytes]:
    return joined.split(b" ") if n else []


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and each one's place among them."""
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=-1) != 0
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return keys[order][new], at


def hashes(words: list[bytes], salt: int) -> np.ndarray:
    """64-bit SipHash of words."""
    return hash_array(np.fromiter(words, object, len(words)), hash_key=f"{salt:016d}", categorize=False)


def by_group(df: DataFrame, first: str = "g") -> DataFrame:
    return df.repartition(first).sortWithinPartitions(first, "kind", "src")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """g and its rows' kinds, sources and arrays, of rows that stand together."""
    now, rows = None, []
    for b in batches:
        for r, (g, kind, src) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
            data = b.column(3)[r].as_py()
            if g != now and rows:
                yield now, rows
                rows = []
            now = g
            rows.append((kind, src, _unpacked(data)))
    if rows:
        yield now, rows


class Dealing:
    """How words are dealt: contexts in the words' own rows, number of groups, whether all other words have restaurants, salt of the hash."""

    def __init__(self, known: dict[bytes, int], groups: int, whole: bool, salt: int):
        self.known, self.groups, self.whole, self.salt = known, groups, whole, salt


class Dealt:
    """A chunk's words in the order of their groups, and its different pairs of a context and a word: those of frequent contexts by word, then those of rarer ones by context."""

    def __init__(self, words: list[bytes], tokens: np.ndarray, how: Dealing):
        h = hashes(words, how.salt)
        g = (h % np.uint64(how.groups)).astype(np.int64)
        order = np.lexsort((h, g))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.h, self.cuts = [words[i] for i in order], h[order], np.searchsorted(g[order], np.arange(how.groups + 1))
        context = _context_of(self.words, how.known)
        self.tokens = place[tokens]
        before = _before(self.tokens, int(place[words.index(END)]))
        keys = (self.tokens << 16) | context[before]
        if how.whole:
            rare = np.flatnonzero(context[before] == ROOT)
            keys[rare] = _RARE | (before[rare] << 31) | self.tokens[rare]
        keys, self.at = _unique(keys)
        cut = int(np.searchsorted(keys, _RARE))
        self.w, self.u = keys[:cut] >> 16, keys[:cut] & ROOT
        self.rare_u, self.rare_w = (keys[cut:] ^ _RARE) >> 31, keys[cut:] & ((1 << 31) - 1)

    def parts(self) -> Iterator[tuple[int, slice, slice, slice]]:
        """Groups that have words: their words, pairs of frequent contexts and of rarer ones."""
        f, r = np.searchsorted(self.w, self.cuts), np.searchsorted(self.rare_u, self.cuts)
        for g in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield g, slice(self.cuts[g], self.cuts[g + 1]), slice(f[g], f[g + 1]), slice(r[g], r[g + 1])


def dealt(chunks: DataFrame, how: Dealing) -> DataFrame:
    """A row for each chunk and group: words with their training counts and pairs."""
    shared = chunks.sparkSession.sparkContext.broadcast(how)  # SHARE words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words, held, sizes, tokens in _each(b):
                d = Dealt(words.split(b" "), _unpacked(tokens).astype(np.int64), shared.value)
                train = np.repeat(~np.array(held), np.frombuffer(sizes, "<i4"))
                c, n = np.bincount(d.tokens[train], minlength=len(d.words)), np.bincount(d.at[train], minlength=len(d.w) + len(d.rare_w))
                rows = []
                for g, w, f, r in d.parts():
                    k, rn = w.stop - w.start, slice(len(d.w) + r.start, len(d.w) + r.stop)
                    counts = [_small(np.bincount(x - w.start, minlength=k)) for x in (d.w[f], d.rare_u[r])]
                    dishes, dish = _unique(d.rare_w[r])
                    rows.append((g, _PLACES, chunk, (b" ".join(d.words[w]), k, _small(c[w]), counts[0], d.u[f].astype(np.uint16), _small(n[f]), counts[1], d.h[dishes], _small(n[rn]), _small(dish))))
                yield _rows(rows)

    return chunks.select("chunk", "words", "held", "sizes", "tokens").mapInArrow(run, _ROW)


def gathered(parts: DataFrame, how: Dealing) -> DataFrame:
    """Of each group: its words, pairs and restaurants as the first state; where the chunks' words and pairs are found there; and for other groups the dishes of its restaurants with two customers or more."""
    groups, salt = how.groups, how.salt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, same = None, 0
        for g, rows in _groups(batches):
            numbers = _Numbers()
            at = [np.fromiter(map(numbers.__getitem__, _split(r[0], r[1])), np.int64, r[1]) for *_, r in rows]
            words, k = list(numbers), len(numbers)
            h = hashes(words, salt)
            order = np.argsort(h)  # as the chunks' words are
            h, words, rank = h[order], [words[i] for i in order], np.empty(k, np.int64)
            rank[order] = np.arange(k)
            at = [rank[a] for a in at]
            total = lambda where, i, n: np.bincount(where, np.concatenate([r[i] for *_, r in rows]).astype(float), n).astype(np.int64)  # noqa: E731, B023
            c = total(np.concatenate(at), 2, k)
            keys, place = _unique(np.concatenate([(np.repeat(a, r[3]) << 16) | r[4] for a, (*_, r) in zip(at, rows)]))
            fn = total(place, 5, len(keys))
            dishes = np.unique(np.concatenate([r[7] for *_, r in rows]))
            order = np.lexsort((dishes, dishes % np.uint64(groups)))
            rank = np.empty(len(dishes), np.int64)
            rank[order] = np.arange(len(dishes))
            dish = np.concatenate([rank[np.searchsorted(dishes, r[7])][r[9]] for *_, r in rows])
            dishes = dishes[order]
            rare, rare_place = _unique((np.concatenate([np.repeat(a, r[6]) for a, (*_, r) in zip(at, rows)]) << 32) | dish)
            rn, ru, rw = total(rare_place, 8, len(rare)), rare >> 32, dishes[rare & 0xFFFFFFFF]
            ends = [np.cumsum([len(r[i]) for *_, r in rows])[:-1] for i in (4, 9)]
            some = np.flatnonzero(rn > 1)
            to = (rw[some] % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((rw[some], h[ru[some]], to))  # whatever the chunks
            some, to = some[order], to[order]
            dests, first = np.unique(to, return_index=True)
            cuts = np.append(first, len(some))
            with np.errstate(over="ignore"):
                seed = ((h[ru[some]] * np.uint64(3) + rw[some]) >> np.uint64(32)).astype(np.uint32)
            state = {"words": b" ".join(words), "k": k, "c": c, "fw": _small(keys >> 16), "fu": (keys & ROOT).astype(np.uint16), "fn": _small(fn), "ru": _small(ru[some]), "rn": _small(rn[some]), "seed": seed, "to": dests, "cuts": cuts}
            state |= {"cu": _small(np.bincount(ru, rn, k).astype(np.int64)), "ones": _small(np.bincount(ru[rn == 1], minlength=k))}
            places = ([r[1] for r in rows], [_steps(a) for a in at], [_steps(x) for x in np.split(place, ends[0])], [_steps(x) for x in np.split(rare_place, ends[1])], _steps(ru), _small(np.minimum(rn, 2)), _small(some))
            yield _rows([(g, _STATE, -1, state), (g, _PLACES, -1, places)])
            yield _rows([(int(d), _TABLES, g, (rw[some[cuts[i] : cuts[i + 1]]], _small(rn[some[cuts[i] : cuts[i + 1]]]))) for i, d in enumerate(dests)])
            same += k - len(np.unique(h))
        if numbers is not None:
            yield _totals({_SAME: (np.zeros(1, np.int64), np.array([same]))})

    return by_group(parts).select("g", "kind", "src", "data").mapInArrow(run, _ROW)


# --- sweeps ---


class Totals:
    """What tasks share: per context customers and tables, the root's customers and tables, the discounts, the strengths that these make likeliest, the byte restaurants."""

    def __init__(self, c: np.ndarray, t: np.ndarray, c1: float, t1: float, d: float, d1: float, d2: float, theta2: float, model: ByteModel | None = None):
        self.c, self.t, self.c1, self.t1, self.d, self.d1, self.d2, self.theta2, self.model = c, t, c1, t1, d, d1, d2, theta2, model
        self.theta, self.theta1 = strength(c, t, d), strength(np.array([c1]), np.array([t1]), d1)

    def root(self, customers, tables, spell):
        """The root's predictive probability."""
        return (np.maximum(customers - self.d1 * tables, 0) + (self.theta1 + self.d1 * self.t1) * spell) / (self.theta1 + self.c1)

    def own(self, u, n, t):
        """What a dish's own customers give in each context; nothing where u is the root."""
        inner = u < ROOT
        customers = self.c[np.where(inner, u, 0)] if len(self.c) else np.zeros(len(u))
        return np.where(inner, np.maximum(n - self.d * t, 0) / (self.theta + customers), 0.0)


#: Strengths whose likelihoods the tasks add up for the restaurants of rarer words.
_GRID = np.exp(np.linspace(log(0.1), log(1e7), 94))


def _lgamma(x: np.ndarray) -> np.ndarray:
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.5 * log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6))


def likelihoods(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """For each strength of the grid log of the likelihood of restaurants with c customers at t tables (see strength)."""
    keys, times = np.unique((c.astype(np.int64)[c > 1] << 32) | t.astype(np.int64)[c > 1], return_counts=True)
    c, t = (keys >> 32).astype(float), (keys & 0xFFFFFFFF).astype(float)
    return np.array([float(times @ (_lgamma(x / d + t) - _lgamma(x / d + 1 + 0 * t) - _lgamma(x + c) + _lgamma(x + 1 + 0 * t))) for x in _GRID])


def likeliest(values: np.ndarray) -> float:
    """The grid's strength of the greatest likelihood, moved to the top of the parabola through its neighbours; STRENGTH where all are equal."""
    i = int(np.argmax(values))
    if not np.ptp(values):
        return STRENGTH
    if not 0 < i < len(values) - 1:
        return float(_GRID[i])
    a, b, c = values[i - 1 : i + 2]
    return float(_GRID[i] * (_GRID[1] / _GRID[0]) ** ((a - c) / (2 * min(a - 2 * b + c, -1e-12))))


def _added(totals: list[dict]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """kind: (keys, values) of totals together."""
    out = {}
    for kind in {k for t in totals for k in t}:
        keys, back = np.unique(np.concatenate([t[kind][0] for t in totals if kind in t]), return_inverse=True)
        out[kind] = keys, np.bincount(back, np.concatenate([t[kind][1] for t in totals if kind in t]), len(keys))
    return out


def _summed(state: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """kind: (keys, values), from the tasks' totals, which TOTALS tasks add up first: contexts and strings of ORDER bytes, 256 ** ORDER at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, rows in _groups(batches):
            yield _rows([(g, _TOTALS, -1, _added([r for *_, r in rows]))])

    rows = by_group(state.where(f"kind = {_TOTALS}")).mapInArrow(run, _ROW).select("g", "data").collect()
    return _added([_unpacked(bytes(r.data)) for r in sorted(rows, key=lambda r: r.g)])


def _totals(parts: dict) -> pa.RecordBatch:
    """A task's totals: (keys, values) by kind."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    return _rows([(task % TOTALS, _TOTALS, task, parts)])


class _Sums:
    """Totals of a task."""

    def __init__(self, n_contexts: int):
        self.contexts, self.root, self.few, self.likely = np.zeros((2, n_contexts)), np.zeros(4), np.zeros(6), np.zeros(len(_GRID))
        self.strings = np.zeros(0, np.uint64), np.zeros(0)

    def add(self, words: list[bytes], s: dict, own: np.ndarray, d2: float | None) -> None:
        u, n, t, t1 = s["fu"], s["fn"].astype(np.int64), s["ft"], s["t1"]
        inner = u < ROOT
        for k, x in enumerate((n, t)):
            self.contexts[k] += np.bincount(u[inner], x[inner], self.contexts.shape[1])
        self.root += [own.sum(), t1.sum(), s["c"].sum(), (s["c"] > 0).sum()]
        self.few += [(n[inner] == 1).sum(), (n[inner] == 2).sum(), (own == 1).sum(), (own == 2).sum(), s["ones"].sum(dtype=np.int64), (s["rn"] == 2).sum()]
        if d2 is not None:
            self.likely += likelihoods(s["cu"], _rare_tables(s), d2)
        keys, at = spelled(words)
        every, back = np.unique(np.concatenate([self.strings[0], keys]), return_inverse=True)
        self.strings = every, np.bincount(back, np.concatenate([self.strings[1], t1[at]]), len(every))

    def batch(self) -> pa.RecordBatch:
        some = self.strings[1] > 0
        contexts = np.arange(self.contexts.shape[1])
        return _totals({_C: (contexts, self.contexts[0]), _T: (contexts, self.contexts[1]), _ROOT: (np.arange(4), self.root), _STRINGS: (self.strings[0][some], self.strings[1][some]), _FEW: (np.arange(6), self.few), _LIKELY: (np.arange(len(_GRID)), self.likely)})


def _rare_tables(s: dict) -> np.ndarray:
    """Tables of the group's own restaurants."""
    return s["ones"] + np.bincount(s["ru"], s["rt"], s["k"])


def _root_customers(s: dict) -> np.ndarray:
    """The words' customers in the root: tables in their contexts, and who sits there directly."""
    return np.bincount(s["fw"], np.where(s["fu"] < ROOT, s["ft"], s["fn"]), s["k"]) + s["single"] + np.bincount(s["asks"], s["ask_t"], s["k"])


def seated_first(state: DataFrame, n_contexts: int, salt: int) -> DataFrame:
    """The state before the first sweep: a table for every dish of every restaurant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, s = _Sums(n_contexts), None
        for g, rows in _groups(batches):
            s, asked = rows[0][2], rows[1:]
            words = _split(s["words"], s["k"])
            h = hashes(words, salt)
            order = np.argsort(h)
            asks = np.concatenate([np.zeros(0, np.int64), *[order[np.searchsorted(h, r[0], sorter=order)] for *_, r in asked]])
            n = np.concatenate([np.zeros(0), *[r[1] for *_, r in asked]])
            s |= {"asks": _small(asks), "ask_t": np.ones(len(asks), np.uint8), "from": np.array([src for _, src, _ in asked], np.int64), "ask_cuts": np.cumsum([0, *[len(r[0]) for *_, r in asked]])}
            s["single"] = _small((s["c"] - np.bincount(s["fw"], s["fn"], s["k"]) - np.bincount(asks, n, s["k"])).astype(np.int64))
            s |= {"ft": np.minimum(s["fn"], 1), "t1": np.minimum(s["c"], 1), "rt": np.ones(len(s["rn"]), np.uint8)}
            s |= {"p": [], "opens": [], "a": np.zeros(len(s["fn"]), np.float32), "ra": np.zeros(len(s["rn"]), np.float32), "one": np.zeros(s["k"], np.float32)}
            sums.add(words, s, _root_customers(s), None)
            yield _rows([(g, _STATE, -1, s)])
        if s:
            yield sums.batch()

    return by_group(state.where(F.col("kind").isin(_STATE, _TABLES))).select("g", "kind", "src", "data").mapInArrow(run, _ROW)


def swept(state: DataFrame, totals: Totals, sweep: int, salt: int, keep: bool = False, move: bool = True) -> DataFrame:
    """The state after a sweep, with its totals' rows and what it tells other groups; keep: what the state before predicts is kept; without move nobody moves.

    The restaurants of rarer words stand in their own groups: they draw by the root's probabilities that a sweep sends them, and the next one takes their tables into the root.
    """
    shared = state.sparkSession.sparkContext.broadcast(totals)  # bounded by SHARE contexts and 256 ** ORDER strings
    n_contexts = len(totals.c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, sums, s = shared.value, _Sums(n_contexts), None
        ways, ways1, ways2 = stirling(g.d), stirling(g.d1), stirling(g.d2)
        for group, rows in _groups(batches):
            s = rows[0][2]
            tables, odds = (np.concatenate(x) if (x := [r for kind, _, r in rows if kind == of]) else None for of in (_TABLES, _ODDS))
            words = _split(s["words"], s["k"])
            u, n, fw, t = s["fu"].astype(np.int64), s["fn"].astype(np.int64), s["fw"], s["ft"].astype(np.int64)
            t1 = s["t1"].astype(float)
            spell = spelling(words, g.model)
            p = g.root(_root_customers(s), t1, spell)
            ru, rn, rt, cu = s["ru"], s["rn"].astype(np.int64), s["rt"].astype(np.int64), s["cu"].astype(float)
            tu = _rare_tables(s)
            if keep:
                m, e = np.frexp(p)
                s["p"].append((m.astype(np.float32), e.astype(np.int16)))
                s["opens"].append(np.where(cu > 0, (g.theta2 + g.d2 * tu) / (g.theta2 + cu), 1.0).astype(np.float32))
                s["a"] += (g.own(u, n, t) / KEPT).astype(np.float32)
                s["ra"] += (np.maximum(rn - g.d2 * rt, 0) / (g.theta2 + cu[ru]) / KEPT).astype(np.float32)
                s["one"] += ((1 - g.d2) / (g.theta2 + cu) / KEPT).astype(np.float32)
            if not move:
                yield _rows([(group, _STATE, -1, {x: s[x] for x in ("c", "p", "opens", "a", "ra", "one")}), (group, _WORDS, -1, {x: s[x] for x in ("words", "k", "fw", "fu", "fn")})])
                continue
            if tables is not None:
                s["ask_t"] = tables
            h = hashes(words, salt)
            at = np.flatnonzero((u < ROOT) & (n > 1))  # one customer has one table
            t[at] = draw(n[at], np.maximum(g.t[u[at]] - t[at], 0), p[fw[at]], g.d, ways, *uniforms(h[fw[at]], u[at], np.uint64(sweep)), g.theta)
            s["ft"] = _small(t)
            own = _root_customers(s)
            t1 = draw(own, np.maximum(g.t1 - t1, 0), spell, g.d1, ways1, *uniforms(h, np.uint64(ROOT), np.uint64(sweep)), g.theta1)
            s["t1"] = _small(t1)
            told = [(int(x), _ODDS, group, p[s["asks"][a:b]].astype(np.float32)) for x, a, b in zip(s["from"], s["ask_cuts"], s["ask_cuts"][1:])]
            if odds is not None:
                rt = draw(rn, np.maximum(tu[ru] - rt, 0), odds.astype(float), g.d2, ways2, *uniforms(s["seed"], np.uint64(sweep)), g.theta2)
                s["rt"] = _small(rt)
                told += [(int(x), _TABLES, group, s["rt"][a:b]) for x, a, b in zip(s["to"], s["cuts"], s["cuts"][1:])]
            sums.add(words, s, own, g.d2)
            yield _rows([(group, _STATE, -1, s), *told])
        if move and s:
            yield sums.batch()

    return by_group(state.where(f"kind < {_PLACES}")).select("g", "kind", "src", "data").mapInArrow(run, _ROW)


class Model:
    """words: word, c, pairs, a (4 bytes a pair), p (8 bytes a kept sweep); opens: [kept, contexts + 1], how much of a frequent context the root gets (last: the root itself); strengths: of the frequent contexts, [kept]; state: groups; places: where the chunks' words and pairs are found in them."""

    def __init__(self, state: DataFrame, places: DataFrame, how: Dealing, opens: np.ndarray, strengths: list[float], N: int, V: int):
        self.state, self.places, self.how, self.known, self.opens, self.strengths, self.N, self.V = state, places, how, how.known, opens, strengths, N, V

    @property
    def words(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _groups(batches):
                s = rows[0][2] | rows[1][2]
                pairs = np.empty(len(s["fn"]), _PAIR)
                pairs["u"], pairs["n"] = s["fu"], s["fn"]
                some = pairs["n"] > 0  # else of held-out documents alone
                ends, k = np.cumsum(np.bincount(s["fw"][some], minlength=s["k"])), s["k"]
                cols = [pa.array(_split(s["words"], k), pa.binary()), pa.array(s["c"]), _blobs(pairs[some], ends), _blobs(s["a"][some], ends), _blobs(np.stack([_whole(*p) for p in s["p"]], 1).ravel(), np.arange(1, k + 1) * len(s["p"]))]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "c", "pairs", "a", "p"])

        return by_group(self.state.where(F.col("kind").isin(_STATE, _WORDS))).select("g", "kind", "src", "data").mapInArrow(run, "word binary, c long, pairs binary, a binary, p binary")


def trained(chunks: DataFrame, seed: int = 1, share: int | None = None, frequent: int = SHARE) -> Model:
    """share: only words with 1 / share of the tokens have restaurants (None: all words); frequent: those with 1 / frequent are kept in their dishes' rows."""
    N = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = contexts(chunks, N, share or frequent)
    if len(names) > ROOT:
        raise ValueError(f"{len(names)} contexts: at most {ROOT} can be kept in their dishes' rows")
    known = {w: i for i, w in enumerate(names)}
    k = len(names)
    groups, salt = LEAST + N // GROUP, 0
    while True:
        how = Dealing(known, groups, share is None, salt)
        made = stored(gathered(dealt(chunks, how), how))
        same = _summed(made)
        if _SAME not in same or not same[_SAME][1].sum():  # else two words have one hash; both are in one group, where it was seen
            break
        discard(made)
        salt += 1
    state = stored(seated_first(made, k, salt))
    places = stored(made.where(f"kind = {_PLACES}"))
    discard(made)
    got = _summed(state)
    V = int(got[_ROOT][1][3]) if _ROOT in got else 0
    totals, opens, strengths = None, [], []
    for sweep in range(BURN + KEPT + 1):
        zeros = (np.zeros(0, np.int64), np.zeros(0))
        root, few = got[_ROOT][1] if _ROOT in got else np.zeros(4), got[_FEW][1] if _FEW in got else np.zeros(6)
        d, d1, d2 = (totals.d, totals.d1, totals.d2) if totals else (discount(*few[i : i + 2]) for i in (0, 2, 4))
        seats = [got[x][1] if x in got else np.zeros(k) for x in (_C, _T)]
        keys, n = got.get(_STRINGS, zeros)
        model = ByteModel(keys.astype(np.uint64), n, seed * 1000 + sweep, totals.model if totals else None)
        totals = Totals(*seats, root[0], root[1], d, d1, d2, likeliest(got[_LIKELY][1]) if _LIKELY in got else STRENGTH, model)
        keep, last = sweep > BURN, sweep == BURN + KEPT
        if keep:
            opens.append(np.append((totals.theta + d * totals.t) / (totals.theta + totals.c), 1.0))
            strengths.append(totals.theta)
        before, state = state, stored(swept(state, totals, seed * 1000 + sweep, salt, keep, not last))
        discard(before)
        got = {} if last else _summed(state)
    return Model(state, places, how, np.array(opens), strengths, N, V)


# --- scores ---


def answered(model: Model) -> DataFrame:
    """For each chunk and group, in the order of what the chunk dealt: its words' counts and the root's probabilities, how much of a word's restaurant the root gets, what dishes' own customers give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, rows in _groups(batches):
            s, (chunks, at, pairs, rare, ru, rn, some) = rows[0][2], rows[1][2]
            ru = np.cumsum(ru, dtype=np.int64)
            own = np.where(rn == 1, s["one"][ru], np.float32(0))
            own[some] = s["ra"]
            for src, *steps in zip(chunks, at, pairs, rare):
                w, f, r = (np.cumsum(x, dtype=np.int64) for x in steps)
                yield _rows([(src, _TABLES, g, (_small(s["c"][w]), [(m[w], e[w]) for m, e in s["p"]], [o[w] for o in s["opens"]], s["a"][f], own[r]))])

    both = model.state.where(f"kind = {_STATE}").unionByName(model.places.where(f"kind = {_PLACES}"))
    return by_group(both).select("g", "kind", "src", "data").mapInArrow(run, _ROW)


def scored(docs: DataFrame, seed: int = 1, head: int | None = None, share: int | None = None, frequent: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_score (of the known tokens alone), perplexity for every row of docs(doc_id, text).

    share, frequent: see trained. head has no effect: no word is broadcast any more.
    """
    spark = docs.sparkSession
    chunks = stored(chunked(docs))
    model = trained(chunks, seed, share, frequent)
    answers = stored(answered(model))
    discard(model.state)
    discard(model.places)
    shared = spark.sparkContext.broadcast((model.how, model.opens, model.N, model.V))  # SHARE words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, frequent_opens, N, V = shared.value
        last = frequent_opens.shape[1] - 1
        chunk, got = None, []
        for b in batches:
            for _, _, g, data, *row in _each(b):
                if row[0] is not None:  # the chunk comes before its answers
                    if chunk:
                        yield out(chunk, got, how, frequent_opens, last, N, V)
                    chunk, got = row, []
                else:
                    got.append((g, _unpacked(data)))
        if chunk:
            yield out(chunk, got, how, frequent_opens, last, N, V)

    def out(chunk, got, how, frequent_opens, last, N, V) -> pa.RecordBatch:
        words, ids, held, sizes, tokens = chunk
        sizes = np.frombuffer(sizes, "<i4")
        d = Dealt(words.split(b" "), _unpacked(tokens).astype(np.int64), how)
        got = [a for _, a in sorted(got, key=lambda x: x[0])]
        c, own, rare_own = (np.concatenate([a[i] for a in got]) for i in (0, 3, 4))
        means = np.zeros(len(own) + len(rare_own))
        for k, share in enumerate(frequent_opens):
            p, opens = np.concatenate([_whole(*a[1][k]) for a in got]), np.concatenate([a[2][k] for a in got])
            means[: len(own)] += share[np.where(d.u == ROOT, last, d.u)] * p[d.w]
            means[len(own) :] += opens[d.rare_u] * p[d.rare_w]
        logs = np.log10(np.concatenate([own, rare_own]) + means / KEPT)
        seen, base = c > 0, np.log10((c + 0.1) / (N + 0.1 * (V + 1)))
        docs_of = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        k, x, y, z = np.zeros((4, len(ids)))
        for first in range(0, len(docs_of), SLICE):
            part = slice(first, first + SLICE)
            w, o, s = d.tokens[part], docs_of[part], logs[d.at[part]]
            for sums, v in ((k, seen[w]), (x, base[w]), (y, s), (z, seen[w] * s)):
                np.add.at(sums, o, v)  # in the order of the tokens, wherever slices end
        cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes.astype(np.int64)), pa.array(k.astype(np.int64)), pa.array(x), pa.array(y), pa.array(z)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "known_score"])

    columns = ["words", "ids", "held", "sizes", "tokens"]
    one = chunks.select(F.col("chunk").alias("g"), F.lit(_STATE).alias("kind"), F.lit(-1).cast("long").alias("src"), F.lit(None).cast("binary").alias("data"), *columns)
    both = one.unionByName(answers.select("g", "kind", "src", "data"), allowMissingColumns=True)
    got = None
    for i in range(ROUNDS):  # a round's shuffle files go before the next one's come
        some = stored(by_group(both.where(f"pmod(xxhash64(g), {ROUNDS}) = {i}")).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, known_score double"))
        got = some if got is None else got.unionByName(some)
    discard(chunks)
    discard(answers)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.N).cast("long").alias("train_tokens"), "base_score", "score", "known_score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
