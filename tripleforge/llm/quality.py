"""Quality rules: counts over words and lines, then compression bands.

Every text is compressed whole and in fixed chunks with zstandard. The ratio of compressed to plain bytes falls with
length, so each band of lengths has its own limits: below the lower one a text is repetitive, above the upper one it is
incompressible. A text fails if the whole of it is out of its band, or if more than a share of its chunks are. A text of
one chunk or more is judged by chunks; where its length is no multiple of theirs, the last one ends with the text.

The limits are measured: of the documents of sf0.1 that `labels` gives quality 1 and the counts keep (3,243; 1,368 chunks),
the 0.1 percentile of the ratio less 5 % and the 99.9 percentile plus 5 %, for each band from 256 to 32,768 bytes and for
chunks. Shorter texts, which seldom have 50 words, and longer ones are not in that sample: their limits are set by hand.

Defined results: a null text has no words (base_failed, not kept); an empty text alike; repeated rows are judged alike;
an empty table gives an empty result; extra columns are ignored by `measured` and kept by `keep`. A very long text is
judged whole, as one Python object of its task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (bytes below, lowest ratio, highest ratio) of a text; (lowest, highest) of a chunk.
BANDS = ((64, 0.45, 6.0), (128, 0.45, 1.60), (256, 0.42, 1.20), (512, 0.518, 0.758), (1024, 0.485, 0.716), (2048, 0.453, 0.608), (4096, 0.429, 0.546), (8192, 0.407, 0.496), (16384, 0.395, 0.474), (32768, 0.383, 0.449), (65536, 0.36, 0.449), (1 << 62, 0.30, 0.449))
CHUNK_BAND = (0.423, 0.506)
#: Bytes of a chunk, share of chunks that may be out of their band, compression level.
CHUNK, BAD_SHARE, LEVEL = 4096, 0.5, 3
FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long, n_bytes long"
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_NOT_SYMBOLS, _KEEP_LEADS = bytes(set(range(256)) - set(_SYMBOLS)), bytes([*_SPACES, *range(0x80, 0xC0)])


def limits(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in bands if n_bytes < below)


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts, out, covered = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            out += i + 3 - max(i, covered)
            covered = i + 3
    return out


def measure(text: str | None, compressor) -> tuple:
    """The columns of FIELDS after doc_id."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    seen: set = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += bool(line.strip(_SPACES))
        else:
            seen.add(line)
    repeats = repeat_words(words)
    chars = len(data.translate(None, _KEEP_LEADS))  # bytes that lead a code point, without white space
    failed = n < 50 or 100 * repeats > 50 * n
    size = len(data)
    ratio = len(compressor.compress(data)) / size if size else 0.0
    lo, hi = limits(size)
    out_of_band = not lo <= ratio <= hi
    bad = chunks = 0
    if size >= CHUNK:
        lo, hi = CHUNK_BAND
        for at in [*range(0, size - CHUNK, CHUNK), size - CHUNK]:
            chunks += 1
            bad += not lo <= len(compressor.compress(data[at : at + CHUNK])) / CHUNK <= hi
    kept = not failed and not out_of_band and bad <= BAD_SHARE * chunks
    return n, chars, len(data.translate(None, _NOT_SYMBOLS)), dup, repeats, failed, kept, ratio, bad, chunks, size


def measured(docs: DataFrame) -> DataFrame:
    """FIELDS for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 3
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for b in batches:
            rows = [measure(t, compressor) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FIELDS)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            yield b.filter(pa.array([measure(t, compressor)[6] for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
