"""Packing documents into token windows by the sum-of-squares rule.

A document is its tokens and an end id. What fills whole windows is cut off at once; the rest is placed online: of all
fill levels with an open window, and a new window, it goes to the one after which the sum of squared counts of open
windows by fill level is least. The counts are kept in an array by level. At the end of a part the open windows are
merged: the emptiest are cut into the room of the fullest, so that at most one window of a part is not full; that one
is padded, unless its length is a power of two. So the rule decides how few documents are cut, the merge how little is
padded: rule_padding is what the part's windows would be padded by without the merge.

Documents are dealt by a hash of doc_id (without one, of their ids) into parts whose number follows the count of rows, and each part is packed in
the order of doc_id, so a lost executor's work comes out the same again; sequence ids are the part and a running number.
Defined results: a null text is empty, and an empty text is the end id alone; a null doc_id is dealt and packed like
any other; repeated rows are packed as often as they come; an empty table gives an empty result; extra columns are ignored. A very long
text is encoded whole, in one task, and cut into whole windows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END = 2048, 1
#: The separators U+001C to U+001F, white space to Python but not to the tokenizer, and its white space (fixed values).
_NO_SPACE, _SPACE = re.compile("[\x1c-\x1f]").search, re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").split
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, rule_padding long"
#: Rows of a part, and words held in a worker's cache of encoded words.
PART_ROWS, CACHE = 8192, 300_000
#: Rows that are turned into Python's texts or ids at once.
SLICE = 512


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, by a cache of words.

    The vocabulary's pieces never cross white space, so a text's ids are those of its words. Words of ASCII letters,
    digits and marks and of Latin-1 letters are split and lowered here and their pieces merged by the file's own merges (the
    tests hold both ways equal); other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[!-~À-ÖØ-öø-ÿ]*").fullmatch
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.merge, ids = self._merges(json.loads(self.whole.to_str())["model"], {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)})
        self.ids = [x.tobytes() for x in ids].__getitem__

    @staticmethod
    def _merges(model: dict, shown: dict[int, str]):
        """The vocabulary's merges as ranks of byte strings, with byte 0 for the word end, and the id of each rank."""
        import tiktoken

        byte, ranks, ids = {c: b for b, c in shown.items()}, {}, []

        def add(key: bytes, token: str) -> None:
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(model["vocab"].get(token, 0))

        for b in range(256):
            add(bytes([b]), shown[b])
        for b in range(1, 256):
            add(bytes([b, 0]), shown[b] + "</w>")
        for m in model["merges"]:
            token = "".join(m if isinstance(m, list) else m.split(" "))
            add(bytes(byte[c] for c in token.removesuffix("</w>")) + b"\0" * token.endswith("</w>"), token)
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, np.array(ids, "<u4")

    def piece(self, p: str) -> bytes:
        ids = self.pieces.get(p)
        if ids is None:
            ids = b"".join(map(self.ids, self.merge(p.encode() + b"\0")))
            if len(self.pieces) >= CACHE // 2:
                self.pieces.clear()
            self.pieces[p] = ids
        return ids

    def word(self, w: str) -> bytes:
        if w.isascii() and w.isalpha():  # one piece
            ids = b"".join(map(self.ids, self.merge(w.lower().encode() + b"\0")))
        elif self.plain(w) and "<|" not in w:
            ids = b"".join(map(self.piece, self.find(w.lower())))
        else:
            ids = np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) >= CACHE:
            self.words.clear()
        self.words[w] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        get, word, text = self.words.get, self.word, text or ""
        words = filter(None, _SPACE(text)) if _NO_SPACE(text) else text.split()
        return b"".join([get(w) or word(w) for w in words])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Frees the worker's encoders. A function of the module, as what tasks are sent of its variables is a copy."""
    _encoders.clear()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first in range(0, b.num_rows, SLICE):
            yield b.slice(first, SLICE)


class Packer:
    """Sum-of-squares placement. Windows that are full leave through `full`; `close` gives the others, merged."""

    def __init__(self, window: int = WINDOW):
        self.window, self.full = window, []
        self.level = np.zeros(window + 1, np.int64)  # open windows by fill; 0 and the full ones are never counted
        self.open: list[list[list]] = [[] for _ in range(window)]

    def place(self, piece: tuple, size: int) -> None:
        """piece: (doc, start, length) with length = size <= window."""
        n, w = self.level, self.window
        if size == w:
            self.full.append([piece])
            return
        fills = np.flatnonzero(n[1 : w - size + 1]) + 1
        best, cost = 0, 2 * n[size] + 1
        if len(fills):
            after = n[fills + size]
            gain = 2 * (after - n[fills]) + 2
            if fills[-1] == w - size:
                gain[-1] = -2 * n[w - size] + 1
            k = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if gain[k] <= cost:
                best = int(fills[k])
        held = self.open[best].pop() if best else []
        if best:
            n[best] -= 1
        held.append(piece)
        if best + size == w:
            self.full.append(held)
        else:
            self.open[best + size].append(held)
            n[best + size] += 1

    def padding(self) -> int:
        """What the open windows lack."""
        return sum(padded(f, self.window) - f for f in range(1, self.window) for _ in self.open[f])

    def close(self) -> list[list[tuple]]:
        left = [(f, held) for f in range(1, self.window) for held in self.open[f]]
        out, low, high = [], 0, len(left) - 1
        rest: list[tuple] = []  # pieces of the emptiest window that is being cut up
        while low <= high or rest:
            if low > high:
                out.append(rest)
                break
            fill, held = left[high]
            high -= 1
            room = self.window - fill
            while room and (rest or low <= high):
                if not rest:
                    rest = left[low][1]
                    low += 1
                doc, start, length = rest.pop()
                take = min(length, room)
                held.append((doc, start + length - take, take))
                if take < length:
                    rest.append((doc, start, length - take))
                room -= take
            out.append(held)
        return out


def padded(length: int, window: int = WINDOW) -> int:
    """The length after padding: a power of two stays as it is."""
    return length if length & (length - 1) == 0 else window


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """FIELDS: a row for each piece of docs(doc_id, text)."""
    path = path or tokenizer_path()
    parts = parts or max(1, -(-docs.select(F.count("*")).first()[0] // PART_ROWS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        end = np.array([END], "<u4").tobytes()
        for b in _sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ids(t) + end for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    encoded = texts.mapInArrow(encode, "doc_id long, ids binary")
    part = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("ids"))), F.lit(parts)).cast("int")
    dealt = encoded.select("doc_id", "ids", part.alias("part"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "doc_id", F.crc32("ids"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [pa.int64()] * 9
        state: dict = {"part": None, "packer": None, "docs": [], "made": 0}

        def rows(windows: list, table: list, lack: int) -> Iterator[tuple]:
            for held in windows:
                at, seq = 0, (state["part"] << 32) | state["made"]
                state["made"] += 1
                total = sum(x[2] for x in held)
                for doc, start, length in held:
                    doc_id, data = table[doc]
                    yield doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), len(data) // 4, seq, at, padded(total, window), lack
                    at += length

        def batch(made) -> pa.RecordBatch:
            cols = list(zip(*made)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        def finish() -> list:
            p = state["packer"]
            if not p:
                return []
            lack = p.padding()
            return [*rows(p.full, state["docs"], lack), *rows(p.close(), state["docs"], lack)]

        forget()  # all texts are encoded; a worker that comes from that stage gives its cache back
        for b in _sliced(batches):
            made: list = []
            for doc_id, data, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if part != state["part"]:
                    made += finish()
                    state.update(part=part, packer=Packer(window), docs=[], made=0)
                p, doc, n = state["packer"], len(state["docs"]), len(data) // 4
                state["docs"].append((doc_id, data))
                whole = n - n % window
                for start in range(0, whole, window):
                    p.place((doc, start, window), window)
                if n > whole:
                    p.place((doc, whole, n - whole), n - whole)
            if made:
                yield batch(made)
        yield batch(finish())

    return dealt.select("doc_id", "ids", "part").mapInArrow(pack, FIELDS)
