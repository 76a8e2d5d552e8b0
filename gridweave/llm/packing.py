"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows; a document's last piece goes where it fits
best, and when none fits the fullest window is emitted. The windows still open at the end are
merged, some thousands a task.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW, OPEN, END_ID = 4096, 64, 2
MERGE_UNITS = 8192
#: Words and their pieces of which a worker keeps the ids (some 200 bytes each).
CACHE_WORDS, CACHE_PIECES = 1_000_000, 800_000
#: Texts with other characters than these go through the tokenizer whole: there normalising and
#: lower-casing may depend on neighbours; "<|" may begin a special token.
_HARD = re.compile("[\x1c-\x1fɐ-\U0010ffff]|<\\|")


#: The vocabulary's own cut of normalised text into pieces, within which pairs are merged.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_signs() -> dict[int, str]:
    """The byte-level vocabulary's sign of each byte: itself where it can be printed in Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokens:
    """The ids of texts as little-endian u32 bytes; words between white space and their pieces are cached.

    The vocabulary's normaliser composes characters, drops white space and lower-cases; its words
    never cross white space, so the ids of a text are those of its parts in order. New pieces go to the
    tokenizer's model itself, whose cut of letters, digits and other signs is repeated here. (Machines are little-endian.)
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.known, self.piece = Tokenizer.from_file(path), {}, {}
        self.model, self.signs = self.tok.model, byte_signs()

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words) -> None:
        known, piece, find, merge = self.known, self.piece, _PIECES.findall, self.model.tokenize
        if len(piece) > CACHE_PIECES:
            piece.clear()
        for w in words:
            ids = []
            for p in (w,) if w.isascii() and w.isalpha() else find(w):
                x = piece.get(p)
                if x is None:
                    sign = p if p.isascii() else p.encode().decode("latin-1").translate(self.signs)
                    x = piece[p] = array("I", [t.id for t in merge(sign)]).tobytes()
                ids.append(x)
            known[w] = ids[0] if len(ids) == 1 else b"".join(ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        split = {}
        for i, t in enumerate(texts):
            if _HARD.search(t):
                out[i] = self.whole(t)
            else:
                split[i] = (t if t.isascii() else unicodedata.normalize("NFC", t)).lower().split()
        known = self.known
        miss = set().union(*(set(ws).difference(known) for ws in split.values()))
        if miss:
            if len(known) + len(miss) > CACHE_WORDS:
                known.clear()
                miss = set().union(*split.values())
            self.learn(miss)
        for i, ws in split.items():
            out[i] = b"".join(map(known.__getitem__, ws))
        return out


_tokens: dict[str, Tokens] = {}


def _tokenizer(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class Windows:
    """Open windows by free space; a window is a list of units with a shared sequence id."""

    def __init__(self, window: int, most: int, ids):
        self.window, self.most, self.ids = window, most, ids
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def put(self, size: int, unit):
        """Place a unit; returns the window emitted for it, if any."""
        out = None
        at = bisect.bisect_left(self.free, (size, -1))
        if at == len(self.free):
            if len(self.free) == self.most:
                out = self.held.pop(self.free.pop(0)[1])
            seq = next(self.ids)
            self.held[seq] = []
            free = self.window
        else:
            free, seq = self.free.pop(at)
        self.held[seq].append((unit, seq, self.window - free))
        if free - size:
            bisect.insort(self.free, (free - size, seq))
            return out
        full = self.held.pop(seq)
        return full if out is None else out + full


def _ids(part: int):
    n = 0
    while True:
        yield part << 32 | n
        n += 1


_PIECE = "id long, start long, length long, crc long, doc_tokens long, seq long, offset long, open boolean"


def _packer(path: str, window: int, most: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(found, is_open):
        u = [x[0] for x in found]
        cols = list(zip(*u, strict=True)) if u else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [*(pa.array(list(c), pa.int64()) for c in cols), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([is_open] * len(u), pa.bool_())],
            names=["id", "start", "length", "crc", "doc_tokens", "seq", "offset", "open"],
        )

    def run(batches):
        tok, ids = _tokenizer(path), _ids(TaskContext.get().partitionId())
        w = Windows(window, most, ids)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                p = b.slice(at, 500)
                done = []
                for doc, raw in zip(p.column("id").to_pylist(), tok([t or "" for t in p.column("text").to_pylist()]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for s in range(0, n, window):
                        part = raw[4 * s : 4 * (s + window)]
                        size = len(part) // 4
                        unit = (doc, s, size, zlib.crc32(part), n)
                        if size == window:
                            done.append((unit, next(ids), 0))
                        elif out := w.put(size, unit):
                            done.extend(out)
                yield rows(done, False)
        yield rows([x for h in w.held.values() for x in h], True)

    return run


def _merger(window: int):
    def run(batches):
        units = sorted((u for b in batches for u in zip(b.column("fill").to_pylist(), b.column("seq").to_pylist(), strict=True)), reverse=True)
        w = Windows(window, len(units) + 1, (seq for _, seq in units))
        done = []
        for fill, seq in units:
            done.extend(w.put(fill, seq) or [])
        done.extend(x for h in w.held.values() for x in h)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in range(3)], names=["seq", "into", "base"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and `end_id`; null or empty text is `end_id` alone. Documents are cut at
    multiples of `window` only; every id lies in one piece, sequences hold at most `window` ids
    without gaps, and what a sequence lacks is padding. Null and repeated ids are packed like
    others, row by row. Other columns are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    got = materialize(d.mapInArrow(_packer(tokenizer_path, window, open_windows, end_id), _PIECE), "pieces")
    left = got.where("open")
    units = materialize(left.groupBy("seq").agg(F.sum("length").alias("fill")), "units")
    n = units.count()
    merged = materialize(units.repartition(max(1, -(-n // MERGE_UNITS)), "seq").mapInArrow(_merger(window), "seq long, into long, base long"), "merged")
    left = left.join(merged, "seq").select("id", "start", "length", "crc", "doc_tokens", F.col("into").alias("seq"), (F.col("offset") + F.col("base")).alias("offset"))
    out = got.where("not open").drop("open").unionByName(left)
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("seq").alias("sequence_id"), "offset")
