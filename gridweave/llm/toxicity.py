"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words (letters only) and the prefixes of its words, so that forms of one stem
share a term; each is a 64-bit hash. A term's value is its log-odds in the labelled rows, and terms
that do not tell the classes apart are left out. The machine adds to the linear weights an inner
product of factors for every pair of terms, learned by Adagrad on log loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, pieces, text_bytes, word_hashes

#: The classifier is fitted on at most so many labelled rows (those of the smallest hash of the id).
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8)
FACTORS, EPOCHS, BATCH, RATE, L2 = 8, 30, 128, 0.05, 1e-4
#: A term needs so many labelled rows, and a log-odds of so many standard errors.
LEAST_ROWS, LEAST_Z = 3, 2.6
FILTER_BITS = 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, term hash) of a piece of texts; rows may repeat a term."""
    h, first, _, _, cut = word_hashes(data, off, _LETTER, PREFIXES)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    rows, found = [row], [h]
    for p in cut:
        ok = p != 0
        rows.append(row[ok]), found.append(p[ok])
    return np.concatenate(rows), np.concatenate(found)


def _distinct(row: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((t, row))
    row, t = row[order], t[order]
    new = np.ones(len(t), bool)
    new[1:] = (row[1:] != row[:-1]) | (t[1:] != t[:-1])
    return row[new], t[new]


def _features(batches):
    for batch in batches:
        for p in pieces(batch, "text"):
            row, t = _distinct(*terms(*text_bytes(p.column("text"))))
            at = np.searchsorted(row, np.arange(p.num_rows + 1))
            yield pa.RecordBatch.from_arrays([p.column("y"), pa.array([t[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["y", "t"])


def _counter(batches):
    """(term, rows of label 1, rows of label 0), summed over some rows before the shuffle."""
    for b in batches:
        for s in range(0, b.num_rows, 256):
            p = b.slice(s, 256)
            docs = [np.frombuffer(x, np.uint64) for x in p.column("t").to_pylist()]
            y = np.repeat(p.column("y").to_numpy(), [len(x) for x in docs])
            t, at = np.unique(np.concatenate(docs), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(np.bincount(at, y, len(t)).astype(np.int64)), pa.array(np.bincount(at, 1 - y, len(t)).astype(np.int64))], names=["t", "p", "q"])


def _indexer(keys: np.ndarray):
    """Rows' terms -> the numbers of those in `keys`."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column("t").to_pylist():
                t = np.frombuffer(x, np.uint64)
                at = np.minimum(np.searchsorted(keys, t), len(keys) - 1)
                out.append(at[keys[at] == t].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(out, pa.binary())], names=["y", "j"])

    return run


class Machine:
    """b + sum w x + sum over pairs <v_i, v_j> x_i x_j, over sorted term hashes with values r."""

    def __init__(self, keys, r, b, w, v):
        self.keys, self.r, self.b, self.w, self.v = keys, r, b, w, v
        self.may = np.zeros(1 << FILTER_BITS, bool)
        self.may[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def look(self, row, t):
        """Distinct (row, index of term) of the terms that are known."""
        if not len(self.keys):
            return row[:0], row[:0]
        ok = self.may[(t & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
        row, t = row[ok], t[ok]
        at = np.minimum(np.searchsorted(self.keys, t), len(self.keys) - 1)
        ok = self.keys[at] == t
        return tuple(np.divmod(np.unique(row[ok] * len(self.keys) + at[ok]), len(self.keys)))

    def raw(self, row, j, n):
        x = self.r[j]
        z = self.b + np.bincount(row, self.w[j] * x, n)
        for f in range(self.v.shape[1]):
            vx = self.v[j, f] * x
            z += 0.5 * (np.bincount(row, vx, n) ** 2 - np.bincount(row, vx * vx, n))
        return z

    def scores(self, column) -> np.ndarray:
        data, off = text_bytes(column)
        row, j = self.look(*terms(data, off))
        return 1 / (1 + np.exp(-np.clip(self.raw(row, j, len(off) - 1), -30, 30)))


def log_odds(p, q, pos: float, n: float):
    """Of terms with p rows of label 1 and q of label 0, of pos and n - pos: the log-odds and how many standard errors that is."""
    r = np.log((p + 0.5) / (pos + 1)) - np.log((q + 0.5) / (n - pos + 1))
    return r, r / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))


def untrained(n: float, pos: float) -> Machine:
    """Every score is the smoothed share of 1."""
    return Machine(np.zeros(0, np.uint64), np.zeros(0), np.log((pos + 0.5) / (n - pos + 0.5)), np.zeros(0), np.zeros((0, FACTORS)))


def fit(keys: np.ndarray, r: np.ndarray, docs: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Machine:
    """keys, r: the terms that count, sorted, and their log-odds; docs: each row's distinct numbers of such terms."""
    y = np.asarray(y, float)
    n, pos, k = len(y), float(y.sum()), len(keys)
    prior = np.log((pos + 0.5) / (n - pos + 0.5))
    start, j = np.concatenate(([0], np.cumsum([len(d) for d in docs]))), np.concatenate(docs).astype(np.int64)
    rng = np.random.default_rng(seed)
    m = Machine(keys, r, prior, np.full(k, 0.2), rng.normal(0, 0.01, (k, FACTORS)))
    gb, gw, gv = 1e-6, np.full(k, 1e-6), np.full((k, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            d = order[s : s + BATCH]
            size = start[d + 1] - start[d]
            i = np.repeat(np.arange(len(d)), size)
            c = j[np.repeat(start[d] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            x = r[c]
            sums = np.stack([np.bincount(i, m.v[c, f] * x, len(d)) for f in range(FACTORS)], axis=1)
            e = 1 / (1 + np.exp(-np.clip(m.raw(i, c, len(d)), -30, 30))) - y[d]
            g = e.mean()
            gb += g * g
            m.b -= RATE * g / np.sqrt(gb)
            if not len(c):
                continue
            u, inv = np.unique(c, return_inverse=True)
            ex = e[i] * x / len(d)
            dw = np.bincount(inv, ex) + L2 * m.w[u]
            gw[u] += dw * dw
            m.w[u] -= RATE * dw / np.sqrt(gw[u])
            for f in range(FACTORS):
                dv = np.bincount(inv, ex * (sums[i, f] - m.v[c, f] * x)) + L2 * m.v[u, f]
                gv[u, f] += dv * dv
                m.v[u, f] -= RATE * dv / np.sqrt(gv[u, f])
    return m


def _fitter(keys: np.ndarray, r: np.ndarray):
    def run(batches):
        rows = sorted((y, j) for b in batches for y, j in zip(b.column("y").to_pylist(), b.column("j").to_pylist(), strict=True))
        m = fit(keys, r, [np.frombuffer(j, "<u4") for _, j in rows], np.array([y for y, _ in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (np.array([m.b], float), m.w, np.ascontiguousarray(m.v))], names=["b", "w", "v"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on at most `sample_rows` labelled rows outside the held-out third.

    Terms are counted by an aggregation; only the numbers of those that tell the classes apart go to the one task that learns.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    lab = lab.where(F.crc32(F.col("id").cast("string")) % 3 != 1).groupBy("id").agg(F.max("y").alias("y"))
    lab = lab.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    rows = materialize(d.join(F.broadcast(lab), "id").select("y", "text").mapInArrow(_features, "y int, t binary").distinct(), "features")  # copies count once
    n, pos = (float(x or 0) for x in rows.agg(F.count("*"), F.sum("y")).first())
    if not 0 < pos < n:
        return untrained(n, pos)
    counts = rows.mapInArrow(_counter, "t long, p long, q long").groupBy("t").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= LEAST_ROWS)
    z = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (n - pos + 1))
    z = F.abs(z) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    got = counts.where(z >= LEAST_Z).toPandas()  # of a bounded sample's terms
    if not len(got):
        return untrained(n, pos)
    keys = got.t.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, r = keys[order], log_odds(got.p.to_numpy(float), got.q.to_numpy(float), pos, n)[0][order]
    one = rows.mapInArrow(_indexer(keys), "y int, j binary").repartition(1).mapInArrow(_fitter(keys, r), "b binary, w binary, v binary").collect()[0]
    drop_scratch(rows)
    num = lambda x: np.frombuffer(bytes(x), float)
    return Machine(keys, r, float(num(one.b)[0]), num(one.w), num(one.v).reshape(-1, FACTORS))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row a document: id, held_out, score (0 to 1), predicted (score >= threshold).

    Only the text enters the score; null and empty texts get the score of a text without terms. Null ids
    are scored, never learned from, and count as not held out. Rows that repeat id or text get equal
    scores. Labels other than 0 and 1 are ignored, repeated ones count as 1 if any is; without labels
    of both classes all texts get the smoothed share of 1; in learning, labelled copies with equal terms
    count once. Other columns are ignored; an empty table
    gives no rows.
    """
    m = fit_toxicity(docs, labels, id_col, text_col, label_col, sample_rows)

    def run(batches):
        for batch in batches:
            for p in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([p.column("id"), pa.array(m.scores(p.column("text")))], names=["id", "score"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(run, f"id {dict(d.dtypes)['id']}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns."""
    m = fit_toxicity(docs, labels, id_col, text_col, label_col, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            batch = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for p in pieces(batch, str(at)):
                yield p.filter(pa.array(m.scores(p.column(at)) < threshold)).rename_columns(names)

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)
