"""Language-model scoring with a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

The model predicts a token's class: one of the most frequent words, the end of the text, or one of a fixed
number of spelling classes (by a word's last bytes) that share all other words. Within a spelling class it
predicts the member: of N training tokens the sqrt(N) most frequent words have vectors of their own (if they are seen MIN_COUNT
times), so their number grows with the input, and one more member stands for the class's rare words. Both predictions are
bilinear in the context and the output: a vector for each of the last two tokens and the mean of a third vector
over all tokens so far, times the output's vector, plus a bias. NCE trains them; for scores
batched matrix products give the logits of all classes and of all members of the token's class and so exactly normalised
probabilities. Among a class's rare words smoothed relative frequencies count, so the probabilities of all words, seen or
not, sum to one.

Counts cover all training tokens. The vectors start from a bounded sample of documents and are then
trained on all training documents, one copy a task, and averaged by weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, materialize, mix, pieces, text_bytes, word_hashes

#: Words with a class of their own, spelling classes, and dimensions.
WORDS, CLASSES, DIM = 255, 128, 24
#: Words whose counts every task holds (a fixed bound); the others' counts come by a join.
TOP = 1 << 17
#: Documents (those of the smallest hash of the id) from which the vectors start, and passes over them.
START_DOCS, START_EPOCHS = 2_000, 3
#: Words have vectors of their own by rank, down to the square root of the number of training tokens, if training has seen them so often.
MIN_COUNT = 200
#: One copy of the model is trained for so many words with vectors, so that what copies send stays in proportion to the corpus.
COPY_WORDS = 200
#: Noise members a token in the prediction within its class.
MEMBER_NOISE = 4
NOISE, BATCH, RATE = 64, 4096, 0.1
#: Tokens scored at a time, so that their probabilities of all classes stay in the processor's cache.
SCORE_ROWS = 512
END = np.uint64(0x656E64206F662074)
#: Logits times this go to powers of 2, which numpy has faster than those of e.
LOG2E = np.float32(np.log2(np.e))
_BUFFER = 4 << 20
_TABLES = ("E", "R", "b", "R2")
#: The spelling class of a word's last two bytes.
_SPELLING = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(CLASSES)).astype(np.int32)
_UP_TO = np.tril(np.ones((32, 32), np.float32))


def tokens(data: np.ndarray, off: np.ndarray):
    """(hash, spelling class, row) of all tokens of a piece of texts; every text ends with END."""
    h, first, s, e = word_hashes(data, off)
    last = _LOWER[data[e - 1]].astype(np.int32) if len(e) else np.zeros(0, np.int32)
    prev = np.where(e - s > 1, _LOWER[data[np.maximum(e - 2, 0)]], 0) if len(e) else last
    cls = _SPELLING[last * 256 + prev]
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    # an END after each text's words
    at = first[1:] + np.arange(n)
    total = len(h) + n
    is_end = np.zeros(total, bool)
    is_end[at] = True
    oh, oc, orow = np.empty(total, np.uint64), np.zeros(total, np.int32), np.empty(total, np.int64)
    oh[is_end], oh[~is_end] = END, h
    oc[~is_end] = cls
    orow[is_end], orow[~is_end] = np.arange(n), row
    return oh, oc, orow


def _counter(batches):
    """(hash, class, count), summed over some MB of text before the shuffle."""
    hs, cs, size = [], [], 0

    def out():
        h, c = np.concatenate(hs), np.concatenate(cs)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(c[order[first]]), pa.array(np.diff(np.append(first, len(h))))], names=["h", "cls", "c"])

    for b in batches:
        for p in pieces(b, "text"):
            h, c, _ = tokens(*text_bytes(p.column("text")))
            hs.append(h), cs.append(c)
            size += len(h)
            if size >= _BUFFER:
                yield out()
                hs, cs, size = [], [], 0
    if size:
        yield out()


def _aliases(share: np.ndarray, start: np.ndarray):
    """Alias tables: a uniform slot of a class stands for itself with probability keep, else for other, so members come up by share."""
    keep, other = np.ones(len(share)), np.arange(len(share))
    for low, high in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        p = (share[low:high] * (high - low)).tolist()
        small, large = [i for i, x in enumerate(p) if x < 1], [i for i, x in enumerate(p) if x >= 1]
        while small and large:
            i, j = small.pop(), large[-1]
            keep[low + i], other[low + i] = p[i], low + j
            p[j] -= 1 - p[i]
            if p[j] < 1:
                small.append(large.pop())
    return keep, other


class Vocabulary:
    """Counts of the most frequent words, sorted by hash, and what is needed to smooth the rest."""

    def __init__(self, top: list[tuple[int, int]], n: int, v: int, classes: dict[int, tuple[int, int]], cls: list[int], least: int = MIN_COUNT):
        """top: (hash, count), most frequent first; n, v: training tokens and distinct ones; classes: tokens and words without a class of their own; cls: the spelling classes of top."""
        h = np.array([x for x, _ in top], np.int64).view(np.uint64)
        c = np.array([x for _, x in top], np.int64)
        own = np.flatnonzero(h != END)[:WORDS]
        ids = np.full(len(h), -1, np.int32)
        ids[own] = 1 + np.arange(len(own))
        ids[h == END] = 0
        # members: of each spelling class its words of `least` tokens or more, then its rare words
        cls = np.array(cls, np.int64)
        often = np.flatnonzero((ids < 0) & (c >= least))
        often = often[np.argsort(cls[often], kind="stable")]
        per = np.bincount(cls[often], minlength=CLASSES)
        self.start = np.concatenate(([0], np.cumsum(per + 1)))
        self.members = int(self.start[-1])
        member = np.full(len(h), -1, np.int32)
        member[often] = np.arange(len(often)) + cls[often]
        share = np.zeros(self.members)
        share[member[often]] = c[often] + 0.5
        inside = np.array([classes.get(k, (0, 0)) for k in range(CLASSES)], float).reshape(CLASSES, 2)
        # rare words, and one that was never seen
        rest = inside[:, 0] - np.bincount(cls[often], c[often], CLASSES) + 0.5 * (inside[:, 1] - per + 1)
        share[self.start[1:] - 1] = rest
        total = np.add.reduceat(share, self.start[:-1])
        self.share = share / np.repeat(total, per + 1)
        self.in_rest = np.log10(rest)
        self.member_shift = np.log(MEMBER_NOISE * self.share).astype(np.float32)
        self.keep, self.other = _aliases(self.share, self.start)
        # sorted by hash, and what tokens get that are not held; a hash's first bits tell where to begin
        order = np.argsort(h)
        self.h = np.append(h[order], ~np.uint64(0))
        self.c = np.append(c[order], -1)
        self.id = np.append(np.where(ids < 0, 1 + WORDS + cls, ids)[order], -1)
        self.member = np.append(np.where(ids < 0, np.where(member < 0, self.start[cls + 1] - 1, member), -1)[order], -1)
        self.bits = np.uint64(64 - max(1, len(h)).bit_length() - 1)
        self.first = np.searchsorted(self.h[:-1], np.arange(1 << (64 - int(self.bits)), dtype=np.uint64) << self.bits)
        self.n, self.v = n, v
        self.words = len(own)
        self.size = 1 + WORDS + CLASSES
        self.base_z = np.log10(n + 0.5 * (v + 1))
        noise = np.full(self.size, 0.5)
        noise[ids[own]] += c[own]
        noise[0] += c[h == END].sum()
        for k, (tok, _) in classes.items():
            noise[1 + WORDS + k] += tok
        noise[1 + self.words : 1 + WORDS] = 1e-9
        self.noise = noise / noise.sum()

    def look(self, h: np.ndarray, cls: np.ndarray):
        """(class id, member or -1, count or -1 if not held, whether the token has a class of its own)."""
        at = self.first[h >> self.bits]
        for _ in range(2):
            at += self.h[at] < h
        left = np.flatnonzero(self.h[at] < h)
        while len(left):
            at[left] += 1
            left = left[self.h[at[left]] < h[left]]
        new = np.flatnonzero((self.h[at] != h) | (at == len(self.h) - 1))
        at[new] = len(self.h) - 1
        ids, member = self.id[at], self.member[at]
        ids[new], member[new] = 1 + WORDS + cls[new], self.start[cls[new] + 1] - 1
        end = new[h[new] == END]
        ids[end], member[end] = 0, -1
        return ids, member, self.c[at], member < 0

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """The tables' shapes. E: three vectors for each input, first the words with a class of their own (the end is 0), then the members; R2: a member's vector and bias."""
        return {"E": (1 + WORDS + self.members, 3 * DIM), "R": (self.size, DIM), "b": (self.size,), "R2": (self.members, DIM + 1)}


def start_model(vocab: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    m = {k: rng.normal(0, 0.1 if k[0] == "R" else 0.01, x).astype(np.float32) for k, x in vocab.shapes().items() if k != "b"}
    m["R2"][:, DIM] = np.log(vocab.share)
    return m | {"b": np.log(vocab.noise).astype(np.float32)}


def _inputs(ids: np.ndarray, member: np.ndarray) -> np.ndarray:
    """The rows of E."""
    return np.where(member >= 0, 1 + WORDS + member, ids)


def _one(q: np.ndarray) -> np.ndarray:
    """With a last column of ones, for the bias."""
    return np.concatenate((q, np.ones((len(q), 1), np.float32)), axis=1)


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of the rows before each row, and of all (len + 1): 32 rows at a time by a product, those before them in double."""
    n, d = x.shape
    rows = np.zeros((n // 32 + 1, 32, d), np.float32)
    rows.reshape(-1, d)[1 : n + 1] = x
    rows, before = np.matmul(_UP_TO, rows), np.zeros((len(rows), 1, d))
    np.cumsum(rows[:-1, -1], axis=0, out=before[1:, 0])
    return (rows + before).reshape(-1, d)[: n + 1]


def _context(m: dict, inputs: np.ndarray, row: np.ndarray):
    """Context vectors of all tokens of whole texts, given by input rows; the number of tokens so far; where texts start."""
    n = len(inputs)
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    size = np.diff(np.append(start, n))
    pos = np.arange(n) - np.repeat(start, size)
    e = m["E"].take(inputs, axis=0)
    # nothing goes to the next text; a first text of one token makes last - 1 the batch's last token, which is a last one too
    last = start + size - 1
    e[last, : 2 * DIM] = 0
    e[last - 1, DIM : 2 * DIM] = 0
    sums = _running(e[:, 2 * DIM :])
    mean = sums[:-1] - np.repeat(sums[start], size, axis=0) if len(start) > 1 else sums[:-1]
    mean *= (1 / np.maximum(pos, 1))[:, None]
    q = mean.astype(np.float32)
    q[1:] += e[:-1, :DIM]
    q[2:] += e[:-2, DIM : 2 * DIM]
    return q, pos, start


def _order(idx: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0, by 16 bits at a time, which numpy sorts by radix."""
    order = np.argsort(idx.astype(np.uint16), kind="stable")
    if len(idx) and idx.max() >> 16:
        order = order[np.argsort((idx >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _places(idx: np.ndarray):
    """The distinct numbers in idx, and the place of each among them."""
    seen = np.zeros(int(idx.max()) + 1, bool)
    seen[idx] = True
    found, at = np.flatnonzero(seen), np.empty(len(seen), np.int64)
    at[found] = np.arange(len(found))
    return found, at[idx]


def _sums(idx: np.ndarray, g: np.ndarray):
    """The distinct numbers in idx, and the sum of g's rows of each, a column at a time."""
    found, place = _places(idx)
    out = np.empty((g.shape[1], len(found)), np.float32)
    for j, col in enumerate(np.ascontiguousarray(g.T)):
        out[j] = np.bincount(place, col, len(found))
    return found, out.T


def _outer_sums(idx: np.ndarray, e: np.ndarray, q: np.ndarray):
    """As _sums of the rows e[i, j] * q[i] of the numbers idx[i, j], a column of q at a time, without those rows."""
    found, place = _places(idx.T.ravel())
    g, e = np.empty((q.shape[1], len(found)), np.float32), np.ascontiguousarray(e.T, np.float64)
    held = np.empty_like(e)
    for j, col in enumerate(np.ascontiguousarray(q.T, np.float64)):
        g[j] = np.bincount(place, np.multiply(e, col, out=held).ravel(), len(found))
    return found, g.T


def _step(m: dict, acc: dict, k: str, u: np.ndarray, g: np.ndarray, n: int) -> None:
    """Moves only the rows u that occur, by the sums g of their gradients."""
    g = np.divide(g, np.float32(n), order="C")
    a = acc[k].take(u, axis=0)
    a += g * g
    acc[k][u] = a
    g *= RATE
    g /= np.sqrt(a, out=a)
    w = m[k].take(u, axis=0)
    w -= g
    m[k][u] = w


def _draw(vocab: Vocabulary, k: np.ndarray, rng) -> np.ndarray:
    """MEMBER_NOISE members (rows) of each token's spelling class k, by share."""
    low = vocab.start[k]
    x = rng.random((MEMBER_NOISE, len(k))) * (vocab.start[k + 1] - low)
    at = x.astype(np.int64)
    x -= at
    at += low
    return np.where(x < vocab.keep[at], at, vocab.other[at])


def _input_sums(inputs: np.ndarray, dq: np.ndarray, pos: np.ndarray, start: np.ndarray):
    """What each input row gets back from the next token, the one after it, and (by the mean) all later ones of its text; as _sums of these."""
    n, d = dq.shape
    found, place = _places(inputs)
    size = np.diff(np.append(start, n))
    g = np.empty((3 * d, len(found)), np.float32)
    dq = np.ascontiguousarray(dq.T, np.float64)
    later = np.cumsum(dq * np.where(pos > 0, 1 / np.maximum(pos, 1), 0), axis=1)
    later = np.subtract(np.repeat(later[:, start + size - 1], size, axis=1), later, out=later)
    # the rows to which a token gives by distance; a place behind the last takes what has none
    to = []
    for back in (1, 2):
        x = np.full(n, len(found))
        x[back:] = place[: n - back]
        x[pos < back] = len(found)
        to.append(x)
    for j in range(d):
        g[j] = np.bincount(to[0], dq[j], len(found) + 1)[:-1]
        g[d + j] = np.bincount(to[1], dq[j], len(found) + 1)[:-1]
        g[2 * d + j] = np.bincount(place, later[j], len(found))
    return found, g.T


def train(m: dict, acc: dict, vocab: Vocabulary, ids: np.ndarray, member: np.ndarray, row: np.ndarray, rng) -> None:
    """One NCE step on whole texts, with noise classes shared by the batch; changes m and acc."""
    size, n = vocab.size, len(ids)
    inputs = _inputs(ids, member)
    q, pos, start = _context(m, inputs, row)
    q1 = _one(q)
    noise = rng.choice(size, NOISE, p=vocab.noise)
    bias = m["b"] - np.log(NOISE * vocab.noise).astype(np.float32)
    rt = m["R"].take(ids, axis=0)
    e = (1 / (1 + np.exp(-(np.einsum("ij,ij->i", q, rt) + bias[ids]))) - 1).astype(np.float32)
    dq = rt
    dq *= e[:, None]
    gr, at, e = np.empty((DIM + 1, size)), ids.astype(np.int64, copy=False), e.astype(np.float64)
    for j, col in enumerate(np.ascontiguousarray(q1.T, np.float64)):
        gr[j] = np.bincount(at, e * col, size)
    rn = m["R"][noise]
    to_noise, back = -LOG2E * np.concatenate((rn.T, bias[noise][None])), np.zeros((DIM + 1, NOISE), np.float32)
    for s in range(0, n, SCORE_ROWS):
        t = q1[s : s + SCORE_ROWS]
        en = t @ to_noise
        np.exp2(en, out=en)
        en += 1
        np.reciprocal(en, out=en)
        dq[s : s + SCORE_ROWS] += en @ rn
        back += t.T @ en
    u, g = _sums(noise, back.T)
    gr[:, u] += g.T
    # members: noise of the token's own class, by share
    t = np.flatnonzero(member >= 0)
    qt = q1.take(t, axis=0)
    both = np.concatenate((member[t][None], _draw(vocab, ids[t] - 1 - WORDS, rng)))
    r2 = m["R2"].take(both, axis=0)
    e2 = (1 / (1 + np.exp(vocab.member_shift[both] - np.einsum("jik,ik->ji", r2, qt)))).astype(np.float32)
    e2[0] -= 1
    dq[t] += np.einsum("ji,jik->ik", e2, r2)[:, :DIM]
    for k, x in {"R": gr[:DIM].T, "b": gr[DIM]}.items():
        x = x / n
        acc[k] += x * x
        m[k] -= (RATE * x / np.sqrt(acc[k])).astype(np.float32)
    _step(m, acc, "E", *_input_sums(inputs, dq, pos, start), n)
    if len(t):
        _step(m, acc, "R2", *_outer_sums(both.T, e2.T, qt), n)


def _batched(batches, vocab: Vocabulary):
    """(ids, member, row) of whole texts, at least BATCH tokens at a time."""
    have, mems, rows, size, base = [], [], [], 0, 0
    for b in batches:
        for p in pieces(b, "text"):
            h, c, row = tokens(*text_bytes(p.column("text")))
            ids, member, _, _ = vocab.look(h, c)
            cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True])))
            s = 0
            for e in cut[1:]:
                if size + e - s >= BATCH or e == cut[-1]:
                    have.append(ids[s:e]), mems.append(member[s:e]), rows.append(row[s:e] + base)
                    size += e - s
                    s = e
                    if size >= BATCH:
                        yield np.concatenate(have), np.concatenate(mems), np.concatenate(rows)
                        have, mems, rows, size = [], [], [], 0
            base += p.num_rows
    if size:
        yield np.concatenate(have), np.concatenate(mems), np.concatenate(rows)


def _pack(m: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate([m[k].ravel() for k in _TABLES]).tobytes()], pa.binary())], names=["n", "m"])


def _unpack(raw: bytes, vocab: Vocabulary) -> dict:
    v, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k, shape in vocab.shapes().items():
        n = int(np.prod(shape))
        out[k], at = v[at : at + n].reshape(shape).copy(), at + n
    return out


def _trainer(m: dict, vocab: Vocabulary, epochs: int):
    def run(batches):
        own = {k: v.copy() for k, v in m.items()}
        acc = {k: np.full(v.shape, 1e-3 if epochs == 1 else 1e-6, np.float32) for k, v in m.items()}
        rng, n = np.random.default_rng(TaskContext.get().partitionId()), 0
        if epochs > 1:  # a bounded number of documents
            kept = list(_batched(batches, vocab))
            for _ in range(epochs):
                for i in rng.permutation(len(kept)):
                    train(own, acc, vocab, *kept[i], rng)
            n = sum(len(x[0]) for x in kept)
        else:
            for x in _batched(batches, vocab):
                train(own, acc, vocab, *x, rng)
                n += len(x[0])
        if n:
            yield _pack(own, n)

    return run


def _average(batches):
    n, total = 0, None
    for b in batches:
        for k, raw in zip(b.column("n").to_pylist(), b.column("m").to_pylist(), strict=True):
            v = np.frombuffer(raw, np.float32).astype(np.float64) * k
            n, total = n + k, v if total is None else total + v
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "m"])


def log_probs(m: dict, vocab: Vocabulary, ids: np.ndarray, member: np.ndarray, row: np.ndarray) -> np.ndarray:
    """log10 probability of each token's class, normalised over all classes, and of its member, over those of the class."""
    inputs, q = _inputs(ids, member), np.empty((len(ids), DIM), np.float32)
    ends = np.append(np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), row[1:] != row[:-1]))), len(row))
    cut = np.unique(ends[np.searchsorted(ends, np.append(np.arange(0, len(row), BATCH), len(row)))])  # whole texts, few at a time: their vectors stay in the cache
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        q[s:e] = _context(m, inputs[s:e], row[s:e])[0]
    rt = np.concatenate((m["R"], m["b"][:, None]), axis=1) * LOG2E
    q = _one(q)
    ones = np.ones(len(m["R"]), np.float32)
    out = np.empty(len(ids), np.float64)
    held = np.empty((SCORE_ROWS, len(m["R"])), np.float32)
    for s in range(0, len(ids), SCORE_ROWS):
        t = q[s : s + SCORE_ROWS]
        x = np.matmul(t, rt.T, out=held[: len(t)])
        own = x[np.arange(len(x)), ids[s : s + SCORE_ROWS]].astype(np.float64)
        np.exp2(x, out=x)
        out[s : s + SCORE_ROWS] = own - np.log2(x @ ones)
    inside = np.flatnonzero(member >= 0)
    inside = inside[_order(ids[inside])]
    cut = np.searchsorted(ids[inside], 1 + WORDS + np.arange(CLASSES + 1))
    for k in range(CLASSES):
        low, high = vocab.start[k], vocab.start[k + 1]
        rt, ones = m["R2"][low:high] * LOG2E, np.ones(high - low, np.float32)
        rows = max(1, SCORE_ROWS * 384 // (high - low))  # holds memory down in large classes
        for s in range(cut[k], cut[k + 1], rows):
            t = inside[s : min(s + rows, cut[k + 1])]
            x = q.take(t, axis=0) @ rt.T
            own = x[np.arange(len(t)), member[t] - low].astype(np.float64)
            np.exp2(x, out=x)
            out[t] += own - np.log2(x @ ones)
    return out * np.log10(2)


def _scorer(m: dict, vocab: Vocabulary):
    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for p in pieces(batch, "text"):
                n = p.num_rows
                h, cls, row = tokens(*text_bytes(p.column("text")))
                ids, member, c, own = vocab.look(h, cls)
                held = c >= 0
                log = np.log10(np.maximum(c, 0) + 0.5)
                rare = ~own & (member == vocab.start[cls + 1] - 1)
                lp = log_probs(m, vocab, ids, member, row) + np.where(rare, np.where(held, log, 0) - vocab.in_rest[cls], 0)
                base = np.where(held, log, 0) - vocab.base_z
                rest = ~held & ~own
                r, w = row[rest], h[rest]
                order = np.lexsort((w, r))
                r, w = r[order], w[order]
                new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])))) if len(r) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(r))).astype(np.int32)
                cut = np.searchsorted(r[new], np.arange(n + 1)).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(cut), pa.array(v))  # noqa: E731, B023
                base += np.where(own & ~held, np.log10(0.5), 0)  # an end that training has not seen
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((part << 33) + at + np.arange(n)), p.column("id"), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[held], minlength=n)),
                        pa.array(np.bincount(row, base, n)), pa.array(np.bincount(row, lp, n)), lists(w[new].view(np.int64)), lists(tf),
                    ],
                    names=["rid", "id", "n_tokens", "n_known", "base", "score", "h", "tf"],
                )
                at += n

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, min_count: int = MIN_COUNT) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Texts are lower-cased (A-Z) and cut at white space; every text ends with one end token. Held out are
    ids whose crc32 mod 5 is 1; null ids are not. Null or empty texts are the end alone. base_score is the
    smoothed unigram score, score the neural model's, in which the sqrt(training tokens) most frequent words, if seen `min_count` times, have their own vectors. Rows that repeat id or text are rows like
    others. Other columns are ignored; an empty table gives no rows. Words are compared by 64-bit hash.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(d.dtypes)["id"]
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 1, F.lit(False))
    learn = d.where(~held)
    counts = learn.select("text").mapInArrow(_counter, "h long, cls int, c long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))
    counts = materialize(counts, "counts")
    step = F.floor(F.log2("c") * 64)
    steps = sorted(((int(r.k), int(r.n), int(r.v), int(r.low)) for r in counts.groupBy(step.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.min("c").alias("low")).collect()), reverse=True)  # some thousand rows at any size
    n, v = sum(x[1] for x in steps), sum(x[2] for x in steps)
    top, least, held = max(top, WORDS + 1, int(n**0.5)), max(1, int(n**0.5)), 0
    low = steps[0][3] if steps else 1
    for _, _, words, c in steps:  # as many whole steps of the counts as fit into the top
        held += words
        if held > top and low < steps[0][3]:
            break
        low = c
    most = sorted(((r.h, r.c, r.cls) for r in counts.where(F.col("c") >= low).collect()), key=lambda x: (-x[1], x[0]))
    least = max(min_count, most[min(least, len(most)) - 1][1] if most else 1)
    end = int(END.view(np.int64))
    if all(h != end for h, _, _ in most):  # every text ends with it, so its count is always held
        most += [(r.h, r.c, r.cls) for r in counts.where(F.col("h") == end).collect()]
    classes = {r.cls: [int(r.n), int(r.v)] for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # CLASSES rows
    own = [x for x in most if np.int64(x[0]).view(np.uint64) != END][:WORDS] + [x for x in most if np.int64(x[0]).view(np.uint64) == END]
    for _, c, k in own:
        classes[k][0] -= c
        classes[k][1] -= 1
    vocab = Vocabulary([(h, c) for h, c, _ in most], n, v, {k: tuple(x) for k, x in classes.items()}, [k for _, _, k in most], least)
    model = start_model(vocab)
    if n:
        first = learn.where("id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(START_DOCS)
        got = learn.join(F.broadcast(first), "id", "left_semi").select("text").repartition(1).mapInArrow(_trainer(model, vocab, START_EPOCHS), "n long, m binary").collect()
        model = _unpack(bytes(got[0].m), vocab) if got else model
        copies = max(d.sparkSession.sparkContext.defaultParallelism, int(n**0.5) // COPY_WORDS)
        each = learn.select("text").coalesce(copies).mapInArrow(_trainer(model, vocab, 1), "n long, m binary")
        wide = max(1, int(copies**0.5))
        each = each.repartition(wide).mapInArrow(_average, "n long, m binary").repartition(1).mapInArrow(_average, "n long, m binary")
        model = _unpack(bytes(each.collect()[0].m), vocab)
    rows = materialize(d.mapInArrow(_scorer(model, vocab), f"rid long, id {kind}, n_tokens long, n_known long, base double, score double, h array<long>, tf array<int>"), "scored")
    rare = rows.select("rid", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("rid", F.col("x.h").alias("h"), F.col("x.tf").alias("tf"))
    seen = counts if len(most) < v else counts.limit(0)
    seen = seen.select("h", "c")
    log = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    more = rare.join(seen, "h", "left").groupBy("rid").agg(F.sum(log).alias("log"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"))
    out = rows.drop("h", "tf").join(more, "rid", "left")
    zero = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("log", zero)).alias("base_score"), (F.col("score") + F.coalesce("log", zero)).alias("score"),
    )
