"""A training step, the noise's draws and the lookup of words against plain loops."""

import numpy as np
import pytest

from gridweave.llm import lm


@pytest.fixture(scope="module")
def vocab():
    end, words = int(lm.END.view(np.int64)), lm.WORDS + 40
    top = [(i * 7919 - 500_000, 2000 - 5 * i) for i in range(words)] + [(end, 100)]
    cls = [i * i % 5 for i in range(words)] + [0]
    classes = {k: (sum(c for (_, c), x in zip(top[lm.WORDS : words], cls[lm.WORDS : words], strict=True) if x == k) + 50, 60) for k in range(5)}
    return lm.Vocabulary(top, 300_000, 900, classes, cls, 560)


def test_draws_come_up_by_share(vocab):
    n = np.diff(vocab.start)
    chance = np.zeros(vocab.members)
    for low, high in zip(vocab.start[:-1], vocab.start[1:], strict=True):
        for i in range(low, high):
            assert low <= vocab.other[i] < high
            chance[i] += vocab.keep[i] / (high - low)
            chance[vocab.other[i]] += (1 - vocab.keep[i]) / (high - low)
    assert vocab.members > lm.CLASSES + 20 and np.allclose(chance, vocab.share, atol=1e-12)
    k = np.repeat([0, 1, 7], 20_000)
    got = lm._draw(vocab, k, np.random.default_rng(3))
    assert got.shape == (lm.MEMBER_NOISE, len(k)) and ((got >= vocab.start[k]) & (got < vocab.start[k + 1])).all() and n[7] == 1
    seen = np.bincount(got[:, k == 1].ravel(), minlength=vocab.members) / (lm.MEMBER_NOISE * 20_000)
    inside = slice(vocab.start[1], vocab.start[2])
    assert np.allclose(seen[inside], vocab.share[inside], atol=0.01)


def test_words_are_found_by_hash(vocab):
    rng = np.random.default_rng(4)
    h = np.concatenate((vocab.h, rng.integers(0, 1 << 63, 500).astype(np.uint64), [np.uint64(0), ~np.uint64(0), lm.END]))
    cls = rng.integers(0, lm.CLASSES, len(h)).astype(np.int32)
    at = {int(x): i for i, x in enumerate(vocab.h[:-1])}
    ids, member, c, own = vocab.look(h, cls)
    for i, x in enumerate(h.tolist()):
        j = at.get(x)
        if j is None:
            assert (ids[i], member[i], c[i], own[i]) == (1 + lm.WORDS + cls[i], vocab.start[cls[i] + 1] - 1, -1, False)
        else:
            assert c[i] == vocab.c[j] >= 0 and own[i] == (ids[i] <= lm.WORDS) == (member[i] < 0)
            k = ids[i] - 1 - lm.WORDS
            assert own[i] or vocab.start[k] <= member[i] < vocab.start[k + 1]
    none = lm.Vocabulary([], 0, 0, {}, [])
    ids, member, c, own = none.look(np.array([5, lm.END], np.uint64), np.array([3, 0]))
    assert ids.tolist() == [1 + lm.WORDS + 3, 0] and member.tolist() == [3, -1] and c.tolist() == [-1, -1] and own.tolist() == [False, True]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 200])
def test_running_sums(n):
    x = np.random.default_rng(n).normal(size=(n, 3)).astype(np.float32)
    assert np.allclose(lm._running(x), np.concatenate((np.zeros((1, 3)), np.cumsum(x, axis=0))), atol=1e-4)


@pytest.mark.parametrize("sizes", [[1], [40], [1, 2, 30, 1, 3, 1], [600, 9]])
def test_a_step_equals_a_loop(vocab, monkeypatch, sizes):
    rng, d, n = np.random.default_rng(len(sizes)), lm.DIM, sum(sizes)
    at = rng.integers(0, len(vocab.h) - 1, n)
    ids, member, row = vocab.id[at], vocab.member[at], np.repeat(np.arange(len(sizes)), sizes)
    m = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in lm.start_model(vocab).items()}
    acc = {k: np.full(v.shape, 1e-3, np.float32) for k, v in m.items()}
    t = np.flatnonzero(member >= 0)
    wrong = lm._draw(vocab, ids[t] - 1 - lm.WORDS, rng)
    noise = np.random.default_rng(8).choice(vocab.size, lm.NOISE, p=vocab.noise)
    sig = lambda x: 1 / (1 + np.exp(-x))
    old = {k: v.astype(float) for k, v in m.items()}
    g = {k: np.zeros(v.shape) for k, v in m.items()}
    e = lm._inputs(ids, member)
    shift = np.log(lm.NOISE * vocab.noise)
    for i in range(n):
        first = int(np.flatnonzero(row == row[i])[0])
        parts = [(e[i - b], (b - 1) * d, 1.0) for b in (1, 2) if i - b >= first] + [(e[j], 2 * d, 1 / (i - first)) for j in range(first, i)]
        q = sum((old["E"][r, c : c + d] * w for r, c, w in parts), np.zeros(d))
        dq = np.zeros(d)
        for k, right in [(ids[i], 1), *((k, 0) for k in noise)]:
            x = sig(q @ old["R"][k] + old["b"][k] - shift[k]) - right
            g["R"][k] += x * q
            g["b"][k] += x
            dq += x * old["R"][k]
        if member[i] >= 0:
            for k, right in [(member[i], 1), *((k, 0) for k in wrong[:, np.searchsorted(t, i)])]:
                x = sig(old["R2"][k, :d] @ q + old["R2"][k, d] - np.log(lm.MEMBER_NOISE * vocab.share[k])) - right
                g["R2"][k] += x * np.append(q, 1)
                dq += x * old["R2"][k, :d]
        for r, c, w in parts:
            g["E"][r, c : c + d] += w * dq
    monkeypatch.setattr(lm, "_draw", lambda *_: wrong)
    lm.train(m, acc, vocab, ids, member, row, np.random.default_rng(8))
    for k, x in g.items():
        x = x / n
        want = old[k] - lm.RATE * x / np.sqrt(1e-3 + x * x)
        assert np.allclose(m[k], want, atol=1e-4), k
        assert np.allclose(acc[k], 1e-3 + x * x, atol=1e-5), k
