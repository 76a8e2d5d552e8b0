"""Gradient sums and contexts of the language model against plain loops."""

import numpy as np
import pytest

from gridweave.llm import lm


@pytest.mark.parametrize("most", [1, 7, 70_000, 1 << 20])
def test_sums_equal_a_loop(most):
    rng = np.random.default_rng(most)
    idx = rng.integers(0, most, (200, 5))
    e, q = rng.normal(size=(200, 5)).astype(np.float32), rng.normal(size=(200, 3)).astype(np.float32)
    want = {}
    for i in range(200):
        for j in range(5):
            want[idx[i, j]] = want.get(idx[i, j], 0) + e[i, j].astype(float) * q[i]
    for u, g in (lm._outer_sums(idx, e, q), lm._sums(idx.ravel(), (e[:, :, None] * q[:, None, :]).reshape(-1, 3))):
        assert list(u) == sorted(want)
        assert np.allclose(g, [want[k] for k in u], atol=1e-4)


def test_order_is_stable():
    idx = np.array([70_000, 3, 65_536, 3, 70_000, 0])
    assert list(lm._order(idx)) == [5, 1, 3, 2, 0, 4] and not len(lm._order(idx[:0]))


def test_scores_do_not_depend_on_how_texts_are_cut(monkeypatch):
    vocab = lm.Vocabulary([(int(lm.END.view(np.int64)), 50)] + [(i, 100 - i) for i in range(1, 40)], 4000, 40, {}, [0] * 40, 1000)
    m, rng = lm.start_model(vocab), np.random.default_rng(2)
    sizes = [1, 900, 1, 3, 250, 1]
    ids, row = rng.integers(0, 40, sum(sizes)).astype(np.int32), np.repeat(np.arange(len(sizes)), sizes)
    member = np.full(len(ids), -1)
    whole = lm.log_probs(m, vocab, ids, member, row)
    for size in (1, 2, 300):
        monkeypatch.setattr(lm, "BATCH", size)
        assert np.allclose(lm.log_probs(m, vocab, ids, member, row), whole, atol=1e-5)
    assert not len(lm.log_probs(m, vocab, ids[:0], member[:0], row[:0]))
