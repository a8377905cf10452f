"""What the network of op8 learns from: every id of every text, and every step from leaf to leaf; and its gradient."""
import numpy as np
import pytest

from courtside.llm import lm_scoring


def _net():
    return lm_scoring.Attention(*lm_scoring.tree(np.arange(lm_scoring.VOCAB)[::-1].astype(float), np.arange(50)))


def test_learns_from_every_id(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([1, 12_210, 3, 589, 16, 17])
    ids = rng.integers(2, 40_000, sizes.sum()).astype(np.uint16)
    seen = []
    train = lm_scoring.Attention.train
    monkeypatch.setattr(lm_scoring, "PART", 200)
    monkeypatch.setattr(lm_scoring.Attention, "train", lambda self, x, y, steps, lanes, **k: seen.append((x, y, steps * lanes >= len(x))) or train(self, x, y, 1, lanes=lanes, **k))
    net = _net()
    windows = int((-(-sizes // lm_scoring.WIDTH)).sum())
    assert net.learn(ids, sizes, rate=0.004, seed=1) == windows
    assert all(whole for _, _, whole in seen) and len(seen) > 1
    # each id is a target once, after the ids before it in its window
    x, y = (np.concatenate([s[k] for s in seen]) for k in (0, 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    want_x, want_y = [], []
    for a, b in zip(starts, starts[1:]):
        leaf = net.leaf_of[ids[a:b]].tolist()
        for i in range(0, b - a, lm_scoring.WIDTH):
            want_y.append(leaf[i : i + lm_scoring.WIDTH])
            want_x.append([leaf[i - 1] if i else lm_scoring.LEAVES, *want_y[-1][:-1]])
    assert [r[r >= 0].tolist() for r in y] == want_y
    assert [r[: len(w)].tolist() for r, w in zip(x, want_x)] == want_x


def test_steps_from_leaf_to_leaf():
    leaf = np.arange(lm_scoring.VOCAB) % lm_scoring.LEAVES
    got = lm_scoring.follows(leaf, np.array([5, 6, 7, 5, 6]), np.array([3, 2])).reshape(lm_scoring.LEAVES, -1)
    assert got.sum() == 3 and got[5, 6] == 2 and got[6, 7] == 1


def test_gradient_of_attention():
    net = _net()
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    net.mask = net.mask.astype(float)
    rng = np.random.default_rng(2)
    y = rng.integers(0, lm_scoring.LEAVES, (5, lm_scoring.WIDTH)).astype(np.int16)
    x = np.concatenate([np.full((5, 1), lm_scoring.LEAVES, np.int16), y[:, :-1]], 1)
    y[3, 9:] = -1
    _, g = net.gradient(x, y)
    for key, at in (("e", (int(x[0, 3]), 2)), ("e", (lm_scoring.LEAVES, 1)), ("p", (4, 3)), ("qkv", (2, 5)), ("qkv", (3, 17)), ("qkv", (1, 30)), ("o", (1, 2)), ("x", (4, 0)), ("b", (3,)), ("c1", (2, 7)), ("b1", (9,)), ("c2", (int(y[0, 0]) // 32, 4, int(y[0, 0]) % 32)), ("b2", (int(y[1, 1]) // 32, 3))):
        w, loss = net.w[key], []
        for step in (1e-4, -2e-4):
            w[at] += step
            loss.append(net.gradient(x, y)[0])
        w[at] += 1e-4
        assert g[key][at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=1e-3, abs=1e-7), key
    # the loss is that of the scores
    logs, _ = net.leaf_logs(x, y)
    assert net.gradient(x, y)[0] == pytest.approx(-logs.mean())
