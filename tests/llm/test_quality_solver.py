"""The dual coordinate descent against another minimiser of the same objective."""

import numpy as np
import pytest

from bookglass.llm import quality


def problem(seed, n=80, d=30):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(np.int64)
    y[:2] = 0, 1
    xs = []
    for i in range(n):
        p = np.full(d, 0.3)
        p[: d // 3] += 0.35 if y[i] else -0.2
        xs.append(np.flatnonzero(rng.random(d) < p).astype(np.int32))
    return xs, y


def values_of(xs, y, train):
    """(rows of scaled indicators, log-count ratios), by plain counting."""
    d = max(int(x.max()) for x in xs if len(x)) + 1
    count = {c: np.array([quality.SMOOTHING + sum(f in xs[i] for i in train if y[i] == c) for f in range(d)]) for c in (0, 1)}
    ratio = np.log((count[1] / (count[1].sum() + quality.SMOOTHING * (quality.DIMENSIONS - d))) / (count[0] / (count[0].sum() + quality.SMOOTHING * (quality.DIMENSIONS - d))))
    ratio[count[0] + count[1] <= 2 * quality.SMOOTHING + 1] = 0
    v = np.zeros((len(xs), d))
    for i, x in enumerate(xs):
        v[i, x] = ratio[x] / max(1.0, len(x) ** 0.5)
    return v, ratio


def objective(w, bias, v, sign, cost):
    slack = np.maximum(0, 1 - sign * (v @ w + bias))
    return 0.5 * (w @ w + bias * bias) + quality.PENALTY * (cost * slack**2).sum()


def minimised(v, sign, cost):
    """The least objective and its weights, by Newton's steps on the primal (its Hessian is that of the rows with slack)."""
    a = np.column_stack([v, np.ones(len(v))])
    w = np.zeros(a.shape[1])
    for _ in range(200):
        slack = 1 - sign * (a @ w)
        on = slack > 0
        grad = w - 2 * quality.PENALTY * (a[on].T @ (cost[on] * sign[on] * slack[on]))
        hess = np.eye(len(w)) + 2 * quality.PENALTY * (a[on].T * cost[on]) @ a[on]
        step = np.linalg.solve(hess, grad)
        size = 1.0
        value = objective(w[:-1], w[-1], v, sign, cost)
        while objective((w - size * step)[:-1], (w - size * step)[-1], v, sign, cost) > value + 1e-15 and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-12:
            break
    return w[:-1], w[-1]


@pytest.mark.parametrize("seed", range(4))
def test_the_fit_reaches_the_least_objective(monkeypatch, seed):
    monkeypatch.setattr(quality, "LEAN", 0.0)
    monkeypatch.setattr(quality, "PASSES", 3000)
    xs, y = problem(seed)
    model = quality.fit(xs, y)
    train = [i for i in range(len(y)) if i % 5 != 4]
    v, ratio = values_of(xs, y, train)
    v, sign = v[train], np.where(y[train] > 0, 1.0, -1.0)
    cost = np.where(y[train] > 0, 1.0, (y[train] > 0).sum() / (y[train] == 0).sum())
    w, bias = minimised(v, sign, cost)
    got = np.divide(model.weights[: len(ratio)].astype(float), ratio, out=np.zeros(len(ratio)), where=ratio != 0)
    least = objective(w, bias, v, sign, cost)
    assert least <= objective(got, model.bias, v, sign, cost) + 1e-9
    assert objective(got, model.bias, v, sign, cost) <= least * (1 + 1e-5)
    assert np.allclose(v @ got + model.bias, v @ w + bias, atol=5e-3) and not model.weights[len(ratio) :].any()
