"""Operators of evaluation without SQL, against brute force."""

import hashlib
import math

import numpy as np
import pytest

from bookglass.operators import evaluation as ev


def starts(n, length, draw, seed):
    """The draw's slots: each block's start is told by the md5 of seed, length, draw and block."""
    out = []
    for block in range(-(-n // length)):
        h = int(hashlib.md5(f"{seed}:{length}:{draw}:{block}".encode()).hexdigest()[:12], 16)
        out += [(h % n + k) % n for k in range(length)]
    return out[:n]


def test_block_bootstrap_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for month in range(11):  # neighbouring months are alike
        for _ in range(6):
            y = float(rng.normal())
            rows.append((month, y, y * math.sin(month / 2) + float(rng.normal()), y + float(rng.normal())))
    df = spark.createDataFrame(rows, "month int, y double, p1 double, p2 double")
    score = {m: [] for m in ("p1", "p2")}
    for month in range(11):
        y, p1, p2 = np.array([r[1:] for r in rows if r[0] == month]).T
        for m, p in (("p1", p1), ("p2", p2)):
            score[m].append(y @ p / np.sqrt((y @ y) * (p @ p)))
    got = {(r.model, r.block_length): r for r in ev.block_bootstrap(df, blocks=(1, 2, 4), draws=300).collect()}
    assert sorted(got) == [(m, b) for m in ("p1", "p2") for b in (1, 2, 4)]
    for (m, b), r in got.items():
        v, delta = np.array(score[m]), np.array(score[m]) - np.array(score["p1"])
        at = np.array([starts(11, b, d, 42) for d in range(300)])
        assert ((at[:, 1] - at[:, 0]) % 11 == 1).all() or b == 1
        want = [v.mean(), *np.quantile(v[at].mean(axis=1), [0.025, 0.975]), delta.mean(), *np.quantile(delta[at].mean(axis=1), [0.025, 0.975])]
        assert np.allclose([r.mean_cosine, r.interval_low, r.interval_high, r.paired_delta, r.delta_low, r.delta_high], want)
        assert (r.wins_vs_reference, r.periods, r.draws) == ((delta > 0).sum(), 11, 300)
    with pytest.raises(ValueError):
        ev.block_bootstrap(df.where("month != 4"))
