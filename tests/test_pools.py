"""Descriptions by the first pool's and by the own pool's regimes, against numpy."""

import numpy as np
import pytest

from bookglass.operators.audit import FLOOR
from bookglass.operators.pools import pool_regimes

SIGNALS = ["depth", "spread"]
POOLS = ["train", "val", "test"]


@pytest.fixture(scope="module")
def rows():
    dice = np.random.default_rng(1)
    out = []
    for p, name in enumerate([*POOLS, "other", None]):
        for i in range(120):
            at = [(1.0, 1.0), (50.0, 1.0), (1.0, 80.0)][i % 3 if i < 90 else 0]
            depth, spread = (float(v * (2 + p) * np.exp(dice.normal() * 0.05)) for v in at)
            out.append((p * 1000 + i, name, None if i % 40 == 7 else depth, -5.0 if i % 50 == 11 else spread))
    return out


def test_static_and_own_regimes(spark, rows):
    df = spark.createDataFrame(rows, "sample_id long, pool string, depth double, spread double").repartition(4)
    got = pool_regimes(df, POOLS, SIGNALS, k=3).collect()
    found = {(r.sample_id, r.variant): r for r in got}
    given = {r[0]: r for r in rows if r[1] in POOLS}
    assert len(got) == len(found) == 2 * len(given)
    with np.errstate(invalid="ignore"):
        logs = {p: np.log(np.array([[np.nan if v is None else v for v in r[2:]] for r in given.values() if r[1] == p]) + FLOOR) for p in POOLS}
    for variant in ("static", "own"):
        for p in POOLS:
            fit = p if variant == "own" else "train"
            fill = np.nanmedian(logs[fit], axis=0)
            fitted, own = (np.where(np.isnan(logs[x]), fill, logs[x]) for x in (fit, p))
            mean, spread = fitted.mean(0), fitted.std(0)
            learned = [found[i, "own"] for i, r in given.items() if r[1] == fit]
            labels = np.array([r.regime for r in learned])
            centres = np.array([fitted[labels == j].mean(0) for j in range(3)])  # groups are far apart: the fit has settled
            shares = [np.mean(labels == j) for j in range(3)]
            assert sorted(shares, reverse=True) == shares
            dist = np.sqrt((((own[:, None] - centres) / spread) ** 2).sum(2))
            for r, d in zip([found[i, variant] for i, x in given.items() if x[1] == p], dist, strict=True):
                assert r.pool == p and r.regime == d.argmin() and np.isclose(r.regime_dist, d.min(), atol=1e-6)
                assert np.allclose([r.centre_depth, r.centre_spread], centres[r.regime], atol=1e-6) and np.isclose(r.regime_share, shares[r.regime])
    for i, r in given.items():
        if r[1] == "train":
            assert found[i, "static"][3:] == found[i, "own"][3:]
    assert any(found[i, "static"].regime_dist > found[i, "own"].regime_dist + 0.1 for i in given)


def test_pools_without_rows(spark, rows):
    df = spark.createDataFrame(rows, "sample_id long, pool string, depth double, spread double")
    assert {r.pool for r in pool_regimes(df, ["val", "nowhere"], SIGNALS, k=3).select("pool").distinct().collect()} == {"val"}
    with pytest.raises(ValueError, match="nowhere"):
        pool_regimes(df, ["nowhere", "val"], SIGNALS)
