"""Scaled metrics, exact quantiles, Gram sums, fits, verdicts, thresholds and batch scoring against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookglass.operators import evaluation as ev
from bookglass.operators import research as rs


def frame(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in zip(*cols.values(), strict=True)], ", ".join(f"{n} double" if n not in ("month", "sample_id") else f"{n} long" for n in names))


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e200])
def test_metrics_hold_at_extreme_scales(spark, scale):
    y, p = np.array([1.0, -2.0, 3.0]) * scale, np.array([2.0, -1.0, 2.0]) * scale
    r = ev.metrics(frame(spark, y=y, p1=p), []).first()
    a, b = y / scale, p / scale
    assert math.isclose(r.cosine, a @ b / math.sqrt((a @ a) * (b @ b)), rel_tol=1e-12)
    assert math.isclose(r.rmse, scale * math.sqrt(np.mean((a - b) ** 2)), rel_tol=1e-12) and r.direction == 1.0
    assert ev.metrics(frame(spark, y=y, p1=p * 0), []).first().cosine == 0.0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 5000])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 2 if n > 1000 else 6)
    qs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.999, "e": 1.0}
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    r = ev.exact_quantiles(df, "x", qs).first()
    for k, q in qs.items():
        assert r[k] is None if n == 0 else math.isclose(r[k], np.quantile(x, q), rel_tol=1e-12, abs_tol=1e-15)


def test_correlations_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 40)) * 1e-3 + 1e4
    x[:, 3] = 7.0
    names = [f"f{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    got = {(r.a, r.b): r.r for r in ev.correlation_pairs(df, names).collect()}
    with np.errstate(all="ignore"):
        want = np.nan_to_num(np.abs(np.corrcoef(x.T)))
    assert len(got) == 40 * 39 // 2
    assert all(math.isclose(v, want[int(a[1:]), int(b[1:])], abs_tol=1e-6) for (a, b), v in got.items())


def test_non_negative_blend_drops_a_harmful_model():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -0.7, 0.4] + rng.normal(size=200) * 0.1
    w = rs.non_negative(x.T @ x, x.T @ y)
    assert w[1] == 0 and (w >= 0).all()
    best = min((((y - x[:, [0, 2]] @ v) ** 2).sum() for v in [rs.least_squares(x[:, [0, 2]].T @ x[:, [0, 2]], x[:, [0, 2]].T @ y)]))
    assert math.isclose(((y - x @ w) ** 2).sum(), best, rel_tol=1e-9)


def test_thresholds_and_the_zero_trade_row(spark):
    y, p = np.array([0.01, -0.02, 0.03, 0.01]), np.array([0.5, 0.1, -0.4, 0.0])
    df = frame(spark, y=y, p1=p, month=np.array([0, 0, 1, 1]), sample_id=np.arange(4))
    r = rs.threshold_trades(df, threshold=0.1, cost_bps=0.0).first()
    assert (r.trades, r.turnover) == (2, 0.5) and math.isclose(r.total, 0.01 - 0.03) and math.isclose(r.max_drawdown, -0.03) and r.win_rate == 0.5
    z = rs.threshold_trades(df, threshold=9.0).first()
    assert z.trades == 0 and all(v == 0 for k, v in z.asDict().items() if k != "threshold")


def test_verdict_and_trend(spark):
    g = np.array([0.01, 0.012, 0.008, 0.011, 0.009, 0.013])
    r = rs.paired_verdict(frame(spark, g=g), F.col("g")).first()
    half = 2.570582 * g.std(ddof=1) / math.sqrt(6)
    assert math.isclose(r.t_low, g.mean() - half, abs_tol=1e-5) and r.adds and r.worth_keeping and r.free and r.improved == 6
    x, v = np.arange(10.0), np.arange(10.0) * 0.5 + np.array([0.1, -0.1] * 5)
    t = rs.trend(frame(spark, x=x, v=v), "x", "v").first()
    fit = np.polyfit(x, v, 1)
    se = math.sqrt(((v - np.polyval(fit, x)) ** 2).sum() / 8 / ((x - x.mean()) ** 2).sum())
    assert math.isclose(t.slope, fit[0]) and math.isclose(t.se, se, rel_tol=1e-9)


def test_batch_scoring_names_what_is_missing(spark):
    df = frame(spark, sample_id=np.arange(3), a=np.array([1.0, -1.0, 0.0]), extra=np.ones(3))
    got = rs.score_batch(df, {"m": {"a": 2.0}}, {"m": 0.5}).orderBy("sample_id").collect()
    assert [(r.part_m, r.blend, r.direction) for r in got] == [(1.0, 1.0, "UP"), (-1.0, -1.0, "DOWN"), (0.0, 0.0, "FLAT")]
    with pytest.raises(ValueError, match="b"):
        rs.score_batch(df, {"m": {"b": 1.0}}, {"m": 1.0})
    with pytest.raises(ValueError, match="x"):
        rs.score_batch(df, {"m": {"a": 1.0}}, {"x": 1.0})
