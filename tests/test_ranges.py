"""Orders in ranges: equity, places, previous values, blocks and lags, with as few rows a range as two."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookglass.operators import evaluation, ranges, research, series


def test_two_losing_trades_fall_by_one(spark):
    rows = [(0, 1, -1.0, 1.0), (0, 2, -1.0, 1.0)]
    df = spark.createDataFrame(rows, "month int, sample_id long, y double, p1 double")
    assert evaluation.backtest(df, 1.0, [0.0]).first()["max_drawdown"] == -1.0
    idle = df.unionByName(spark.createDataFrame([(0, 0, 5.0, 0.0)], df.schema))  # equity 0 before the first trade
    assert evaluation.backtest(idle, 1.0, [0.0]).first()["max_drawdown"] == -2.0
    assert research.threshold_trades(df, 0.5, cost_bps=0.0).first()["max_drawdown"] == -1.0
    assert research.threshold_trades(idle, 0.5, cost_bps=0.0).first()["max_drawdown"] == -2.0


@pytest.mark.parametrize("rows", [2, 7, 1000])
def test_equity_equals_a_plain_walk(spark, rows):
    rng = np.random.default_rng(rows)
    pnl, zero = rng.normal(size=60), rng.random(3) < 0.5
    data = [(k, int(i) % 5, int(i), float(pnl[i]), bool(zero[k])) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(data, "g int, month int, sample_id long, pnl double, z boolean")
    got = {(r["g"], r["sample_id"]): r for r in ranges.equity_curve(df, ["g"], ["month", "sample_id"], from_zero="z", rows=rows).collect()}
    for k in range(3):
        equity, peak = 0.0, 0.0 if zero[k] else -np.inf
        for i in sorted(range(60), key=lambda i: (i % 5, i)):
            equity += pnl[i]
            peak = max(peak, equity)
            r = got[k, i]
            assert np.allclose([r["equity"], r["peak"], r["drawdown"]], [equity, peak, equity - peak])


def test_places_thinning_and_previous_rows(spark):
    df = spark.createDataFrame([(int(i), float(i * i)) for i in np.random.default_rng(1).permutation(50)], "k long, v double")
    assert [r["pos"] for r in ranges.numbered(df, ["k"], rows=6).orderBy("k").collect()] == list(range(50))
    at = [r["pos"] for r in ranges.thinned(df, ["k"], 21, rows=6).orderBy("pos").collect()]
    assert at == sorted(set(np.linspace(0, 49, 21).round().astype(int).tolist())) and at[0] == 0 and at[-1] == 49
    assert ranges.thinned(df, ["k"], 50, rows=6).count() == 50
    before = {r["k"]: r["b"] for r in ranges.with_previous(df, ["k"], {"b": "v"}, rows=6).collect()}
    assert before == {i: None if i == 0 else float((i - 1) ** 2) for i in range(50)}
    assert ranges.thinned(df.limit(0), ["k"], 3).count() == 0


def test_one_size_of_prediction_is_many_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(0, i, 1.0, 0.5) for i in range(40)], "month int, sample_id long, y double, p1 double")
    monkeypatch.setattr(ranges, "ROWS", 5)
    d = ranges.ranged(df.withColumn("s", F.abs("p1")), ["s", "sample_id"], 5)
    assert d.groupBy("range").count().agg(F.max("count")).first()[0] < 20
    assert [r["rank"] for r in evaluation.ranked_signals(df).orderBy("sample_id").collect()] == list(range(1, 41))


def test_no_trade_gives_a_row_of_zeros(spark):
    df = spark.createDataFrame([(0, i, 1.0, 0.0) for i in range(4)], "month int, sample_id long, y double, p1 double")
    out = evaluation.backtest(df, 0.5).collect()
    assert len(out) == 4 and all(r["trades"] == 0 and r["turnover"] == r["sharpe"] == r["max_drawdown"] == 0.0 for r in out)
    assert {r["trades"] for r in evaluation.fraction_sweep(df).collect()} == {0}


def plain_blocks(x, months, size, within):
    v = np.where(x > 0, np.log(np.where(x > 0, x, 1)), np.nan)
    if within:
        v = v - np.array([np.nanmean(v[months == m]) for m in months])
    means = [np.nanmean(b) for k in range(0, len(v), size) if np.isfinite(b := v[k : k + size]).any()]
    return len(means), np.corrcoef(means[1:], means[:-1])[0, 1] if len(means) >= 3 else None


@pytest.mark.parametrize("within", [False, True])
def test_blocks_of_the_whole_order(spark, within):
    rng = np.random.default_rng(2)
    n = 400
    months = np.sort(rng.integers(0, 4, n))
    x = np.exp(np.cumsum(rng.normal(size=n)) * 0.3)
    x[60:80], x[5] = 0.0, -1.0
    df = spark.createDataFrame([(int(months[i]), int(i * 3), float(x[i])) for i in range(n)], "month int, sample_id long, x double")
    got = {r["block"]: r for r in series.block_autocorrelations(df, "x", (2, 10, 100, 200), within=within, span=90, rows=7).collect()}
    for size, r in got.items():
        blocks, want = plain_blocks(x, months, size, within)
        assert r["n_blocks"] == blocks and (r["autocorr"] is None if want is None else abs(r["autocorr"] - want) < 1e-9) and abs(r["noise_se"] - blocks**-0.5) < 1e-12
        # A month of one block leaves nothing to expect.
        assert r["expected"] is None if not within or size == 100 else abs(r["expected"] + 1 / (n / 4 / size - 1)) < 1e-12
    with pytest.raises(ValueError):
        series.block_pyramid(df, "x", (10, 15))


def test_order_shows_and_shuffling_hides_it(spark):
    rng = np.random.default_rng(9)
    regime = np.repeat(rng.normal(size=60), 20)
    for x, high in ((np.exp(regime), True), (np.exp(rng.permutation(regime)), False)):
        df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "month int, sample_id long, x double")
        r = series.block_autocorrelations(df, "x", (5,)).first()
        assert (r["autocorr"] > 0.6) is high and (abs(r["autocorr"]) < 4 * r["noise_se"]) is not high


def test_lags_cross_months_and_chunks(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=120)
    df = spark.createDataFrame([(i // 50, i, float(y[i])) for i in range(120)], "month int, sample_id long, y double")
    for r in series.lag_correlations(df, [1, 3, 25], chunk=10, span=13).collect():
        k = r["lag"]
        assert abs(r["r"] - np.corrcoef(y[k:], y[:-k])[0, 1]) < 1e-12
