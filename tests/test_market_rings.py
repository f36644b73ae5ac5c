"""Market features from rings against a plain walk over each sample's rows: ties, empty levels, missing ages, rows beyond all windows, large prices."""

import math
import random
import statistics

import pytest
from pyspark.sql import Row

from bookglass.operators.features import market_features

WINDOWS = [5, 10, 60]
FIELDS = "ask_price_1 ask_volume_1 bid_price_1 bid_volume_1 ask_price_2 ask_volume_2 bid_price_2 bid_volume_2".split()


def snapshot(row_id, sample_id, age, ask=1.002, bid=1.0, trades=1, av=100, bv=300):
    return Row(row_id=row_id, sample_id=sample_id, seconds_before_predict=age, transaction_avgprice=1.001, transaction_volume=10 * trades, transaction_count=trades,
               ask_price_1=ask, ask_volume_1=av, bid_price_1=bid, bid_volume_1=bv, ask_price_2=ask + 0.001 if ask else 0.0, ask_volume_2=50, bid_price_2=bid - 0.001 if bid else 0.0, bid_volume_2=60)


def rows():
    dice = random.Random(5)
    out = []
    for sample in range(6):
        base = 1.0 if sample < 4 else 50_000.0  # deviations of a far smaller size than the values
        for _ in range(dice.choice([1, 2, 40])):
            age = dice.choice([0.0, 4.5, 5.0, 7.0, 7.0, 10.0, 33.0, 60.0, 90.0, None])
            mid = base + dice.random() * 1e-2
            out.append(snapshot(len(out), sample, age, 0.0 if dice.random() < 0.1 else mid + 1e-3, 0.0 if dice.random() < 0.1 else mid - 1e-3, dice.randrange(4), dice.randrange(1, 500), dice.randrange(1, 500)))
    out += [snapshot(1000, 7, 90.0), snapshot(1001, 7, 70.0)]  # in no window
    out += [snapshot(1010, 8, 3.0, ask=0.0), snapshot(1011, 8, 30.0, bid=0.0)]  # never two-sided
    out += [snapshot(1021, 9, 3.0, bid=0.9), snapshot(1020, 9, 3.0, bid=0.8), snapshot(1022, 9, 3.0, bid=0.7)]  # one instant
    return out


def plain(sample):
    live = lambda r: r.ask_price_1 > 0 and r.bid_price_1 > 0
    mid = lambda r: (r.ask_price_1 + r.bid_price_1) / 2
    seen = sorted((r for r in sample if live(r) and r.seconds_before_predict is not None), key=lambda r: (r.seconds_before_predict, r.row_id))
    out = {"mkt_n_snapshots": len(sample), "mkt_null_mid_share": sum(not live(r) for r in sample) / len(sample), "mkt_mid_last": mid(seen[0]) if seen else None, "mkt_last_valid_gap": seen[0].seconds_before_predict if seen else None}
    for w in WINDOWS:
        inside = [r for r in sample if r.seconds_before_predict is not None and r.seconds_before_predict <= w]
        mids = [mid(r) for r in inside if live(r)]
        depth = [(r.bid_volume_1 - r.ask_volume_1) / (r.bid_volume_1 + r.ask_volume_1) for r in inside if live(r)]
        start = [mid(r) for r in seen if r.seconds_before_predict <= w]
        out |= {f"mkt_mid_mean_{w}s": statistics.fmean(mids) if mids else None, f"mkt_mid_std_{w}s": statistics.stdev(mids) if len(mids) > 1 else None,
                f"mkt_depth_imb1_std_{w}s": statistics.stdev(depth) if len(depth) > 1 else None, f"mkt_mid_range_{w}s": max(mids) - min(mids) if mids else None,
                f"mkt_trade_volume_rate_{w}s": sum(r.transaction_volume for r in inside) / w, f"mkt_trade_count_rate_{w}s": sum(r.transaction_count for r in inside) / w,
                f"mkt_snapshot_rate_{w}s": len(inside) / w, f"mkt_mid_return_{w}s": mid(seen[0]) / start[-1] - 1 if start else None}
    return out


def test_rings_are_the_windows(spark):
    given = rows()
    schema = "row_id long, sample_id long, seconds_before_predict double, transaction_avgprice double, transaction_volume int, transaction_count int, " + ", ".join(f"{f} {'double' if 'price' in f else 'int'}" for f in FIELDS)
    got = {r.sample_id: r for r in market_features(spark.createDataFrame(given, schema).repartition(5), WINDOWS).collect()}
    assert set(got) == {r.sample_id for r in given}
    for sample, r in got.items():
        for name, want in plain([x for x in given if x.sample_id == sample]).items():
            if want is None:
                assert r[name] is None, (sample, name)
            else:
                assert r[name] is not None and math.isclose(r[name], want, rel_tol=1e-7, abs_tol=1e-12), (sample, name, r[name], want)


def test_no_rows(spark):
    schema = "row_id long, sample_id long, seconds_before_predict double, transaction_avgprice double, transaction_volume int, transaction_count int, " + ", ".join(f"{f} {'double' if 'price' in f else 'int'}" for f in FIELDS)
    assert market_features(spark.createDataFrame([], schema), WINDOWS).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_one_scan(spark, sf):
    from bookglass.plans.catalog import view

    plan = market_features(view(spark, sf, "market"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
