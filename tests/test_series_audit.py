import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookglass.operators import audit, series
from bookglass.operators.audit import Rule


@pytest.mark.parametrize("centred", [False, True])
@pytest.mark.parametrize("width", [6, 7])
def test_running_scale_is_that_of_pandas_over_chunk_borders(spark, centred, width):
    rows = [(i // 13, 1000 - i if i < 13 else i, None if i % 7 == 3 or i > 55 else float((i * 37) % 23)) for i in range(60)]
    df = spark.createDataFrame(rows, "month int, sample_id long, x double")
    got = {(r.month, r.sample_id): r.scale for r in series.running_scale(df, "x", width, 4, centred, chunk=8, span=5).collect()}
    order = sorted(rows)
    m = pd.Series([r[2] for r in order], dtype=float).rolling(width, min_periods=4, center=centred).median().bfill().ffill()
    want = (m / m.mean()).tolist()
    assert len(got) == 60 and all(math.isclose(got[r[:2]], v, rel_tol=1e-12) for r, v in zip(order, want, strict=True))


def test_running_scale_of_nothing(spark):
    df = spark.createDataFrame([], "month int, sample_id long, x double")
    assert series.running_scale(df, "x").count() == 0
    few = spark.createDataFrame([(1, 1, 2.0), (None, 2, None)], "month int, sample_id long, x double")
    assert [r.scale for r in series.running_scale(few, "x").collect()] == [None, None]


def test_contract_tells_all_faults(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (2, -1, None), (None, 9, "z")], "k int, v int, s string")
    rules = {"k": Rule("int", unique=True), "v": Rule("bigint", low=0, high=8), "s": Rule("string", among=("a", "b"), nullable=True), "q": Rule("int")}
    got = {(r["column"], r["rule"]): r.violations for r in audit.contract_report(df, rules).collect()}
    assert got == {("k", "type"): 0, ("k", "null"): 1, ("k", "unique"): 1, ("v", "type"): 1, ("v", "null"): 1, ("v", "low"): 1, ("v", "high"): 1, ("s", "type"): 0, ("s", "member"): 1, ("q", "missing"): 1}
    empty = {(r["column"], r["rule"]): r.violations for r in audit.contract_report(df.limit(0), rules).collect()}
    assert empty[("k", "unique")] == 0 and empty[("v", "low")] == 0


def test_audit_names_faults(spark):
    a, b = spark.createDataFrame([(1, 2.0, 1)], "id long, x double, y int"), spark.createDataFrame([(1, 2.0)], "id long, x float")
    expected = spark.createDataFrame([("a", 1)], "table_name string, expected long")
    got = {r.table_name: r for r in audit.table_audit({"a": a, "b": b}, expected, {"b": {"x": "double"}}, {"a": {"y"}}, [("a", "b")], {"y"}).collect()}
    assert got["a"].rows_agree and got["a"].faults == "b: other columns; y: must not be here" and got["b"].rows_agree is None and got["b"].faults == "x: float, not double"


def test_regimes_lie_at_the_nearest_centre(spark):
    rows = [(i, math.exp(i % 3 * 4 + (i % 5) * 0.01), math.exp(-(i % 3)) if i % 11 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "sample_id long, a double, b double")
    got = audit.regime_descriptors(df.where("sample_id % 2 = 0"), df, ["a", "b"], k=3).collect()
    assert len(got) == 90 and math.isclose(sum({r.regime: r.regime_share for r in got}.values()), 1.0)
    logs = np.array([[math.log(x + audit.FLOOR) if x is not None else np.nan for x in r[1:]] for r in rows])
    pool = logs[::2]
    fill = np.nanmedian(pool, axis=0)
    logs, pool = (np.where(np.isnan(x), fill, x) for x in (logs, pool))
    scaled = lambda x: (np.asarray(x) - pool.mean(0)) / pool.std(0)
    centres = {r.regime: scaled([r.centre_a, r.centre_b]) for r in got}
    near = {}
    for r in got:
        size = {k: np.linalg.norm(scaled(logs[r.sample_id]) - c) for k, c in centres.items()}
        assert math.isclose(size[r.regime], min(size.values()), abs_tol=1e-6) and math.isclose(r.regime_dist, size[r.regime], abs_tol=1e-6)
        near[r.sample_id] = r.regime
    assert all(math.isclose(r.regime_share, sum(near[i] == r.regime for i in range(0, 90, 2)) / 45) for r in got)


def test_steps_resume_and_know_their_source(spark, tmp_path):
    from bookglass.sources import sinks

    path = str(tmp_path / "load")
    parts = {"a": spark.range(5), "b": spark.range(5, 9)}
    failing = {"a": spark.range(5), "b": spark.range(5, 9).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="stop"):
        sinks.load_resumable(failing, path, "v1")
    assert sinks.load_resumable(parts, path, "v1") == (9, 1)
    assert sinks.load_resumable(parts, path, "v1") == (9, 0)
    with pytest.raises(ValueError, match="source"):
        sinks.load_resumable(parts, path, "v2")
    with pytest.raises(ValueError, match="stale"):
        sinks.load_resumable({"a": parts["a"]}, path, "v1")
    assert sinks.read_loaded(spark, path).count() == 9 and tuple(sinks.key_faults(sinks.read_loaded(spark, path), "id").first()) == (0, 0, 0)


def test_rolling_scale_crosses_chunks_but_not_months(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i // 90), None if rng.random() < 0.1 else float(rng.integers(1, 50))) for i in range(250)] + [(900, None, 3.0), (901, None, 5.0), (902, 7, None)]
    df = spark.createDataFrame(rows, "sample_id long, month int, x double").repartition(4)
    got = {r.sample_id: r.scale for r in series.rolling_scale(df, "x", width=9, least=4, chunk=20, span=37).collect()}
    assert len(got) == len(rows)
    for month in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == month]
        m = []
        for i in range(len(own)):
            v = [r[2] for r in own[max(0, i - 8) : i + 1] if r[2] is not None]
            m.append(float(np.median(v)) if len(v) >= 4 else None)
        filled = [next((v for v in m[i:] if v is not None), None) for i in range(len(own))]
        known = [v for v in filled if v is not None]
        for r, v in zip(own, filled, strict=True):
            want = None if v is None else v / np.mean(known)
            assert got[r[0]] is None if want is None else abs(got[r[0]] - want) < 1e-9
    assert series.rolling_scale(df.where("false"), "x").count() == 0
