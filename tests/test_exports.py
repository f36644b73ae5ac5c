"""Ordered exports, bucketed tables, footers, whole loads, reconciled results, guards that raise."""

import pytest
from pyspark.sql import functions as F

from bookglass.operators import comparison, evaluation
from bookglass.sources import exports, sinks


def path(spark, name):
    return sinks.scratch(spark, name)


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def test_keys_increase_over_all_files(spark):
    p = path(spark, "ordered")
    f = exports.export_ordered(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")), p, ["k"], rows_per_file=150)
    rows = f.orderBy("file").collect()
    assert len(rows) > 3 and sum(r["n"] for r in rows) == 1000 and all(a["last"] < b["first"] for a, b in zip(rows, rows[1:], strict=False))
    for bad in ([1, 2, 2, 3], [1, None, 2]):
        with pytest.raises(ValueError, match="increase"):
            exports.export_ordered(ids(spark, bad), path(spark, "bad"), ["k"])
    q = path(spark, "unordered")
    ids(spark, [3, 1, 2]).coalesce(1).write.parquet(q)
    ids(spark, [2, 5]).coalesce(1).write.mode("append").parquet(q)
    found = exports.order_faults(spark, q, ["k"]).collect()
    assert sum(r["unordered"] for r in found) == 1 and sum(r["overlaps"] for r in found) == 1


def test_bucketed_tables_join_without_an_exchange(spark):
    a, b = (exports.write_bucketed(spark.range(500).select(F.col("id").alias("sample_id"), F.lit(n).alias(n)), f"bucketed_{n}", path(spark, n), buckets=4) for n in "ab")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = a.join(b, "sample_id").groupBy("sample_id").agg(F.count("*").alias("n"))
        assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString() and j.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_footers_tell_rows_sizes_and_ranges(spark):
    p = path(spark, "footers")
    spark.range(100).select(F.col("id"), F.when(F.col("id") > 9, F.col("id") / 2).alias("x")).repartition(3).write.parquet(p)
    s = exports.file_sizes(spark, p).collect()
    assert len(s) == 3 and sum(r["n_rows"] for r in s) == 100 and all(r["bytes"] > 100 for r in s)
    assert {r["column"]: tuple(r)[1:] for r in exports.footer_ranges(spark, p, ["id", "x"]).collect()} == {"id": (100, 100, 0.0, 99.0), "x": (100, 90, 5.0, 49.5)}
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    a = exports.footer_audit(spark, {"t": p}, {"x": (0, 40), "id": (0, 99), "other": (0, 1)}).first()
    assert a["out_of_range"] == "x" and a["n_files"] == 3 and a["n_rows"] == 100 and a["bytes"] == sum(r["bytes"] for r in s)


def test_a_load_is_seen_as_a_whole_or_not_at_all(spark):
    p = path(spark, "load")
    with pytest.raises(FileNotFoundError):
        exports.read_whole(spark, p)
    part = lambda lo, hi, tag="a": spark.range(lo, hi).select("id", F.lit(tag).alias("tag"))
    assert exports.load_whole({"x": part(0, 5), "y": part(5, 9)}, p, "one", "id") == 9
    cut = spark.range(4, 6).select("id", F.raise_error(F.lit("lost")).cast("string").alias("tag"))
    with pytest.raises(Exception, match="lost"):
        exports.load_whole({"x": part(0, 4, "b"), "y": cut}, p, "two", "id")
    assert {r["tag"] for r in exports.read_whole(spark, p).collect()} == {"a"} and exports.read_whole(spark, p).count() == 9
    with pytest.raises(ValueError, match="once each"):
        exports.load_whole({"x": part(0, 4, "c"), "y": part(5, 9, "c")}, p, "three", "id")
    never = spark.range(1).select("id", F.raise_error(F.lit("again")).cast("string").alias("tag"))
    assert exports.load_whole({"x": never, "y": part(4, 6, "b")}, p, "two", "id") == 6  # x is there already
    assert sorted((r["id"], r["tag"]) for r in exports.read_whole(spark, p).collect()) == [(i, "b") for i in range(6)]
    names = {f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(p))}
    assert len([n for n in names if n.startswith("run-")]) == 2  # older and given-up folders are gone


def test_every_difference_is_named(spark):
    a = spark.createDataFrame([("p1", 1, 0.5, "x"), ("p1", 2, 0.6, None), ("p2", 1, 0.7, "x"), ("p2", 2, None, "x"), ("p3", 1, 0.1, "x"), ("p3", 1, 0.1, "x")], "model string, fold int, cosine double, note string")
    b = spark.createDataFrame([("p1", 1, 0.5 + 1e-12, "x"), ("p1", 2, 0.61, "y"), ("p2", 2, None, "x"), ("p4", 1, 1.0, "x"), ("p3", 1, 0.1, "x")], a.schema)
    pa, pb = path(spark, "json"), path(spark, "csv")
    a.write.json(pa)
    b.write.option("header", True).csv(pb)
    got = exports.reconcile(spark.read.schema(a.schema).json(pa), spark.read.schema(a.schema).option("header", True).csv(pb), ["model", "fold"], ["cosine", "note"]).collect()
    assert {(r["model"], r["fold"]): (r["status"], r["columns"]) for r in got} == {("p1", 1): ("agrees", ""), ("p1", 2): ("differs", "cosine,note"), ("p2", 1): ("only in the first", ""), ("p2", 2): ("agrees", ""), ("p3", 1): ("repeated", ""), ("p4", 1): ("only in the second", "")}


def test_a_sample_spread_over_the_files(spark):
    p = path(spark, "spread")
    spark.range(0, 1000, numPartitions=10).write.parquet(p)
    pick = lambda: sorted(r["id"] for r in exports.spread_sample(spark, p, 3, 20).collect())
    rows = pick()
    assert rows == pick() == [*range(0, 100, 20), *range(400, 500, 20), *range(900, 1000, 20)]
    assert exports.spread_sample(spark, p, 50).count() == 1000


def test_guards_raise(spark):
    left, right = ids(spark, [1, 2, None]), ids(spark, [1, 1]).withColumn("v", F.lit(1))
    with pytest.raises(ValueError, match="right"):
        exports.joined_once(left, right, ["k"])
    assert exports.joined_once(left, right.limit(1), ["k"]).count() == 3
    months = lambda values: spark.createDataFrame([(float(m) if m is not None else None,) for m in values], "month double")
    full = list(range(66))
    assert evaluation.checked_folds(months(full)).count() > 0
    for bad, what in (([*range(0, 40), *range(50, 66)], "fold"), ([*full, None], "null"), ([*full, 1.5], "whole"), ([*full, -1], "negative")):
        with pytest.raises(ValueError, match=what):
            evaluation.checked_folds(months(bad))
    for folds in ([(1, 0, 34, 35, 40)], [(1, 0, 34, 36, 65)]):
        with pytest.raises(ValueError, match="fold 1"):
            evaluation.checked_folds(months(full), folds)
    with pytest.raises(ValueError, match="no rows in holdout"):
        comparison.checked_splits(months(range(65)))
    with pytest.raises(ValueError, match="doesn't follow"):
        comparison.checked_splits(months(full), [("a", 0, 5), ("b", 5, 6)])


def test_months_are_cut_without_holding_one(spark):
    df = spark.createDataFrame([(i % 3, i, float(i * 7 % 11)) for i in range(200)] + [(1, 900, None)], "month int, sample_id long, x double")
    assert [r["sample_id"] for r in evaluation.month_sample(df, 4).where("month = 1").orderBy("sample_id").collect()] == [1, 4, 7, 10]
    got = {r["sample_id"]: r["place"] for r in evaluation.month_places(df, "x", rows=5).collect()}
    for i in range(200):
        own = [j * 7 % 11 for j in range(200) if j % 3 == i % 3]
        v = i * 7 % 11
        assert got[i] == sum(o < v for o in own) + (sum(o == v for o in own) + 1) / 2
    assert got[900] is None and evaluation.month_fraction(df, 0.1).groupBy("month").count().orderBy("month").collect()[0]["count"] == 7
