"""Run records, stored feature tables with planted faults, loads in order and groups of columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from bookglass.sources import records
from bookglass.sources.exports import export_ordered


def rows(spark, n=60):
    return spark.range(n).select(F.col("id").alias("sample_id"), (F.col("id") % 71).cast("int").alias("month"), (F.col("id") / 7).alias("y"), (F.col("id") * 3).alias("whole"))


def test_record_depends_on_what_is_selected_not_on_order(spark):
    d = rows(spark)
    one, again = (records.run_record(x, ["b", "a"]).first() for x in (d, d.orderBy(F.desc("sample_id")).repartition(5)))
    assert one == again and one.n_rows == 60 and one.n_features == 2 and one.features_sha256 == hashlib.sha256(b"b\na").hexdigest()
    assert one.rows_per_month.startswith("0:1,1:1,2:1,")
    assert records.run_record(d, ["a", "b"]).first().features_sha256 != one.features_sha256
    assert records.run_record(d.where("sample_id <> 5"), ["a"]).first().fingerprint != one.fingerprint
    odd = d.withColumn("month", F.when(F.col("sample_id") > 1, F.col("month")).otherwise(None)).where("sample_id in (0, 1, 10, 9)")
    assert records.run_record(odd, []).first().rows_per_month == "9:1,10:1,-:2"
    none = records.run_record(d.where("false"), []).first()
    assert (none.n_rows, none.rows_per_month, none.fingerprint) == (0, "", None)


def test_input_that_changes_during_a_run_is_told(spark, tmp_path):
    path = f"file://{tmp_path}/input"
    rows(spark).repartition(2).write.parquet(path)
    with records.unchanged(spark, path) as files:
        assert files.count() == 2
    with pytest.raises(RuntimeError, match="changed during the run: part-"):
        with records.unchanged(spark, path):
            rows(spark, 3).write.mode("append").parquet(path)


def test_faults_of_a_stored_table(spark, tmp_path):
    good, bad = f"file://{tmp_path}/good", f"file://{tmp_path}/bad"
    d = rows(spark, 142)
    export_ordered(d, good, ["sample_id"], rows_per_file=50)
    ok = records.feature_faults(spark, good, expected=142).first()
    assert ok.ok and ok.rows_agree and ok.months_agree and ok.n_rows == 142 and not (ok.repeated or ok.unordered or ok.infinite or ok.no_target)
    assert records.feature_faults(spark, good).first().rows_agree is None and not records.feature_faults(spark, good, last_month=71).first().ok
    assert not records.feature_faults(spark, good, expected=141).first().ok
    planted = d.withColumn("y", F.when(F.col("sample_id") == 3, float("inf")).when(F.col("sample_id") == 4, -float("inf")).when(F.col("sample_id") != 5, F.col("y"))).where("month > 0")
    planted.unionByName(planted.where("sample_id = 9")).coalesce(1).sortWithinPartitions(F.desc("sample_id")).write.parquet(bad)
    f = records.feature_faults(spark, bad).first()
    assert (f.n_rows, f.repeated, f.unordered, f.infinite, f.no_target, f.first_month, f.last_month, f.months_agree, f.ok) == (141, 1, 140, 2, 1, 1, 70, False, False)
    empty = f"file://{tmp_path}/empty"
    d.where("false").write.parquet(empty)
    e = records.feature_faults(spark, empty, expected=0).first()
    assert (e.n_rows, e.repeated, e.unordered, e.infinite, e.no_target, e.first_month, e.ok) == (0, 0, 0, 0, 0, None, False)


def test_loads_are_in_order_and_narrow(spark, tmp_path):
    path, other = f"file://{tmp_path}/t", f"file://{tmp_path}/o"
    d = rows(spark, 500)
    export_ordered(d, path, ["sample_id"], rows_per_file=200)
    got = records.load_features(spark, path, ["sample_id", "y"])
    assert got.dtypes == [("sample_id", "bigint"), ("y", "float")] and "Exchange" not in got._jdf.queryExecution().toString()
    assert records.load_features(spark, path, float32=False).dtypes == d.dtypes
    d.orderBy(F.desc("sample_id")).write.parquet(other)
    back = records.load_features(spark, other, ["y"])
    assert back.columns == ["y"]
    places = back.select(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"), "y").orderBy("f", "i").collect()
    assert [r.y for r in places] == sorted(r.y for r in places) and len(places) == 500


def test_column_groups_join_without_an_exchange(spark, tmp_path):
    d = rows(spark, 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = records.write_column_groups(d, {"target": ["month", "y"], "rest": ["whole"]}, f"file://{tmp_path}/groups", buckets=4)
        whole = records.column_groups(tables)
        assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
        assert sorted(whole.select(*d.columns).collect()) == sorted(d.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for groups in ({"a": ["month"]}, {"a": ["month", "y"], "b": ["y", "whole"]}, {"a": ["month", "y", "whole", "other"]}):
        with pytest.raises(ValueError, match="in no group"):
            records.write_column_groups(d, groups, f"file://{tmp_path}/never")
