import json

import pytest
from pyspark.sql import functions as F

from bookglass.operators import features as ft
from bookglass.sources import sinks
from bookglass.sources.adapters import view
from bookglass.streaming.stateless import transform_files

SF = "/root/testdata/sf0.001"


def test_parts_are_bounded_and_replaced(spark, tmp_path):
    path = str(tmp_path / "parts")
    for _ in range(2):
        sinks.write_parts(spark.range(1000).coalesce(1), path, rows_per_file=300)
    assert spark.read.parquet(path).count() == 1000
    files = sinks.inventory(spark, path).collect()
    assert len(files) == 4 and all(len(f.sha256) == 64 and f.bytes > 0 for f in files)


@pytest.mark.parametrize("by", ["month", None])
def test_table_holds_the_same_rows(spark, tmp_path, by):
    s = view(spark, SF, "scored").select("month", "sample_id", "y")
    path = str(tmp_path / "table")
    sinks.write_table(s, path, by)
    back = spark.read.parquet(path)
    assert sinks.manifest(back, ["sample_id", "month"]).collect() == sinks.manifest(s, ["sample_id", "month"]).collect()
    assert [d for d in (tmp_path / "table").iterdir() if d.name.startswith("month=" if by else "id_bucket=")]


def test_empty_table_is_written(spark, tmp_path):
    sinks.publish(spark.range(0), str(tmp_path / "t"), "run 1")
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["id", "run_id"]


def test_steps_replace_what_was_there(spark, tmp_path):
    path = str(tmp_path / "steps")
    for _ in range(2):
        assert sinks.load_in_steps([spark.range(5), spark.range(5, 9)], path) == 9


def test_submission_wants_the_keys_of_the_template(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.1), (2, 0.2)], "sample_id long, prediction double")
    sinks.write_submission(p, p.select("sample_id"), str(tmp_path / "a"))
    for wrong in (p.where("sample_id = 1"), p.unionByName(p.limit(1)), p.withColumn("sample_id", F.col("sample_id") + 1)):
        with pytest.raises(ValueError, match="keys"):
            sinks.write_submission(wrong, p.select("sample_id"), str(tmp_path / "b"))


def test_nested_scores_and_tagged_csv(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"models": [{"model": "a", "per_fold": [{"fold": 1, "cosine": 0.5}, {"fold": 2, "cosine": 0.25}]}, {"model": "b", "per_fold": []}]}, indent=1))
    assert [tuple(r) for r in sinks.read_scores(spark, str(tmp_path / "s.json")).orderBy("fold").collect()] == [("a", 1, 0.5), ("a", 2, 0.25)]
    (tmp_path / "x.csv").write_text("k,v\n1,2.5\n")
    (tmp_path / "y.csv").write_text("k,v\n1,\n")
    d = sinks.read_tagged_csv(spark, {"x": str(tmp_path / "x.csv"), "y": str(tmp_path / "y.csv")}, "k int, v double")
    assert sorted((r.kind, r.k, r.v) for r in d.collect()) == [("x", 1, 2.5), ("y", 1, None)]


def test_key_count_and_schema_faults(spark):
    d = spark.createDataFrame([(1,), (1,), (4,), (None,)], "k long")
    assert tuple(sinks.key_faults(d, "k").first()) == (1, 1, 2)
    assert tuple(sinks.key_faults(d.where("k > 9"), "k").first()) == (0, 0, 0)
    assert [r.agrees for r in sinks.count_faults({"a": d, "b": d}, {"a": 4, "b": 5}).orderBy("source").collect()] == [True, False]
    assert sinks.schema_faults(d, {"k": "int", "z": "string"}) == ["k: bigint, not int", "z: missing"]
    assert sinks.all_null_share(d, ["k"]).first()[0] == 0.25


def test_book_and_channels_of_a_stream_equal_the_table(spark, tmp_path):
    raw = view(spark, SF, "market")
    source = str(tmp_path / "in")
    raw.repartition(6).write.parquet(source)
    columns = ["row_id", "mid", "microprice", "depth_imb_12"]
    run = lambda: transform_files(spark, source, raw.schema, lambda d: ft.book(d).select(*columns), str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination(120)
    run()
    run()  # nothing is left to take up
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ft.book(raw).select(*columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
