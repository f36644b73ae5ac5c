"""The row-wise operators that need no other row give on a stream what they give on the table."""

import pytest
from pyspark.sql import functions as F

from bookglass.operators import research
from bookglass.sources import sinks
from bookglass.streaming.stateless import transform_files

MEMBERS = {"a": {"p1": 0.6}, "b": {"p1": -0.2, "p2": 0.9}}
OPERATORS = {
    "batch_scoring": lambda d: research.score_batch(d, MEMBERS, {"a": 0.7, "b": 0.3}, deadband=5e-4),
    "power_reshaping": lambda d: d.select("sample_id", (F.signum("p1") * F.sqrt(F.abs("p1"))).alias("power")),
    "clipped": lambda d: d.select("sample_id", research.clip(F.col("p2"), -0.1, 0.1).alias("v")),
    "directions": lambda d: d.select("sample_id", research.direction(F.col("p1"), 0.05).alias("d")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_stream_equals_table(spark, name):
    rows = spark.range(60).select(F.col("id").alias("sample_id"), ((F.col("id") % 7 - 3) * 0.1).alias("p1"), ((F.col("id") % 11 - 5) * 0.05).alias("p2"))
    source, target, checkpoint = (sinks.scratch(spark, n) for n in ("in", "out", "state"))
    rows.where("sample_id < 40").repartition(3).write.parquet(source)
    run = lambda: transform_files(spark, source, rows.schema, OPERATORS[name], target, checkpoint, files_per_batch=2).awaitTermination()
    run()
    rows.where("sample_id >= 40").repartition(2).write.mode("append").parquet(source)
    run()  # takes up the new files alone
    run()
    got, want = (sorted(map(tuple, d.collect())) for d in (spark.read.parquet(target), OPERATORS[name](rows)))
    assert got == want and len(got) == 60
