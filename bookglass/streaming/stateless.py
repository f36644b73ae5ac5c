"""Row-wise operators over a stream: the same functions as on a table, with a checkpoint in place of a window or state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def transform_files(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Takes up the Parquet files of ``source`` that no earlier run took, and adds their transformed rows to ``target``.
    Ends when none is left; a run that was cut off goes on from ``checkpoint`` without losing or repeating rows."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
