"""What the operators of this subpackage share: scratch tables, batch limits, streaming over sorted groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold, so that a worker never has more text than this in hand.
BATCH_ROWS = 1000
BATCH_BYTES = 16 * 1024 * 1024


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="bookglass-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bookglass-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; of an empty text where the id is null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """(key, rows) of each run of equal keys in a partition sorted by key; only one run is held at a time."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != current:
                yield current, rows
                rows = []
            current = row[key]
            rows.append(row)
    if rows:
        yield current, rows
