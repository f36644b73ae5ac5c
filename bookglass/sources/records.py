"""What a run read and selected: records that are published only if the input is still the same, checks of stored feature tables, loads of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookglass.sources.exports import order_faults, write_bucketed
from bookglass.sources.sinks import fingerprint, inventory, scratch


def run_record(df: DataFrame, features: list[str], key: str = "sample_id", month: str = "month") -> DataFrame:
    """One row: n_rows, n_features, features_sha256 (of the names in the order given, one a line), rows_per_month (month:rows in order, with commas; null
    months last as -) and fingerprint of (key, month) in any order. An empty table has 0 rows, no months and no fingerprint."""
    per = df.groupBy(F.col(month).alias("month")).agg(F.count("*").alias("n"), fingerprint([key, month]).alias("f"))  # a row per month
    entries = F.array_sort(F.collect_list(F.struct(F.col("month").isNull().alias("last"), "month", "n")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(F.coalesce(e["month"].cast("string"), F.lit("-")), F.lit(":"), e["n"].cast("string"))), ",")
    names = hashlib.sha256("\n".join(features).encode()).hexdigest()
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), text.alias("rows_per_month"), F.sum("f").alias("fingerprint"))
    return one.select("n_rows", F.lit(len(features)).alias("n_features"), F.lit(names).alias("features_sha256"), "rows_per_month", "fingerprint")


@contextmanager
def unchanged(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """(file, bytes, sha256) of a table's files, for the steps of a run; raises RuntimeError at their end where a file has come, gone or changed meanwhile.

    The files are hashed twice, in tasks; a row per file is kept in between, in the shared folder.
    """
    before = scratch(spark, "inventory")
    inventory(spark, path).write.parquet(before)
    first = spark.read.parquet(before)
    yield first
    spark.catalog.refreshByPath(path)
    now = inventory(spark, path)
    moved = first.exceptAll(now).unionByName(now.exceptAll(first)).select("file").distinct().orderBy("file").limit(5).collect()
    if moved:
        raise RuntimeError(f"the input changed during the run: {', '.join(r['file'] for r in moved)}")


def feature_faults(spark: SparkSession, path: str, *, key: str = "sample_id", target: str = "y", month: str = "month", last_month: int = 70, expected: int | None = None) -> DataFrame:
    """One row of what is wrong with a stored feature table: n_rows, rows_agree (null without ``expected``), repeated keys (rows beyond each key's
    first), unordered (rows not above the row before, and files that don't begin above the one before), infinite values in all
    numeric columns, no_target, first_month, last_month, months_agree (0 and ``last_month``), ok.

    One pass counts values, one groups keys, one reads the keys of each file in their order. A table without rows has null months, which don't agree.
    """
    d = spark.read.parquet(path)
    wide = [f.name for f in d.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    endless = reduce(Column.__add__, (F.count_if(F.abs(F.col(c)) == float("inf")) for c in wide), F.lit(0).cast("long"))
    y, m = F.col(target), F.col(month)
    values = d.agg(F.count("*").alias("n_rows"), endless.alias("infinite"), F.count_if(y.isNull() | F.isnan(y)).alias("no_target"), F.min(m).alias("first_month"), F.max(m).alias("last_month"))
    keys = d.groupBy(key).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeated"))
    order = order_faults(spark, path, [key]).agg(F.coalesce(F.sum("unordered") + F.count_if("overlaps"), F.lit(0)).alias("unordered"))
    one = values.crossJoin(F.broadcast(keys)).crossJoin(F.broadcast(order))  # a row each
    agree = F.lit(None).cast("boolean") if expected is None else F.col("n_rows") == expected
    months = F.coalesce((F.col("first_month") == 0) & (F.col("last_month") == last_month), F.lit(False))
    ok = F.coalesce(agree, F.lit(True)) & months & (F.col("repeated") + F.col("unordered") + F.col("infinite") + F.col("no_target") == 0)
    return one.select("n_rows", agree.alias("rows_agree"), "repeated", "unordered", "infinite", "no_target", "first_month", "last_month", months.alias("months_agree"), ok.alias("ok"))


def load_features(spark: SparkSession, path: str, columns: list[str] | None = None, *, key: str = "sample_id", float32: bool = True) -> DataFrame:
    """The columns of a stored feature table (all, without a list), doubles as floats if ``float32``. A table whose key doesn't increase over its files in
    the order of their names is sorted into a new one first, with ties and null keys side by side; the rest is a scan of the columns."""
    d = spark.read.parquet(path)
    d = d.select(*columns) if columns else d
    if float32:
        d = d.select(*(F.col(f.name).cast("float") if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in d.schema))
    if order_faults(spark, path, [key]).where("unordered + nulls > 0 or overlaps").isEmpty():
        return d
    sorted_ = scratch(spark, "sorted")
    ahead = [c for c in (key,) if c not in d.columns]
    source = d if not ahead else spark.read.parquet(path).select(*ahead, *d.columns)
    source.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(sorted_)
    return spark.read.parquet(sorted_).select(*d.columns)


def write_column_groups(df: DataFrame, groups: dict[str, list[str]], path: str, *, key: str = "sample_id", buckets: int = 64) -> dict[str, DataFrame]:
    """A wide table as one table per group of columns, each with the key, dealt and sorted alike, so that column_groups joins them without an
    exchange. Each write scans its own columns alone. Raises ValueError where a column is in two groups or in none."""
    named = [c for g in groups.values() for c in g]
    wrong = sorted({c for c in named if named.count(c) > 1} | set(named) ^ (set(df.columns) - {key}))
    if wrong:
        raise ValueError(f"columns in no group, in two, or unknown: {', '.join(wrong)}")
    run = path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    return {g: write_bucketed(df.select(key, *own), f"{run}_{g}", f"{path}/{g}", key, buckets) for g, own in groups.items()}


def column_groups(tables: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """The wide table again, of the keys that all groups have."""
    first, *rest = tables.values()
    return reduce(lambda a, b: a.join(b, key), rest, first)


