"""Orders over whole tables at any size: rows dealt in ranges of an order, running totals chained over the ranges, thinning by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookglass.sources.sinks import scratch

#: Rows that one range of an order holds, more or less: a task sorts these.
ROWS = 500_000
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df, written to the shared folder and read again, so that what follows doesn't make it anew."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if its rows are few; a join shuffles otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranged(df: DataFrame, order: list[str | Column], rows: int = ROWS) -> DataFrame:
    """df with ``range``: its rows dealt in ranges of the order, as many as its rows need, each wholly before the next. Rows that are
    equal in the order share one. Written when this is called, so a range keeps its rows when a task is run again."""
    d = kept(df, "rows")
    many = max(1, -(-d.count() // rows))
    return kept(d.repartitionByRange(many, *order).withColumn("range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[str | Column], name: str = "pos", rows: int = ROWS) -> DataFrame:
    """df with its rows' places from 0 in the order; ties take any."""
    d = ranged(df, order, rows)
    sizes = d.groupBy("range").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = kept(sizes.select("range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before")))
    own = Window.partitionBy("range").orderBy(*order)
    return d.withColumn(name, F.row_number().over(own) - 1).join(small(before), "range").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("range", "__before")


def equity_curve(trades: DataFrame, by: list[str], order: list[str], *, pnl: str = "pnl", from_zero: str | None = None, rows: int = ROWS) -> DataFrame:
    """trades with ``equity`` (the running total of pnl in the order, per group), ``peak`` (its running maximum) and ``drawdown``.

    The peak starts at the first row's equity, or at 0 where the column from_zero is true: where rows that don't trade come
    before. A range is summed by itself, as (sum, highest prefix); ranges are chained; each row adds what its range starts from. So
    no task holds more than a range, however long a group is.
    """
    d = ranged(trades, order, rows)
    w = Window.partitionBy(*by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__run", F.sum(pnl).over(w)).withColumn("__top", F.max("__run").over(w))
    parts = d.groupBy(*by, "range").agg(F.sum(pnl).alias("__sum"), F.max("__top").alias("__top"))
    chain = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.withColumn("__before", F.coalesce(F.sum("__sum").over(chain), F.lit(0.0)))
    parts = parts.withColumn("__high", F.max(F.col("__before") + F.col("__top")).over(chain)).select(*by, "range", "__before", "__high")
    d = d.join(small(kept(parts)), [*by, "range"])
    start = F.when(F.col(from_zero), F.lit(0.0)) if from_zero else F.lit(None).cast("double")
    d = d.withColumns({"equity": F.col("__before") + F.col("__run"), "peak": F.greatest(F.col("__before") + F.col("__top"), "__high", start)})
    return d.withColumn("drawdown", F.col("equity") - F.col("peak")).drop("range", "__run", "__top", "__before", "__high")


def thinned(df: DataFrame, order: list[str], points: int, rows: int = ROWS) -> DataFrame:
    """``points`` rows at even places of the order, with ``pos``, both ends kept; all rows if they are no more."""
    d = kept(numbered(df, order, rows=rows))
    n = d.count()
    if n <= points:
        return d
    return d.where(F.col("pos").isin(sorted({round(j * (n - 1) / (points - 1)) for j in range(points)})))


def with_previous(df: DataFrame, order: list[str], columns: dict[str, str], rows: int = ROWS) -> DataFrame:
    """df with, per name, a column's value in the row before, over the borders of ranges too; null in the first."""
    d = ranged(df, order, rows)
    own = Window.partitionBy("range").orderBy(*order)
    ends = d.groupBy("range").agg(*(F.max_by(F.struct(c), F.struct(*order)).alias(f"__{n}") for n, c in columns.items()))
    chain = Window.partitionBy(F.lit(1)).orderBy("range")  # a row per range
    ends = kept(ends.select("range", *(F.lag(f"__{n}").over(chain).alias(f"__{n}") for n in columns)))
    d = d.withColumns({f"__first": F.row_number().over(own) == 1} | {n: F.lag(c).over(own) for n, c in columns.items()}).join(small(ends), "range")
    return d.withColumns({n: F.when(F.col("__first"), F.col(f"__{n}")[c]).otherwise(F.col(n)) for n, c in columns.items()}).drop("range", "__first", *(f"__{n}" for n in columns))
