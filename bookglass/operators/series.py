"""Ordered rows at any size: positions over the whole table, frames that cross chunk borders, padded sequences of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookglass.functions.exprs import corr_safe, safe_div
from bookglass.operators.features import snapshot_channels
from bookglass.operators.ranges import ROWS, kept, with_previous
from bookglass.sources.sinks import scratch

#: Snapshots in a sequence; rows in the blocks whose means are compared, each a multiple of the one before.
STEPS, BLOCK_SIZES = 176, (10, 100, 1000, 10000)


def positions(df: DataFrame, span: int = 1_000_000) -> DataFrame:
    """df with ``pos``, each row's place from 0 in order of (month, sample_id). Rows are numbered in ranges of ``span`` ids of a month, then
    moved by the sizes of the ranges before, so a task sees ``span`` ids at most. sample_id is whole and unique in a month; ties take any order."""
    d = df.withColumn("__range", F.floor(F.col("sample_id") / span))
    sizes = d.groupBy("month", "__range").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("month", "__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = sizes.select(F.col("month").alias("__m"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    placed = d.join(before, F.col("month").eqNullSafe(F.col("__m")) & F.col("__range").eqNullSafe(F.col("__r")))
    own = Window.partitionBy("month", "__range").orderBy("sample_id")
    return placed.withColumn("pos", F.row_number().over(own) - 1 + F.col("__before")).drop("__range", "__m", "__r", "__before", "__n")


def block_pyramid(df: DataFrame, x: str, sizes: tuple[int, ...] = BLOCK_SIZES, *, within: bool = False, span: int = 1_000_000) -> dict[int, DataFrame]:
    """Per size, (block, x): the mean log of x in blocks of that many rows of the whole order (month, sample_id), less its month's mean
    if ``within``. Values that aren't positive are missing; blocks without a value drop. Rows are placed and summed once, in the smallest blocks,
    from which the larger ones are added up."""
    v = F.when(F.col(x) > 0, F.log(x))
    d = positions(df.select("month", "sample_id", v.alias("__v")), span)
    if within:
        means = df.groupBy("month").agg(F.avg(v).alias("__mean")).withColumnRenamed("month", "__of")
        d = d.join(F.broadcast(means), F.col("month").eqNullSafe(F.col("__of"))).withColumn("__v", F.col("__v") - F.col("__mean"))  # a row per month
    level = kept(d.groupBy(F.floor(F.col("pos") / sizes[0]).alias("block")).agg(F.sum("__v").alias("s"), F.count("__v").alias("n")), "blocks")
    out, size = {}, sizes[0]
    for wanted in sizes:
        if wanted % size:
            raise ValueError(f"blocks of {wanted} rows aren't made of whole blocks of {size}")
        level = level.groupBy(F.floor(F.col("block") / (wanted // size)).alias("block")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        size = wanted
        out[wanted] = level.where("n > 0").select("block", (F.col("s") / F.col("n")).alias("x"))
    return out


def block_autocorrelations(df: DataFrame, x: str, sizes: tuple[int, ...] = BLOCK_SIZES, *, within: bool = False, span: int = 1_000_000, rows: int = ROWS) -> DataFrame:
    """(block, n_blocks, autocorr, noise_se, expected) per size: the correlation of each block's mean (see block_pyramid) with the one before, null for
    fewer than 3 blocks; its noise without any order; and, if ``within``, what an order-free table would show: -1 over a month's mean blocks less one."""
    month = df.groupBy("month").agg(F.count("*").alias("n")).agg(F.avg("n").alias("per"))
    out = None
    for size, means in block_pyramid(df, x, sizes, within=within, span=span).items():
        d = with_previous(means, ["block"], {"before": "x"}, rows)
        n = F.count("*")
        one = d.agg(F.lit(size).alias("block"), n.alias("n_blocks"), F.when(n >= 3, corr_safe(F.col("x"), F.col("before"))).alias("autocorr"), safe_div(F.lit(1.0), F.sqrt(n)).alias("noise_se"))
        out = one if out is None else out.unionByName(one)
    expected = safe_div(F.lit(-1.0), F.col("per") / F.col("block") - 1) if within else F.lit(None).cast("double")
    return out.crossJoin(F.broadcast(month)).withColumn("expected", expected).drop("per")


def lag_correlations(df: DataFrame, lags: list[int], x: str = "y", *, chunk: int = 100_000, span: int = 1_000_000) -> DataFrame:
    """(lag, r): correlation of x with its value some rows before, in the whole order (month, sample_id). Rows go to chunks of positions; the last
    rows of a chunk, as many as the longest lag, visit the next one too, so lags cross the borders and no task holds a month."""
    most = max(lags)
    p = positions(df.select("month", "sample_id", x), span).withColumn("__own", F.floor(F.col("pos") / chunk))
    near = F.sequence(F.col("__own"), F.floor((F.col("pos") + most) / chunk))
    w = Window.partitionBy("__chunk").orderBy("pos")
    d = p.withColumn("__chunk", F.explode(near))
    d = d.select("__own", "__chunk", x, *(F.lag(x, k).over(w).alias(f"__{k}") for k in lags)).where("__own = __chunk")
    one = d.agg(*(corr_safe(F.col(x), F.col(f"__{k}")).alias(str(k)) for k in lags))
    return one.unpivot([], list(one.columns), "lag", "r").withColumn("lag", F.col("lag").cast("int"))


def running_scale(df: DataFrame, x: str, width: int = 200, least: int = 50, centred: bool = False, chunk: int = 100_000, span: int = 1_000_000) -> DataFrame:
    """df with ``scale``: the running median of x over (month, sample_id), over its mean.

    The frame is the last ``width`` rows, or is centred, with one row more behind than ahead if width is even. Frames with fewer than ``least``
    values take the next median that stands, else the last one before; null if there is none, and the table may be empty. Rows
    go to chunks of positions with the rows that frames reach beyond the border, so frames are whole and no task holds a month.
    """
    ahead = (width - 1) // 2 if centred else 0
    behind = width - 1 - ahead
    p = positions(df, span).withColumn("__own", F.floor(F.col("pos") / chunk))
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - ahead) / chunk)), F.floor((F.col("pos") + behind) / chunk))
    frame = Window.partitionBy("__chunk").orderBy("pos").rowsBetween(-behind, ahead)
    m = p.withColumn("__chunk", F.explode(near)).withColumn("__v", F.collect_list(F.col(x).cast("double")).over(frame))  # ``width`` values at most
    m = m.where("__chunk = __own").withColumns({"__v": F.sort_array("__v"), "__n": F.size("__v")})
    middle = lambda i: F.try_element_at("__v", F.floor(i).cast("int") + 1)
    m = m.withColumn("__m", F.when(F.col("__n") >= least, (middle((F.col("__n") - 1) / 2) + middle(F.col("__n") / 2)) / 2))
    path = scratch(df.sparkSession, "running")  # frames are taken once, though three passes read them
    m.drop("__own", "__v", "__n").write.parquet(path)
    m = df.sparkSession.read.parquet(path)
    ends = m.groupBy("__chunk").agg(F.min_by("__m", F.when(F.col("__m").isNotNull(), F.col("pos"))).alias("first"), F.max_by("__m", F.when(F.col("__m").isNotNull(), F.col("pos"))).alias("last"))
    # Frames that grow from one end are linear; the next value is the last one seen from the other end.
    past = lambda part, by, end: Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, end)
    one = F.lit(1)  # a row per chunk
    later = F.last("first", ignorenulls=True).over(past(one, F.desc("__chunk"), -1))
    earlier = F.last("last", ignorenulls=True).over(past(one, "__chunk", -1))
    ends = ends.select("__chunk", later.alias("__later"), earlier.alias("__earlier"))
    after, before = (F.last("__m", ignorenulls=True).over(past("__chunk", by, 0)) for by in (F.desc("pos"), "pos"))
    filled = m.withColumns({"__after": after, "__before": before}).join(ends, "__chunk")
    filled = filled.withColumn("__m", F.coalesce("__after", "__later", "__before", "__earlier")).drop("__after", "__before", "__later", "__earlier", "__chunk")
    mean = filled.agg(F.avg("__m").alias("__mean"))
    return filled.crossJoin(F.broadcast(mean)).withColumn("scale", safe_div(F.col("__m"), F.col("__mean"))).drop("__m", "__mean", "pos")


def rolling_scale(df: DataFrame, x: str, width: int = 50, least: int = 10, *, chunk: int = 100_000, span: int = 1_000_000) -> DataFrame:
    """df with ``scale``: the running median of the last ``width`` rows of a month, over its mean in the month. Frames with fewer than ``least``
    values take the next median of the month that stands; null if there is none. Months are cut into chunks of positions, and each chunk's first frames
    see the rows before it, so no task holds a month."""
    p = positions(df, span).withColumn("__own", F.floor(F.col("pos") / chunk))
    near = F.sequence(F.col("__own"), F.floor((F.col("pos") + width - 1) / chunk))
    frame = Window.partitionBy("month", "__chunk").orderBy("pos").rowsBetween(1 - width, 0)
    m = p.withColumn("__chunk", F.explode(near)).withColumn("__v", F.sort_array(F.collect_list(F.col(x).cast("double")).over(frame)))  # ``width`` values at most
    m = m.where("__chunk = __own").withColumn("__n", F.size("__v"))
    middle = lambda i: F.try_element_at("__v", F.floor(i).cast("int") + 1)
    m = kept(m.withColumn("__m", F.when(F.col("__n") >= least, (middle((F.col("__n") - 1) / 2) + middle(F.col("__n") / 2)) / 2)).drop("__own", "__v", "__n"), "rolling")
    stands = F.when(F.col("__m").isNotNull(), F.col("pos"))
    first = m.groupBy("month", "__chunk").agg(F.min_by("__m", stands).alias("__first"))
    after = Window.partitionBy("month").orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    first = first.select(F.col("month").alias("__of"), F.col("__chunk").alias("__at"), F.last("__first", ignorenulls=True).over(after).alias("__later"))
    back = Window.partitionBy("month", "__chunk").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("month").eqNullSafe(F.col("__of"))
    filled = m.withColumn("__m", F.last("__m", ignorenulls=True).over(back)).join(first, own & (F.col("__chunk") == F.col("__at")))
    filled = filled.withColumn("__m", F.coalesce("__m", "__later")).drop("__of", "__at", "__later", "__chunk")
    means = filled.groupBy(F.col("month").alias("__of")).agg(F.avg("__m").alias("__mean"))
    return filled.join(F.broadcast(means), own).withColumn("scale", safe_div(F.col("__m"), F.col("__mean"))).drop("__m", "__mean", "__of", "pos")  # a row per month


def channel_sequences(raw: DataFrame, steps: int = STEPS) -> DataFrame:
    """(sample_id, step, 15 channels, valid): the newest ``steps`` snapshots of each sample, oldest first. A shorter sample is padded in front
    with its oldest snapshot, whose copies have valid 0. return_bps is against the newest mid. One shuffle by sample; padding is exploded
    from the oldest row kept."""
    d = snapshot_channels(raw)
    w = Window.partitionBy("sample_id").orderBy("age", F.col("row_id").desc())
    d = d.withColumns({"__back": F.row_number().over(w), "__oldest": F.lead("row_id").over(w).isNull()}).where(F.col("__back") <= steps)
    d = d.withColumn("__slot", F.explode(F.sequence(F.col("__back"), F.when(F.col("__oldest"), steps).otherwise(F.col("__back")))))
    channels = [c for c in d.columns if c not in ("row_id", "sample_id", "__back", "__oldest", "__slot")]
    return d.select("sample_id", (F.lit(steps) - F.col("__slot")).cast("int").alias("step"), *channels, (F.col("__slot") == F.col("__back")).cast("int").alias("valid"))
