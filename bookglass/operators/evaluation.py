"""Scoring over (y, p, month, group): metrics, splits, decomposition, drift, redundancy, backtest, sampling, contracts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookglass.functions.exprs import corr_safe, cosine, quantile, safe_div
from bookglass.operators.ranges import ROWS, equity_curve, kept, numbered, ranged

# Folds, costs, shares of traded rows.
#: First and last month of each fold's training and validation; months between are the embargo.
FOLDS = [(1, 0, 34, 36, 40), (2, 0, 40, 42, 46), (3, 0, 46, 48, 52), (4, 0, 52, 54, 58), (5, 0, 58, 60, 64)]
COSTS_BPS = [0.0, 1.0, 2.0, 5.0]
FRACTIONS = [0.05, 0.1, 0.2, 0.5, 1.0]


def metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p1") -> DataFrame:
    """Cosine, MAE, RMSE, Pearson (0 if constant) and directional accuracy (without y = 0) per group.

    A first aggregate gives each group's largest |y|, |p| and |y - p|; squares are taken of values over these, so they
    neither over- nor underflow. Groups of null keys are one group. An infinite residual leaves an infinite error.
    """
    scales = df.groupBy(*by).agg(*(F.max(F.abs(x)).alias(n) for n, x in (("__y", F.col(y)), ("__p", F.col(p)), ("__r", F.col(y) - F.col(p)))))
    if by:
        keys = scales.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), "__y", "__p", "__r")
        on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
        df = df.join(keys, on, "left")
    else:
        df = df.crossJoin(F.broadcast(scales))
    over = lambda x, m: F.when(F.col(m) > 0, x / F.col(m)).otherwise(x)
    a, b, d = F.col(y), F.col(p), F.col(y) - F.col(p)
    ys, ps, rs = over(a, "__y"), over(b, "__p"), over(d, "__r")
    return df.groupBy(*by).agg(cosine(ys, ps).alias("cosine"), F.avg(F.abs(d)).alias("mae"), (F.max("__r") * F.sqrt(F.avg(rs * rs))).alias("rmse"), F.coalesce(corr_safe(ys, ps), F.lit(0.0)).alias("pearson"), F.coalesce(F.avg(F.when(a != 0, (F.signum(a) == F.signum(b)).cast("double"))), F.lit(0.0)).alias("direction"), F.count("*").alias("n"))


def input_faults(df: DataFrame, y: str = "y", p: str = "p1") -> DataFrame:
    """Counts of what may not be scored: nulls and values that aren't finite."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) | F.abs(c).isin(float("inf")))
    return df.agg(F.count("*").alias("n"), bad(y).alias("bad_y"), bad(p).alias("bad_p"))


def fold_rows(df: DataFrame, folds: list[tuple] = FOLDS) -> DataFrame:
    """(fold, role, row): rows of each fold's expanding training months and its validation months. The fold table is a few rows."""
    spark = df.sparkSession
    t = spark.createDataFrame([(f, "train", a, b) for f, a, b, _, _ in folds] + [(f, "val", c, d) for f, _, _, c, d in folds], "fold int, role string, lo int, hi int")
    return df.join(F.broadcast(t), F.col("month").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def checked_folds(df: DataFrame, folds: list[tuple] = FOLDS, holdout: int = 65, embargo: int = 1) -> DataFrame:
    """fold_rows, after one pass that raises ValueError where a month is null, negative or not whole, a fold's training or validation rows are
    missing, fewer than ``embargo`` months lie between them, or a fold reaches into the hold-out."""
    for f, a, b, c, d in folds:
        if not (0 <= a <= b and c <= d and b + embargo < c):
            raise ValueError(f"fold {f}: validation months {c} to {d} don't follow training months {a} to {b} and an embargo of {embargo}")
        if d >= holdout:
            raise ValueError(f"fold {f} reaches into the hold-out from month {holdout}")
    m = F.col("month").cast("double")
    inside = [F.count_if(m.between(lo, hi)).alias(f"n{i}") for i, (lo, hi) in enumerate(x for _, a, b, c, d in folds for x in ((a, b), (c, d)))]
    one = df.agg(F.count_if(m.isNull() | (m < 0) | (m != F.floor(m))).alias("bad"), *inside).first()
    if one["bad"]:
        raise ValueError(f"{one['bad']} months are null, negative or not whole")
    if empty := [f"fold {folds[i // 2][0]}: no {('training', 'validation')[i % 2]} rows" for i in range(2 * len(folds)) if not one[f"n{i}"]]:
        raise ValueError("; ".join(empty))
    return fold_rows(df, folds)


def fold_faults(df: DataFrame, folds: list[tuple] = FOLDS, holdout: int = 65) -> DataFrame:
    """Per fold: last training and first validation month, the embargo between, and whether they leak into each other or the hold-out."""
    r = fold_rows(df, folds).groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("month"))).alias("last_train"), F.min(F.when(F.col("role") == "val", F.col("month"))).alias("first_val"), F.max("month").alias("last_month"))
    return r.withColumns({"embargo": F.col("first_val") - F.col("last_train") - 1, "leaks": (F.col("last_train") >= F.col("first_val")) | (F.col("last_month") >= holdout)})


def stability(scores: DataFrame, value: str = "cosine", by: list[str] | None = None) -> DataFrame:
    """Mean, deviation, range and worst fold of a score."""
    return scores.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev(value), F.lit(0.0)).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.min_by("fold", F.struct(value, "fold")).alias("worst_fold"))


def decomposition(df: DataFrame, group: str, y: str = "y", p: str = "p1") -> DataFrame:
    """The pooled cosine as a sum over groups: cosine times the group's share of both norms. Groups are summed once; the totals are one row."""
    a, b = F.col(y), F.col(p)
    g = df.groupBy(group).agg(F.sum(a * b).alias("yp"), F.sum(a * a).alias("yy"), F.sum(b * b).alias("pp"), F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # over groups, already summed
    norm = F.sqrt(F.sum("yy").over(every)) * F.sqrt(F.sum("pp").over(every))
    own = F.sqrt("yy") * F.sqrt("pp")
    return g.select(group, "n", F.coalesce(safe_div(F.col("yp"), own), F.lit(0.0)).alias("cosine"), safe_div(own, norm).alias("weight"), (F.col("n") / F.sum("n").over(every)).alias("count_weight"), safe_div(F.col("yp"), norm).alias("contribution"))


def exact_quantiles(df: DataFrame, x: str | Column, qs: dict[str, float]) -> DataFrame:
    """One row of exact, linearly interpolated quantiles of the values that aren't null; nulls if there are none.

    Rows are counted and an approximate pass brackets each quantile; then values below a bracket are counted, and only the bracket's distinct
    values, under a thousandth of all ranks, are put in order, so no task holds the column.
    """
    d = df.select((F.col(x) if isinstance(x, str) else x).cast("double").alias("v")).where(F.col("v").isNotNull())
    n = d.count()
    if not n:
        return d.agg(*(F.max("v").alias(name) for name in qs))
    wide = 3e-4 + 2 / n  # the approximate ranks' error, and the neighbours
    cuts = d.agg(F.percentile_approx("v", [min(1.0, max(0.0, q + e)) for q in qs.values() for e in (-wide, wide)], 10_000)).first()[0]
    brackets = [(cuts[2 * i], cuts[2 * i + 1]) for i in range(len(qs))]
    v = F.col("v")
    inside = F.filter(F.array(*(F.when(v.between(lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(brackets))), lambda i: i.isNotNull())
    below = d.agg(*(F.count_if(v < lo).alias(f"below{i}") for i, (lo, _) in enumerate(brackets)))
    counts = d.select("v", F.explode(inside).alias("i")).groupBy("i", "v").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v"))).crossJoin(F.broadcast(below))

    def of(i: int, q: float) -> Column:
        at = q * (n - 1)
        rank = lambda k: F.min(F.when((F.col("i") == i) & (F.col("upto") + F.col(f"below{i}") > k), v))
        lo, hi = rank(int(at)), rank(min(int(at) + 1, n - 1))
        return lo + (hi - lo) * (at - int(at))

    return upto.agg(*(of(i, q).alias(name) for i, (name, q) in enumerate(qs.items())))


def quartiles(df: DataFrame, x: str) -> DataFrame:
    """df with quartile 1 to 4 of x: exact edges, right-closed, the lowest value in the first; null stays null."""
    edges = exact_quantiles(df, x, {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75})
    c = F.col(x)
    return df.crossJoin(F.broadcast(edges)).withColumn("quartile", F.when(c.isNull(), None).when(c <= F.col("__q1"), 1).when(c <= F.col("__q2"), 2).when(c <= F.col("__q3"), 3).otherwise(4)).drop("__q1", "__q2", "__q3")


def long_form(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    return df.unpivot(keys, features, "feature", "value")


def drift(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature, moments and null rates in the train and test split, and the shift in deviations of train. All features
    are summed side by side in one pass; what is turned into rows are the two splits' sums."""
    each = [F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev(f).alias("std"), F.avg(F.col(f).isNull().cast("double")).alias("nulls")) for f in features]
    s = df.groupBy("split").agg(F.array(*each).alias("a")).select("split", F.inline("a"))
    one = s.groupBy("feature").agg(*(F.max(F.when(F.col("split") == x, F.col(c))).alias(f"{x}_{c}") for x in ("train", "test") for c in ("mean", "std", "nulls")))
    return one.select("feature", F.col("train_mean").alias("mean_train"), F.col("test_mean").alias("mean_test"), safe_div(F.abs(F.col("test_mean") - F.col("train_mean")), F.col("train_std")).alias("shift"), safe_div(F.col("test_std"), F.col("train_std")).alias("std_ratio"), (F.col("test_nulls") - F.col("train_nulls")).alias("null_delta"))


def drift_summary(d: DataFrame) -> DataFrame:
    """One row: features by the size of their shift, in buckets that exclude each other, its median and maximum, and null rates that move by over 0.1."""
    x, edges = F.col("shift"), (0.1, 0.3, 0.5)
    inside = {"below_0p1": x < edges[0], "from_0p1": (x >= edges[0]) & (x < edges[1]), "from_0p3": (x >= edges[1]) & (x < edges[2]), "from_0p5": x >= edges[2]}
    return d.agg(F.count("*").alias("features"), *(F.count_if(c).alias(n) for n, c in inside.items()), quantile("shift", 0.5).alias("median_shift"), F.max("shift").alias("max_shift"), F.count_if(F.abs("null_delta") > 0.1).alias("null_changes"))


def _grams(batches: Iterator[pd.DataFrame], middle: np.ndarray) -> Iterator[pd.DataFrame]:
    """(i, j, s): of a partition's rows, the sums of products of columns i and j, each less its middle, nulls as 0."""
    k, gram = len(middle), None
    for b in batches:
        x = np.nan_to_num(b.to_numpy(np.float64), nan=0.0) - middle
        gram = x.T @ x if gram is None else gram + x.T @ x
    if gram is not None:
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": i, "j": j, "s": gram[i, j]})


def correlation_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """|r| of every two features, nulls as 0; 0 where one is constant.

    Means come first; then each partition sums the products of its centred rows by one matrix product per batch and sends
    one number per pair, so hundreds of features are no more expressions than a few, and rows are never joined.
    """
    filled = df.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    means = filled.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features))).first()
    middle = np.array([m or 0.0 for m in means])
    sums = filled.mapInPandas(lambda it: _grams(it, middle), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    names = F.array(*map(F.lit, features))
    own = sums.where("i = j").select(F.col("i").alias("k"), F.col("s").alias("v"))
    pairs = sums.where("i < j").join(own.select(F.col("k").alias("i"), F.col("v").alias("vi")), "i").join(own.select(F.col("k").alias("j"), F.col("v").alias("vj")), "j")
    r = F.coalesce(safe_div(F.col("s"), F.sqrt(F.col("vi")) * F.sqrt(F.col("vj"))), F.lit(0.0))
    return pairs.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), F.abs(r).alias("r"))


def duplicate_groups(pairs: DataFrame, features: list[str], threshold: float = 0.999) -> DataFrame:
    """Each feature with the first of those it is tied to by chains of |r| above threshold. The graph has one node per
    feature; labels fall to the least neighbour until none moves."""
    spark = pairs.sparkSession
    n = spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, label int")
    e = pairs.where(F.col("r") > threshold).select("a", "b")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(max(1, len(features).bit_length())):
        low = e.join(n, e.b == n.feature).groupBy("a").agg(F.min("label").alias("low"))
        n = n.join(low, n.feature == low.a, "left").select("feature", F.least("label", F.coalesce("low", "label")).alias("label"))
    first = spark.createDataFrame(list(enumerate(features)), "label int, leader string")
    return n.join(first, "label").select("feature", "leader", (F.col("feature") != F.col("leader")).alias("duplicate"))


def ranked_signals(df: DataFrame, p: str = "p1") -> DataFrame:
    """df with the signal's sign and the rank of |p| among the non-zero, ties by sample_id. Rows are numbered in ranges of
    (|p|, sample_id), so neither all rows nor all rows of one |p| meet in a task. The ranges are written when this is called."""
    d = df.where(F.col(p) != 0).withColumn("__size", -F.abs(F.col(p)))
    return numbered(d, ["__size", "sample_id"], "rank").withColumns({"rank": F.col("rank") + 1, "signal": F.signum(p)}).drop("__size")


def trade_measures(trades: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Per group: trades, turnover (their share of all rows), total, mean, volatility, Sharpe per trade, drawdown and win rate of trades
    (pnl, month, sample_id, from_zero: whether rows that don't trade come before the first one). The equity curve runs over (month, sample_id)."""
    c = equity_curve(trades, by, ["month", "sample_id"], from_zero="from_zero")
    x = F.col("pnl")
    spread = F.coalesce(F.stddev(x), F.lit(0.0))
    return c.groupBy(*by).agg(F.count("*").alias("trades"), (F.count("*") / F.lit(rows)).alias("turnover"), F.sum(x).alias("total"), F.avg(x).alias("mean"), spread.alias("volatility"), F.coalesce(safe_div(F.avg(x), spread), F.lit(0.0)).alias("sharpe"), F.avg((x > 0).cast("double")).alias("win_rate"), F.min("drawdown").alias("max_drawdown"))


def _for_all(groups: DataFrame, measures: DataFrame, by: str) -> DataFrame:
    """A row for every group, all 0 where it has no trade."""
    out = groups.join(measures, by, "left")
    return out.select(by, *(F.coalesce(c, F.lit(0)).cast(measures.schema[c].dataType).alias(c) for c in measures.columns if c != by))


def _first_rank(df: DataFrame, ranked: DataFrame) -> tuple[int, int | None]:
    """(rows, the rank of the first row of all in order of (month, sample_id)); None where it can't trade."""
    one = df.agg(F.count("*").alias("n"), F.min(F.struct("month", "sample_id")).alias("first")).first()
    if not one["n"]:
        return 0, None
    first = ranked.where((F.col("month") == one["first"]["month"]) & (F.col("sample_id") == one["first"]["sample_id"])).select("rank").first()
    return one["n"], first["rank"] if first else None


def trade_curve(df: DataFrame, fraction: float = 0.2, cost_bps: float = 1.0, y: str = "y", p: str = "p1") -> DataFrame:
    """(month, sample_id, pnl, equity, peak, drawdown) of each trade of the largest |p| of a fraction of all rows, in order of (month, sample_id).
    The peak is the highest equity of all rows so far, those that don't trade (equity 0 before the first trade) too."""
    ranked = kept(ranked_signals(df, p), "ranked")
    n, first = _first_rank(df, ranked)
    many = math.ceil(fraction * n)
    t = ranked.where(F.col("rank") <= many).select("month", "sample_id", (F.col("signal") * F.col(y) - cost_bps * 1e-4).alias("pnl"), F.lit(first is None or first > many).alias("from_zero"))
    return equity_curve(t, [], ["month", "sample_id"], from_zero="from_zero").drop("from_zero")


def backtest(df: DataFrame, fraction: float = 0.2, costs: list[float] | None = None, y: str = "y", p: str = "p1") -> DataFrame:
    """Threshold ((1 - fraction) quantile of |p|) and measures (see trade_measures) for each cost, of the largest |p| of a fraction
    of all rows. All 0 without a trade. Ranks are written once, when this is called."""
    spark = df.sparkSession
    ranked = kept(ranked_signals(df, p), "ranked")
    n, first = _first_rank(df, ranked)
    many = math.ceil(fraction * n)
    c = spark.createDataFrame([(float(x),) for x in (COSTS_BPS if costs is None else costs)], "cost_bps double")
    t = ranked.where(F.col("rank") <= many).crossJoin(F.broadcast(c))
    t = t.select("cost_bps", "month", "sample_id", (F.col("signal") * F.col(y) - F.col("cost_bps") * 1e-4).alias("pnl"), F.lit(first is None or first > many).alias("from_zero"))
    limit = exact_quantiles(df, F.abs(p), {"threshold": 1.0 - fraction})
    return _for_all(c, trade_measures(t, ["cost_bps"], max(n, 1)), "cost_bps").crossJoin(F.broadcast(limit))


def month_sample(df: DataFrame, quota: int = 50, slices: int = 32) -> DataFrame:
    """The first rows by id of each month. Slices of a month, dealt by the id, keep their first rows before these meet, so a month's
    task orders quota * slices rows at most."""
    slice_ = Window.partitionBy("month", F.pmod(F.xxhash64("sample_id"), F.lit(slices))).orderBy("sample_id")
    near = df.withColumn("__n", F.row_number().over(slice_)).where(F.col("__n") <= quota)
    return near.withColumn("__n", F.row_number().over(Window.partitionBy("month").orderBy("sample_id"))).where(F.col("__n") <= quota).drop("__n")


def sequence_steps(quotes: DataFrame, steps: int = 16) -> DataFrame:
    """The newest ``steps`` snapshots of each sample, oldest first; short samples are padded in front with their oldest row, marked invalid."""
    w = Window.partitionBy("sample_id").orderBy("seconds_before_predict", "row_id")
    d = quotes.withColumn("back", F.row_number().over(w)).where(F.col("back") <= steps)
    oldest = d.groupBy("sample_id").agg(F.max("back").alias("n"), F.max_by("mid", "back").alias("mid"), F.max_by("spread", "back").alias("spread"))
    pad = oldest.where(F.col("n") < steps).select("sample_id", F.explode(F.sequence(F.col("n") + 1, F.lit(steps))).alias("back"), "mid", "spread", F.lit(0).alias("valid"))
    rows = d.select("sample_id", "back", "mid", "spread", F.lit(1).alias("valid")).unionByName(pad)
    return rows.select("sample_id", (F.lit(steps) - F.col("back")).alias("step"), "mid", "spread", "valid")


def contract_faults(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of all rules, in one pass over the whole table."""
    one = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()))
    return one.unpivot([], list(rules), "rule", "violations")


def table_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("sample_id").alias("n_samples"), F.min("seconds_before_predict").alias("min_seconds"), F.max("seconds_before_predict").alias("max_seconds"), F.count_if(F.col("seconds_before_predict") < 0).alias("ahead"))


def block_starts(spark: SparkSession, n: int, blocks: tuple[int, ...], draws: int, seed: int) -> DataFrame:
    """(block_length, draw, slot): n slots a draw, in circular blocks of adjacent slots whose starts are picked by a hash; the last block is cut at n."""
    sizes = spark.createDataFrame([(b, -(-n // b)) for b in blocks], "block_length long, many long")
    starts = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(sizes)).select("block_length", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("block"))
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in ("block_length", "draw", "block"))))
    starts = starts.withColumn("start", F.conv(F.substring(told, 1, 12), 16, 10).cast("long") % n)
    places = starts.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block_length") - 1))).where(F.col("block") * F.col("block_length") + F.col("step") < n)
    return places.select("block_length", "draw", ((F.col("start") + F.col("step")) % n).alias("slot"))


def block_bootstrap(df: DataFrame, y: str = "y", models: tuple[str, ...] = ("p1", "p2"), reference: str = "p1", blocks: tuple[int, ...] = (1, 2), draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Per model and block length, the mean of the months' cosines with its 95 % percentile interval, the mean difference
    to the reference with its interval, and the months won against it, by circular block bootstrap over months.

    All models are read at the same slots of a draw, so differences stay paired. Months are scored once, over all rows;
    what is resampled are their scores. Months must be three at least, without a gap, and more than the longest block.
    """
    scores = df.groupBy("month").agg(*(cosine(F.col(y), F.col(m)).alias(m) for m in models))
    n, first, last = scores.agg(F.count("*"), F.min("month"), F.max("month")).first()
    if n < 3 or last - first + 1 != n or not all(1 <= b < n for b in blocks) or reference not in models:
        raise ValueError(f"Need the reference among the models and three consecutive months at least, more than a block: {n} months from {first} to {last}")
    scores = scores.select((F.col("month") - first).cast("long").alias("slot"), F.col(reference).alias("base"), *models)
    means = [F.avg(m).alias(m) for m in models] + [F.avg(F.col(m) - F.col("base")).alias(f"{m}_delta") for m in models]
    drawn = block_starts(df.sparkSession, n, blocks, draws, seed).join(F.broadcast(scores), "slot").groupBy("block_length", "draw").agg(*means)
    ends = [quantile(c, q).alias(f"{c}_{e}") for m in models for c in (m, f"{m}_delta") for e, q in (("low", 0.025), ("high", 0.975))]
    whole = scores.agg(*means, *(F.count_if(F.col(m) > F.col("base")).alias(f"{m}_wins") for m in models))
    one = drawn.groupBy("block_length").agg(F.count("*").alias("draws"), *ends).crossJoin(F.broadcast(whole))
    row = lambda m: F.struct(F.lit(m).alias("model"), F.col(m).alias("mean_cosine"), F.col(f"{m}_low").alias("interval_low"), F.col(f"{m}_high").alias("interval_high"), F.col(f"{m}_delta").alias("paired_delta"), F.col(f"{m}_delta_low").alias("delta_low"), F.col(f"{m}_delta_high").alias("delta_high"), F.col(f"{m}_wins").alias("wins_vs_reference"))
    return one.select("block_length", F.lit(n).cast("long").alias("periods"), "draws", F.explode(F.array(*map(row, models))).alias("r")).select("r.model", "block_length", "periods", "draws", *(f"r.{c}" for c in ("mean_cosine", "interval_low", "interval_high", "paired_delta", "delta_low", "delta_high", "wins_vs_reference")))


def window_rows(df: DataFrame, starts: tuple[int, ...] = (36, 48, 60), width: int = 12) -> DataFrame:
    """(kind, val_start, row): training rows before each validation month, one month apart: all of them, and the last ``width`` months."""
    t = df.sparkSession.createDataFrame([("cumulative", v, 0, v - 2) for v in starts] + [("fixed", v, v - 1 - width, v - 2) for v in starts], "kind string, val_start int, lo int, hi int")
    return df.join(F.broadcast(t), F.col("month").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def fraction_sweep(df: DataFrame, cost_bps: float = 1.0, y: str = "y", p: str = "p1") -> DataFrame:
    """Threshold and measures (see trade_measures) for each of FRACTIONS of all rows by |p|; all 0 without a trade. Rows are ranked once, when
    this is called; each adds to the fractions it is in."""
    ranked = kept(ranked_signals(df, p), "ranked")
    n, first = _first_rank(df, ranked)
    spark, many = df.sparkSession, {f: math.ceil(f * n) for f in FRACTIONS}
    limits = exact_quantiles(df, F.abs(p), {f"q{i}": 1.0 - f for i, f in enumerate(FRACTIONS)}).first()
    groups = spark.createDataFrame([(f, limits[f"q{i}"]) for i, f in enumerate(FRACTIONS)], "fraction double, threshold double")
    inside = F.filter(F.array(*(F.struct(F.lit(f).alias("fraction"), F.lit(k).alias("k"), F.lit(first is None or first > k).alias("from_zero")) for f, k in many.items())), lambda s: F.col("rank") <= s["k"])
    t = ranked.select("month", "sample_id", "rank", (F.col("signal") * F.col(y) - cost_bps * 1e-4).alias("pnl"), F.explode(inside).alias("x"))
    t = t.select("month", "sample_id", "pnl", "x.fraction", "x.from_zero")
    return _for_all(groups.select("fraction"), trade_measures(t, ["fraction"], max(n, 1)), "fraction").join(F.broadcast(groups), "fraction")


def month_fraction(df: DataFrame, fraction: float) -> DataFrame:
    """A fraction of each month's rows, rounded, in an order spread by the id. Rows are numbered in ranges of (month, order), so no task
    holds a month; the ranges are written when this is called."""
    d = df.withColumn("__spread", F.pmod(F.col("sample_id") * 7919, F.lit(10007)))
    d = numbered(d, ["month", "__spread", "sample_id"], "__n")
    months = d.groupBy(F.col("month").alias("__m")).agg(F.min("__n").alias("__from"), F.count("*").alias("__of"))
    d = d.join(F.broadcast(months), F.col("month").eqNullSafe(F.col("__m")))  # a row per month
    return d.where(F.col("__n") - F.col("__from") < F.round(F.col("__of") * fraction)).drop("__spread", "__n", "__m", "__from", "__of")


def month_places(df: DataFrame, x: str, rows: int = ROWS) -> DataFrame:
    """df with ``place``: the mean rank, from 1, of x among its month's rows, ties sharing theirs; null for null. Values are counted before
    they are ordered, in ranges of (month, value) whose counts are chained, so no task holds a month."""
    counts = ranged(df.where(F.col(x).isNotNull()).groupBy("month", x).agg(F.count("*").alias("__n")), ["month", x], rows)
    w = Window.partitionBy("month", "range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__below", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    parts = counts.groupBy("month", "range").agg(F.sum("__n").alias("__sum"))
    chain = Window.partitionBy("month").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select(F.col("month").alias("__pm"), F.col("range").alias("__pr"), F.coalesce(F.sum("__sum").over(chain), F.lit(0)).alias("__before"))
    counts = counts.join(parts, F.col("month").eqNullSafe(F.col("__pm")) & (F.col("range") == F.col("__pr")))
    counts = counts.select(F.col("month").alias("__m"), F.col(x).alias("__x"), (F.col("__before") + F.col("__below") + (F.col("__n") + 1) / 2).alias("place"))
    return df.join(counts, F.col("month").eqNullSafe(F.col("__m")) & (F.col(x) == F.col("__x")), "left").drop("__m", "__x")
