"""Fits from pooled sums, verdicts over periods, trades by threshold, batch scoring.

Linear fits read the rows once: sums of products per group are all that comes to the driver, k x k numbers per group.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookglass.functions.exprs import cosine, safe_div
from bookglass.operators.evaluation import exact_quantiles
from bookglass.operators.linear import grouped_products
from bookglass.operators.ranges import equity_curve, ranged

# Deadband of a direction, exponents of a regime's scale, gain worth keeping, margin of a free pruning.
DEADBAND, ALPHAS, MATERIAL_GAIN, MARGIN = 0.0, (0.0, 0.25, 0.5, 0.75, 1.0, 1.5), 0.0041, 0.001
# Kinds of features by what stands in their names; a name may be of several kinds.
KINDS = {"imbalance": "imbalance|_ofi_|_imb", "return": "return|accel|momentum", "spread": "spread", "depth": "depth", "rate": "rate|intensity|n_total|n_snapshots", "last": "_last$"}


def feature_columns(df: DataFrame, excluded: tuple[str, ...] = ("sample_id", "month", "target")) -> list[str]:
    """All columns but the excluded ones, in their order."""
    return [c for c in df.columns if c not in excluded]


def direction(value: Column, deadband: float = DEADBAND) -> Column:
    """UP, DOWN, or FLAT within the deadband; null for null."""
    return F.when(value > deadband, "UP").when(value < -deadband, "DOWN").when(value.isNotNull(), "FLAT")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def by_kind(features: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """A row per feature and kind that its name matches; the kinds are a few rows."""
    each = F.filter(F.array(*(F.when(F.col("feature").rlike(p), F.lit(k)) for k, p in kinds.items())), lambda k: k.isNotNull())
    return features.withColumn("kind", F.explode(each))


def threshold_trades(df: DataFrame, threshold: float | None = None, fraction: float = 0.2, cost_bps: float = 1.0, y: str = "y", p: str = "p1") -> DataFrame:
    """One row: trades of |p| strictly above a threshold, which is the (1 - fraction) quantile of |p| unless given, with
    turnover (share of rows traded), total, mean, volatility, Sharpe per trade, deepest fall and win rate. All 0 without a trade."""
    if threshold is None:
        limit = exact_quantiles(df, F.abs(p), {"threshold": 1.0 - fraction})
        t = df.crossJoin(F.broadcast(limit))
    else:
        t = df.withColumn("threshold", F.lit(float(threshold)))
    signal = F.when(F.col(p) > F.col("threshold"), 1).when(F.col(p) < -F.col("threshold"), -1).otherwise(0)
    t = t.withColumn("signal", signal).withColumn("pnl", F.when(F.col("signal") != 0, F.col("signal") * F.col(y) - cost_bps * 1e-4))
    first = t.agg(F.min_by(F.col("signal") == 0, F.struct("month", "sample_id")).alias("z")).first()["z"]
    trades = t.where("signal <> 0").withColumns({"one": F.lit(1), "from_zero": F.lit(bool(first))})
    fall = equity_curve(trades.select("one", "month", "sample_id", "pnl", "from_zero"), ["one"], ["month", "sample_id"], from_zero="from_zero").agg(F.min("drawdown").alias("max_drawdown"))
    x = F.col("pnl")
    s = t.agg(F.max("threshold").alias("threshold"), F.count(x).alias("trades"), F.avg(x.isNotNull().cast("double")).alias("turnover"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev(x), F.lit(0.0)).alias("volatility"), F.coalesce(safe_div(F.avg(x), F.stddev(x)), F.lit(0.0)).alias("sharpe"), F.coalesce(F.avg((x > 0).cast("double")), F.lit(0.0)).alias("win_rate"))
    return s.join(fall, F.lit(True), "left").withColumn("max_drawdown", F.coalesce("max_drawdown", F.lit(0.0)))


def sums(df: DataFrame, features: list[str], by: list[str], y: str = "y") -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """(Gram matrix, products with y) of each group, over the rows that lack no value, by one pass of matrix products. Groups must be few: folds, blocks, seeds."""
    return grouped_products(df, features, by, y)


def least_squares(gram: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(gram, b, rcond=None)[0]


def non_negative(gram: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with weights of 0 and more: of all sets of columns (a few) whose own solution has no negative weight, the one that explains most."""
    best, gain = np.zeros(len(b)), 0.0
    for n in range(1, len(b) + 1):
        for s in map(list, combinations(range(len(b)), n)):
            w = least_squares(gram[np.ix_(s, s)], b[s])
            if (w >= 0).all() and w @ b[s] > gain:
                best, gain = np.zeros(len(b)), float(w @ b[s])
                best[s] = w
    return best


def _with_weights(df: DataFrame, weights: dict[tuple, np.ndarray], features: list[str], by: list[str], out: str = "linear") -> DataFrame:
    """df with a weighted sum of its features, by the weights of its group; groups without weights drop. One row per group is broadcast."""
    names = [f"__w{i}" for i in range(len(features))]
    schema = ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in by] + [f"{n} double" for n in names])
    t = df.sparkSession.createDataFrame([(*key, *map(float, w)) for key, w in weights.items()], schema)
    total = sum((F.col(f) * F.col(n) for f, n in zip(features, names, strict=True)), F.lit(0.0))
    return df.join(F.broadcast(t), by).withColumn(out, total).drop(*names)


def walk_forward(rows: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """Validation rows of fold_rows with the predictions of models fitted on their fold's training rows: zero, mean, linear."""
    train, val = rows.where("role = 'train'"), rows.where("role = 'val'")
    fits = {k: least_squares(*g) for k, g in sums(train, features, ["fold"], y).items()}
    means = train.groupBy("fold").agg(F.avg(y).alias("mean"))
    return _with_weights(val, fits, features, ["fold"]).join(F.broadcast(means), "fold").withColumn("zero", F.lit(0.0))


def frozen_blend(rows: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """Validation rows with ``frozen``, the non-negative blend fitted on the validation rows of earlier folds (the first fold
    has none and drops), and ``own``, the blend fitted on the fold itself: what scoring on one's own fit would claim."""
    val = rows.where("role = 'val'")
    per = {k[0]: g for k, g in sums(val, features, ["fold"], y).items()}
    frozen = {}
    for f in per:
        earlier = [per[e] for e in per if e < f]
        if earlier:
            frozen[(f,)] = non_negative(sum(g for g, _ in earlier), sum(b for _, b in earlier))
    own = {(f,): non_negative(*g) for f, g in per.items()}
    return _with_weights(_with_weights(val, own, features, ["fold"], "own"), frozen, features, ["fold"], "frozen")


def family_subsets(train: DataFrame, test: DataFrame, families: dict[str, list[str]], y: str = "y") -> DataFrame:
    """(families, cosine) of a linear fit on each non-empty subset of the families: the Gram matrix of all columns is summed
    once, each subset is solved from its part of it, and all subsets are scored in one pass over the test rows."""
    features = [c for f in families.values() for c in f]
    gram, b = sums(train, features, [], y)[()]
    scores = []
    for n in range(1, len(families) + 1):
        for chosen in combinations(families, n):
            at = [features.index(c) for f in chosen for c in families[f]]
            w = least_squares(gram[np.ix_(at, at)], b[at])
            p = sum((F.col(features[i]) * float(x) for i, x in zip(at, w, strict=True)), F.lit(0.0))
            scores.append(cosine(F.col(y), p).alias("+".join(chosen)))
    one = test.agg(*scores)
    return one.unpivot([], list(one.columns), "families", "cosine")


def grid_on_fresh_seeds(df: DataFrame, weights: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), seeds: tuple[int, ...] = (1, 2, 3), key: str = "sample_id", y: str = "y", a: str = "p1", b: str = "p2") -> DataFrame:
    """Per seed: the weight of a against b that scores best on one half of the rows, its score there, on the other half, and
    the difference, the optimism of choosing. Halves are by a hash of (key, seed); sums of each half give every score."""
    each = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    half = F.when(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("seed").cast("string"))), 1, 1) < "8", 0).otherwise(1)
    mixed = lambda w: F.col(a) * w + F.col(b) * (1 - w)
    s = each.groupBy("seed", half.alias("half")).agg(F.array(*(F.struct(F.lit(w).alias("weight"), cosine(F.col(y), mixed(w)).alias("cosine")) for w in weights)).alias("g"))
    s = s.select("seed", "half", F.inline("g"))
    p = s.groupBy("seed", "weight").agg(F.max(F.when(F.col("half") == 0, F.col("cosine"))).alias("chosen_on"), F.max(F.when(F.col("half") == 1, F.col("cosine"))).alias("fresh"))
    best = p.groupBy("seed").agg(F.max_by(F.struct("weight", "chosen_on", "fresh"), F.struct("chosen_on", "weight")).alias("b"))
    return best.select("seed", "b.weight", "b.chosen_on", "b.fresh", (F.col("b.chosen_on") - F.col("b.fresh")).alias("optimism"))


def student_t(n: int, share: float = 0.95) -> float:
    """The value that |t| of n degrees of freedom stays below with the share's probability, by halving the closed form of its distribution."""

    def inside(t: float) -> float:
        angle = math.atan(t / math.sqrt(n))
        c, term, total = math.cos(angle), 1.0, 0.0
        if n % 2:
            term = c
            for k in range(1, (n - 1) // 2 + 1):
                total += term
                term *= c * c * 2 * k / (2 * k + 1)
            return (angle + math.sin(angle) * total) * 2 / math.pi
        for k in range(1, n // 2 + 1):
            total += term
            term *= c * c * (2 * k - 1) / (2 * k)
        return math.sin(angle) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < share else (low, middle)
    return low


#: The 97.5 % quantiles of Student's t at 1, 2, ... degrees of freedom; the expansion beyond is right to 1e-7.
T_VALUES = [student_t(n) for n in range(1, 60)]


def t_quantile(n: Column) -> Column:
    """The 97.5 % quantile of Student's t at n degrees of freedom; null below one."""
    z = 1.959963984540054
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    many = F.lit(z) + terms[0] / n + terms[1] / (n * n) + terms[2] / (n * n * n)
    return F.when(n < 1, None).when(n <= len(T_VALUES), F.element_at(F.array(*map(F.lit, T_VALUES)), n.cast("int"))).otherwise(many)


def paired_verdict(periods: DataFrame, gain: Column, margin: float = MARGIN, material: float = MATERIAL_GAIN) -> DataFrame:
    """One row over per-period gains: mean, standard error, normal and Student-t interval, periods improved, and what
    follows: free (the normal interval stays above -margin), adds (the t interval is above 0), worth keeping (and at least material)."""
    g = periods.select(gain.alias("g")).agg(F.avg("g").alias("gain"), (F.stddev("g") / F.sqrt(F.count("g"))).alias("se"), F.count_if(F.col("g") > 0).alias("improved"), F.count("g").alias("n"))
    half, t = F.col("se") * 1.96, F.col("se") * t_quantile((F.col("n") - 1).cast("double"))
    g = g.withColumns({"normal_low": F.col("gain") - half, "normal_high": F.col("gain") + half, "t_low": F.col("gain") - t, "t_high": F.col("gain") + t})
    return g.withColumns({"free": F.col("normal_low") > -margin, "adds": F.col("t_low") > 0, "worth_keeping": (F.col("t_low") > 0) & (F.col("gain") >= material)})


def trend(periods: DataFrame, x: str, v: str) -> DataFrame:
    """One row: slope over x with its standard error and 95 % interval over the whole span, start, and the noise of one period (deviation over the root of their number)."""
    s = periods.agg(F.regr_slope(v, x).alias("slope"), F.regr_intercept(v, x).alias("start"), F.regr_sxx(v, x).alias("sxx"), F.regr_sxy(v, x).alias("sxy"), F.regr_syy(v, x).alias("syy"), F.count("*").alias("n"), (F.max(x) - F.min(x)).cast("double").alias("span"), (F.stddev(v) / F.sqrt(F.count(v))).alias("noise"))
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    s = s.withColumn("se", se)
    return s.select("slope", "start", "n", "se", ((F.col("slope") - 1.96 * F.col("se")) * F.col("span")).alias("span_low"), ((F.col("slope") + 1.96 * F.col("se")) * F.col("span")).alias("span_high"), "noise")


def auc(df: DataFrame, score: str, positive: Column, by: list[str], rows: int = 200_000) -> DataFrame:
    """(by, auc, positives, negatives): share of (positive, negative) pairs in order, ties as a half. Counts per value are
    summed in ranges of (by, score), as many as the values need, and chained by the ranges' totals, so no task sees all values
    of a group. Rows without a score count in no pair. The ranges are written when this is called."""
    known = df.withColumns({"__positive": positive, "__score": F.col(score).cast("double")}).where(F.col("__score").isNotNull())
    values = known.groupBy(*by, "__score").agg(F.count_if("__positive").alias("pos"), F.count_if(~F.col("__positive")).alias("neg"))
    v = ranged(values, [*by, "__score"], rows)
    own = v.withColumn("below", F.coalesce(F.sum("neg").over(Window.partitionBy(*by, "range").orderBy("__score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = own.groupBy(*by, "range").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("inside"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    chain = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    part = part.withColumn("before", F.coalesce(F.sum("neg").over(chain), F.lit(0)))
    return part.groupBy(*by).agg(safe_div(F.sum(F.col("inside") + F.col("pos") * F.col("before")), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def regime_scale_grid(df: DataFrame, scale: Column, middle: int, alphas: tuple[float, ...] = ALPHAS, y: str = "y", p: str = "p1") -> DataFrame:
    """(fit, alpha, gain): the exponent of a scale on the prediction that scores best on one half of the months, and what it
    gains on the other half; both ways round."""
    half = (F.col("month") >= middle).cast("int")
    s = df.groupBy(half.alias("half")).agg(cosine(F.col(y), F.col(p)).alias("plain"), F.array(*(F.struct(F.lit(a).alias("alpha"), cosine(F.col(y), F.col(p) * F.pow(scale, F.lit(a))).alias("cosine")) for a in alphas)).alias("g"))
    g = s.select("half", "plain", F.inline("g"))
    best = g.groupBy("half").agg(F.max_by("alpha", F.struct("cosine", "alpha")).alias("alpha"))
    other = g.select((1 - F.col("half")).alias("half"), "alpha", (F.col("cosine") - F.col("plain")).alias("gain"))
    return best.join(other, ["half", "alpha"]).select(F.col("half").alias("fit"), "alpha", "gain")


def score_batch(df: DataFrame, members: dict[str, dict[str, float]], weights: dict[str, float], key: str = "sample_id", deadband: float = DEADBAND) -> DataFrame:
    """(key, each member's contribution, blend, direction). Members are linear in named columns; columns that a member
    needs must be there, others are ignored; members of weight 0 are skipped. An unknown member is an error."""
    used = {m: w for m, w in weights.items() if w != 0}
    if unknown := sorted(set(weights) - set(members)):
        raise ValueError(f"Weights for members that aren't given: {unknown}")
    if missing := sorted({c for m in used for c in members[m]} - set(df.columns)):
        raise ValueError(f"Columns that members need are missing: {missing}")
    parts = {m: sum((F.col(c) * x for c, x in sorted(members[m].items())), F.lit(0.0)) * w for m, w in used.items()}
    out = df.select(key, *(e.alias(f"part_{m}") for m, e in parts.items()))
    out = out.withColumn("blend", sum((F.col(f"part_{m}") for m in parts), F.lit(0.0)))
    return out.withColumn("direction", direction(F.col("blend"), deadband))


def pool_descriptors(df: DataFrame, pool: Column, x: Column) -> DataFrame:
    """(pool, n, static, spread): per pool, the mean of log x as a z-score by the first pool's moments, and its deviation over the first pool's."""
    d = df.select(pool.alias("pool"), F.log(F.greatest(x, F.lit(1e-9))).alias("v"))
    s = d.groupBy("pool").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    first = s.where(F.col("pool") == 0).select(F.col("mean").alias("m0"), F.col("std").alias("s0"))
    return s.crossJoin(F.broadcast(first)).select("pool", "n", safe_div(F.col("mean") - F.col("m0"), F.col("s0")).alias("static"), safe_div(F.col("std"), F.col("s0")).alias("spread"))


def table_checks(df: DataFrame, keys: str, target: str, last_month: int) -> DataFrame:
    """One row of counts: rows, repeated keys, targets that are null or infinite, months out of range."""
    y = F.col(target)
    per = df.groupBy(keys).agg(F.count("*").alias("n"), F.count_if(y.isNull()).alias("no_target"), F.count_if(F.abs(y).isin(float("inf"))).alias("infinite"), F.count_if(~F.coalesce(F.col("month").between(0, last_month), F.lit(False))).alias("bad_month"))
    return per.agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("no_target").alias("no_target"), F.sum("infinite").alias("infinite"), F.sum("bad_month").alias("bad_month"))
