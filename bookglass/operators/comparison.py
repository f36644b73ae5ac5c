"""Comparisons of models, features and splits: reweighted forecasts, shares, nearest features, trends, offsets, attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookglass.functions.exprs import corr_safe, cosine, safe_div
from bookglass.operators.linear import column_quantiles, group_quantiles
from bookglass.operators.ranges import with_previous

#: First and last month of each named part.
SPLITS = [("train", 0, 63), ("stop", 64, 64), ("holdout", 65, 70)]


#: The parts of the fit that is shipped.
SHIP_SPLITS = [("train", 0, 67), ("stop", 68, 68), ("blend", 69, 70)]


def checked_splits(df: DataFrame, splits: list[tuple] = SPLITS) -> DataFrame:
    """split_rows, after one pass that raises ValueError where parts overlap or aren't in order, or one has no rows."""
    for (a, _, hi), (b, lo, _) in zip(splits, splits[1:], strict=False):
        if hi >= lo:
            raise ValueError(f"{b} from month {lo} doesn't follow {a} to month {hi}")
    one = df.agg(*(F.count_if(F.col("month").between(lo, hi)).alias(n) for n, lo, hi in splits)).first()
    if empty := [n for n, _, _ in splits if not one[n]]:
        raise ValueError(f"no rows in {', '.join(empty)}")
    return split_rows(df, splits)


def split_rows(df: DataFrame, splits: list[tuple] = SPLITS) -> DataFrame:
    """df with the name of the part that each month is in; months in none drop."""
    t = df.sparkSession.createDataFrame(splits, "part string, lo int, hi int")
    return df.join(F.broadcast(t), F.col("month").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def month_faults(df: DataFrame, last: int = 70) -> DataFrame:
    """Counts of months that are missing, not whole, negative, past the last one, or below that of the sample before."""
    m = F.col("month").cast("double")
    d = with_previous(df.select("sample_id", "month"), ["sample_id"], {"before": "month"})
    return d.agg(F.count("*").alias("n"), F.count_if(m.isNull()).alias("missing"), F.count_if(m != F.floor(m)).alias("not_whole"), F.count_if(m < 0).alias("negative"), F.count_if(m > last).alias("late"), F.count_if(F.col("month") < F.col("before")).alias("out_of_order"))


def outside_band(train: DataFrame, other: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, outside): values of ``other`` outside the 0.1 % to 99.9 % band of ``train``; nulls are in no count."""
    band = column_quantiles(train, features, {"lo": 0.001, "hi": 0.999})
    rows = other.unpivot([], features, "feature", "value").join(F.broadcast(band), "feature")
    return rows.groupBy("feature").agg(F.count("value").alias("n"), F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("outside"))


def reference_buckets(df: DataFrame, x: str, reference: Column) -> DataFrame:
    """df with ``bucket``: the quartile of x by the exact edges of the reference rows; a null is bucket 0."""
    e = group_quantiles(df.where(reference), [], x, {f"__q{q}": q / 4 for q in (1, 2, 3)})
    above = [F.when(F.col(x) > F.col(f"__q{q}"), 1).otherwise(0) for q in (1, 2, 3)]
    return df.crossJoin(F.broadcast(e)).withColumn("bucket", F.when(F.col(x).isNull(), 0).otherwise(1 + above[0] + above[1] + above[2])).drop("__q1", "__q2", "__q3")


def bucket_shares(df: DataFrame, x: str, split: Column, reference: Column) -> DataFrame:
    """(part, bucket, share, shift): each part's share of rows per reference quartile, and how far it is from the reference's."""
    b = reference_buckets(df.withColumn("__ref", reference), x, F.col("__ref"))
    n = b.groupBy(split.alias("part"), "bucket").agg(F.count("*").alias("n"), F.count_if("__ref").alias("r"))
    # Windows over buckets that are summed already.
    share = F.col("n") / F.sum("n").over(Window.partitionBy("part"))
    own = F.sum("r").over(Window.partitionBy("bucket")) / F.sum("r").over(Window.partitionBy(F.lit(1)))
    return n.select("part", "bucket", share.alias("share"), (share - own).alias("shift"))


def reweighted_forecast(df: DataFrame, x: str, reference: Column, target: Column, y: str = "y", p: str = "p1") -> DataFrame:
    """One row: the target's cosine foretold from the reference's cosine per quartile, weighted by counts, and by estimated
    magnitudes: the target's |y| of a bucket is taken as the reference's root mean square times the root of its rows."""
    b = reference_buckets(df.withColumns({"__r": reference, "__t": target}), x, F.col("__r"))
    a, f, r, t = F.col(y), F.col(p), F.col("__r"), F.col("__t")
    g = b.groupBy("bucket").agg(
        *(F.sum(F.when(r, v)).alias(n) for n, v in (("yp", a * f), ("yy", a * a), ("pp", f * f))),
        F.count_if(r).alias("nr"), F.count_if(t).alias("nt"), F.coalesce(F.sum(F.when(t, f * f)), F.lit(0.0)).alias("tp"), F.sum(F.when(t, a * f)).alias("typ"), F.sum(F.when(t, a * a)).alias("tyy"),
    )
    g = g.withColumns({"cos": F.coalesce(safe_div(F.col("yp"), F.sqrt("yy") * F.sqrt("pp")), F.lit(0.0)), "ty": F.coalesce(safe_div(F.col("yy"), F.col("nr")) * F.col("nt"), F.lit(0.0))})
    return g.agg(
        safe_div(F.sum(F.col("cos") * F.col("nt")), F.sum("nt")).alias("by_count"),
        safe_div(F.sum(F.col("cos") * F.sqrt("ty") * F.sqrt("tp")), F.sqrt(F.sum("ty")) * F.sqrt(F.sum("tp"))).alias("by_magnitude"),
        safe_div(F.sum("typ"), F.sqrt(F.sum("tyy")) * F.sqrt(F.sum("tp"))).alias("actual"),
    )


def kept_features(drift: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, dropped): how many features a drift threshold leaves; a shift at or above it drops, an unknown one stays."""
    t = drift.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double")
    gone = F.coalesce(F.col("shift") >= F.col("threshold"), F.lit(False))
    return drift.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("dropped"))


def nearest_features(df: DataFrame, new: list[str], old: list[str]) -> DataFrame:
    """(feature, nearest, r, duplicate, novel): the old feature of largest |r| for each new one (ties: the first name), nulls as 0.
    Both lists are bounded; one pass of sums, no join of rows."""
    filled = df.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in [*new, *old]))
    one = filled.agg(*(F.coalesce(corr_safe(F.col(a), F.col(b)), F.lit(0.0)).alias(f"{a}|{b}") for a in new for b in old))
    pairs = one.unpivot([], list(one.columns), "pair", "r").select(F.split("pair", r"\|")[0].alias("feature"), F.split("pair", r"\|")[1].alias("other"), F.round(F.abs("r"), 9).alias("r"))
    best = pairs.groupBy("feature").agg(F.min(F.struct((-F.col("r")).alias("r"), "other")).alias("b"))
    return best.select("feature", F.col("b.other").alias("nearest"), (-F.col("b.r")).alias("r"), (F.col("b.r") < -0.9).alias("duplicate"), (F.col("b.r") > -0.55).alias("novel"))


def score_trends(scores: DataFrame, at: str, by: str = "model", value: str = "cosine", ahead: int = 7) -> DataFrame:
    """Per arm: slope and correlation of its score over time, change per period between its ends, and the slope's change over ``ahead`` periods."""
    a, v = F.col(at).cast("double"), F.col(value)
    return scores.groupBy(by).agg(F.regr_slope(v, a).alias("slope"), corr_safe(v, a).alias("r"), safe_div(F.max_by(value, at) - F.min_by(value, at), F.max(a) - F.min(a)).alias("per_period"), (F.regr_slope(v, a) * ahead).alias("projected"))


def best_offset(df: DataFrame, fit: Column, width: float, steps: int = 201, y: str = "y", p: str = "p1") -> DataFrame:
    """One row: the constant, off a grid, whose subtraction from p gives the best cosine on the fitting rows, and its cosine on
    the others. The grid meets six sums, not the rows."""
    a, f = F.col(y), F.col(p)
    s = df.groupBy(fit.alias("__fit")).agg(F.sum(a * f).alias("yp"), F.sum(a).alias("sy"), F.sum(f).alias("sp"), F.sum(f * f).alias("pp"), F.sum(a * a).alias("yy"), F.count("*").alias("n"))
    c = (F.col("id") - (steps - 1) // 2) * (2 * width / (steps - 1))
    score = safe_div(F.col("yp") - F.col("c") * F.col("sy"), F.sqrt(F.col("yy") * (F.col("pp") - 2 * F.col("c") * F.col("sp") + F.col("n") * F.col("c") * F.col("c"))))
    g = s.crossJoin(F.broadcast(df.sparkSession.range(steps).select(c.alias("c")))).withColumn("score", score)
    both = g.groupBy("c").agg(F.max(F.when(F.col("__fit"), F.col("score"))).alias("fitted"), F.max(F.when(~F.col("__fit"), F.col("score"))).alias("held"))
    return both.agg(F.max_by("c", "fitted").alias("offset"), F.max("fitted").alias("fitted_cosine"), F.max_by("held", "fitted").alias("held_cosine"))


def family_value(df: DataFrame, families: dict[str, list[str]], y: str = "y") -> DataFrame:
    """(family, full, standalone, without, marginal, share) of the cosine of summed predictions of all families, of one, of the rest; share is what a family reaches
    alone, of the full cosine. Nothing is refitted: ablation.py does that."""
    total = lambda names: sum((F.col(c) for c in names), F.lit(0.0))
    a = F.col(y)
    one = df.agg(cosine(a, total([c for v in families.values() for c in v])).alias("full"), *(cosine(a, total(v)).alias(f"own_{k}") for k, v in families.items()), *(cosine(a, total([c for o, v in families.items() if o != k for c in v])).alias(f"not_{k}") for k in families))
    rows = one.select("full", F.explode(F.array(*(F.struct(F.lit(k).alias("family"), F.col(f"own_{k}").alias("standalone"), F.col(f"not_{k}").alias("without")) for k in families))).alias("x"))
    return rows.select("x.family", "full", "x.standalone", "x.without", (F.col("full") - F.col("x.without")).alias("marginal"), safe_div(F.col("x.standalone"), F.col("full")).alias("share"))


def importance(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_size, share) of per-row attributions; nulls count as 0."""
    m = df.unpivot([], features, "feature", "value").groupBy("feature").agg(F.avg(F.abs(F.coalesce("value", F.lit(0.0)))).alias("mean_size"))
    return m.withColumn("share", safe_div(F.col("mean_size"), F.sum("mean_size").over(Window.partitionBy(F.lit(1)))))  # a row per feature


def local_top(df: DataFrame, features: list[str], k: int, key: str = "sample_id") -> DataFrame:
    """(key, place, feature, value): the k largest attributions of each row by size, ties by name. Sorted inside the row: no shuffle."""
    each = F.array(*(F.struct((-F.abs(F.col(f))).alias("size"), F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features))
    top = F.slice(F.sort_array(F.filter(each, lambda s: s["value"].isNotNull())), 1, k)
    return df.select(key, F.posexplode(top).alias("place", "x")).select(key, (F.col("place") + 1).alias("place"), "x.feature", "x.value")


def channel_scaling(steps: DataFrame, channels: list[str], train: Column, floor: float = 1e-6, clip: float = 6.0) -> DataFrame:
    """steps with each channel less the training mean, over the training deviation (``floor`` at least), cut to +-``clip``; null: 0."""
    m = steps.where(train).agg(*(F.avg(c).alias(f"__m_{c}") for c in channels), *(F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"__s_{c}") for c in channels))
    z = lambda c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")))
    out = steps.crossJoin(F.broadcast(m))
    return out.select(*(F.when(F.col(c).isNull(), 0.0).otherwise(z(c)).alias(c) if c in channels else F.col(c) for c in steps.columns))
