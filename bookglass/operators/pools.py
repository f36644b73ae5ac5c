"""Regimes fitted on each pool of rows, beside those of the first pool: what a description knows of later rows, and what it misses of them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.operators.audit import FLOOR
from bookglass.operators.linear import column_quantiles

FIT = "pool string, variant string, fill array<double>, mean array<double>, spread array<double>, centres array<array<double>>, shares array<double>"


def fit_pools(df: DataFrame, pools: list[str], signals: list[str], *, pool: str = "pool", k: int = 4, seed: int = 7) -> dict[str, tuple]:
    """(fill, mean, spread, centres, shares) of each pool that has rows: medians of the logs, moments of the filled logs, and k-means over the
    standardised ones, centres by falling share. Medians and moments of all pools are two passes; k-means is a fit per pool, so pools are
    few, as splits are. A few numbers per pool, signal and centre come to the driver. A signal without values is 0 everywhere."""
    logs = df.where(F.col(pool).isin(pools)).select(F.col(pool).alias("pool"), *(F.log(F.col(s).cast("double") + FLOOR).alias(s) for s in signals))
    fill = {p: dict.fromkeys(signals, 0.0) for p in pools}
    for r in column_quantiles(logs, signals, {"q": 0.5}, ["pool"]).collect():
        fill[r["pool"]][r["feature"]] = r["q"] or 0.0
    at = lambda s: F.coalesce(*(F.when(F.col("pool") == p, F.lit(v[s])) for p, v in fill.items()))
    filled = logs.select("pool", *(F.when(F.abs(s) < float("inf"), F.col(s)).otherwise(at(s)).alias(s) for s in signals))
    moments = {r["pool"]: r for r in filled.groupBy("pool").agg(*(F.avg(s).alias(f"m_{s}") for s in signals), *(F.stddev_pop(s).alias(f"s_{s}") for s in signals)).collect()}
    out = {}
    for p, m in moments.items():
        mean, spread = [m[f"m_{s}"] for s in signals], [m[f"s_{s}"] + 1e-12 for s in signals]
        z = filled.where(F.col("pool") == p).select(*(((F.col(s) - a) / b).alias(f"__{i}") for i, (s, a, b) in enumerate(zip(signals, mean, spread, strict=True))))
        z = VectorAssembler(inputCols=z.columns, outputCol="__z").transform(z).select("__z")
        fit = KMeans(featuresCol="__z", k=k, seed=seed).fit(z)
        sizes = fit.summary.clusterSizes
        ordered = sorted(((-n, [float(v) for v in c]) for n, c in zip(sizes, fit.clusterCenters(), strict=True)))
        out[p] = ([fill[p][s] for s in signals], mean, spread, [c for _, c in ordered], [-n / sum(sizes) for n, _ in ordered])
    return out


def pool_regimes(df: DataFrame, pools: list[str], signals: list[str], *, pool: str = "pool", key: str = "sample_id", k: int = 4, seed: int = 7) -> DataFrame:
    """(key, pool, variant, regime, centre_<signal>, regime_share, regime_dist): each row of the named pools twice, described by the first
    pool's regimes (static) and by its own pool's (own). The first pool's rows say the same in both.

    Centres are in log units, the share is the fitting pool's rows in the regime, the distance to the centre is in the fitting pool's
    standardised units; of equal distances the more frequent regime is taken. Nulls and signals without a logarithm are the fitting pool's
    medians. Rows of other pools, or none, drop. Fitting happens when this is called; describing is one pass of expressions with the fits,
    two rows a pool, broadcast. Without rows in the first pool there is nothing to describe by: ValueError.
    """
    fits = fit_pools(df, pools, signals, pool=pool, k=k, seed=seed)
    if pools[0] not in fits:
        raise ValueError(f"The first pool has no rows: {pools[0]}")
    table = df.sparkSession.createDataFrame([(p, v, *fits[f]) for p in fits for v, f in (("static", pools[0]), ("own", p))], FIT)
    c = F.col
    rows = df.select(c(key), c(pool).alias("pool"), *(F.log(c(s).cast("double") + FLOOR).alias(f"__{i}") for i, s in enumerate(signals))).join(F.broadcast(table), "pool")
    z = [(F.when(F.abs(f"__{i}") < float("inf"), c(f"__{i}")).otherwise(c("fill")[i]) - c("mean")[i]) / c("spread")[i] for i in range(len(signals))]
    rows = rows.withColumn("z", F.array(*z))
    apart = lambda centre: F.aggregate(F.zip_with(centre, "z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, d: total + d)
    rows = rows.withColumn("near", F.array_min(F.transform("centres", lambda centre, i: F.struct(apart(centre).alias("d"), i.alias("regime")))))
    own = c("centres")[c("near.regime")]
    return rows.select(key, "pool", "variant", "near.regime", *((own[i] * c("spread")[i] + c("mean")[i]).alias(f"centre_{s}") for i, s in enumerate(signals)), c("shares")[c("near.regime")].alias("regime_share"), F.sqrt("near.d").alias("regime_dist"))
