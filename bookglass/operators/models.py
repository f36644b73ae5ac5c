"""Distributed fits from sufficient statistics and Spark's own learners."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookglass.functions.exprs import safe_div
from bookglass.operators.evaluation import FOLDS
from bookglass.operators.linear import finite, ridge_fits, span_quantiles, with_predictions


def median_impute(df: DataFrame, features: list[str], train) -> DataFrame:
    """Nulls and values that aren't finite as the median of the training rows' finite ones; 0 where a feature has none. The exact medians of all
    features come from two passes when this is called (see span_quantiles); one number per feature is sent back."""
    mid = dict(zip(features, np.nan_to_num(span_quantiles(df.where(train), F.lit(0), {0: [0]}, features)[0]).tolist(), strict=True))
    filled = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c)).otherwise(F.lit(mid.get(c, 0.0)))
    return df.select(*(filled(c).alias(c) if c in features else F.col(c) for c in df.columns))


def standardise(df: DataFrame, features: list[str], train) -> DataFrame:
    """Features less the training mean, over the training population deviation; constants become 0."""
    m = df.where(train).agg(*(F.avg(c).alias(f"__m_{c}") for c in features), *(F.stddev_pop(c).alias(f"__s_{c}") for c in features))
    return df.crossJoin(F.broadcast(m)).select(*(F.coalesce(safe_div(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)).alias(c) if c in features else F.col(c) for c in df.columns))


def blend_weights(df: DataFrame, models: list[str], y: str = "y") -> DataFrame:
    """(model, weight) of the least-squares blend, weights normalised by their sizes: a k x k Gram by one aggregate, solved on the driver."""
    k = len(models)
    g = df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models)), *(F.sum(F.col(a) * F.col(y)).alias(f"b{i}") for i, a in enumerate(models))).first()
    w = np.linalg.lstsq(np.array([[g[f"g{i}_{j}"] for j in range(k)] for i in range(k)]), np.array([g[f"b{i}"] for i in range(k)]), rcond=None)[0]
    w = w / np.abs(w).sum()
    return df.sparkSession.createDataFrame([(m, float(x)) for m, x in zip(models, w, strict=True)], "model string, weight double")


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__x").transform(df)


def ridge(train: DataFrame, test: DataFrame, features: list[str], y: str = "y", alpha: float = 10.0) -> DataFrame:
    """test with ``prediction`` of a ridge on standardised features, missing values filled with the training medians; the constant isn't
    shrunk, and a constant feature has weight 0. Any number of columns is one pass of matrix products over the training rows (see linear.py)."""
    fits = ridge_fits(train.withColumn("__month", F.lit(0)), {0: (0, 0)}, features, y=y, alpha=alpha, month="__month")
    return with_predictions(test, fits, features)


def boosted(train: DataFrame, test: DataFrame, features: list[str], y: str = "y", rounds: int = 10) -> DataFrame:
    """test with ``prediction`` of boosted trees of fixed rounds."""
    fit = GBTRegressor(featuresCol="__x", labelCol=y, maxIter=rounds, maxDepth=4, seed=7).fit(_vector(train, features))
    return fit.transform(_vector(test, features)).drop("__x")


def walk_forward_boosted(df: DataFrame, features: list[str], *, folds: list[tuple] = FOLDS, y: str = "y", rounds: int = 10) -> DataFrame:
    """The validation rows of every fold with ``fold`` and the ``prediction`` of boosted trees of fixed rounds, fitted on the fold's training
    months alone: missing values are those months' medians. Rows without a finite target teach nothing but are predicted. A fold without training
    rows predicts 0. Folds are fitted when this is called, one after the other, each on all executors."""
    months = lambda a, b: F.col("month").between(a, b)
    taught, parts = df.where(finite(y)), []
    for fold, a, b, c, d in folds:
        val = df.where(months(c, d)).withColumn("fold", F.lit(fold))
        train = taught.where(months(a, b)).withColumn("fold", F.lit(fold))
        if train.isEmpty():
            parts.append(val.withColumn("prediction", F.lit(0.0)))
            continue
        both = median_impute(train.withColumn("__train", F.lit(True)).unionByName(val.withColumn("__train", F.lit(False))), features, F.col("__train"))
        filled = both.select(*(F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)), both[y], "__train")
        names = [f"__f{i}" for i in range(len(features))]
        fit = GBTRegressor(featuresCol="__x", labelCol=y, maxIter=rounds, maxDepth=4, seed=7).fit(_vector(filled.where("__train"), names))
        rows = both.where("not __train").withColumns({n: F.col(f).cast("double") for n, f in zip(names, features, strict=True)})
        parts.append(fit.transform(_vector(rows, names)).select(*val.columns, "prediction"))
    return reduce(DataFrame.unionByName, parts)


def boosted_classifier(train: DataFrame, test: DataFrame, features: list[str], positive: Column, rounds: int = 10) -> DataFrame:
    """test with ``score``, the probability of a positive row by boosted trees; missing values are the training medians. Without rows of both
    labels to learn from, all score alike."""
    label = positive.cast("double")
    if train.select(label.alias("y")).distinct().count() < 2 or test.isEmpty():
        return test.withColumn("score", F.lit(0.5))
    both = median_impute(train.withColumn("__train", F.lit(True)).unionByName(test.withColumn("__train", F.lit(False))), features, F.col("__train"))
    rows = _vector(both.withColumn("__y", label), features)
    fit = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=4, seed=7).fit(rows.where("__train"))
    scored = fit.transform(rows.where("not __train")).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*test.columns, "score")


def regimes(df: DataFrame, features: list[str], k: int = 4, key: str = "sample_id") -> DataFrame:
    """(key, regime) by k-means over standardised features."""
    v = _vector(df, features)
    s = StandardScaler(inputCol="__x", outputCol="__z", withMean=True).fit(v).transform(v)
    return KMeans(featuresCol="__z", predictionCol="regime", k=k, seed=7).fit(s).transform(s).select(key, "regime", *features)
