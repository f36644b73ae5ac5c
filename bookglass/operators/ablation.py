"""What families of features are worth: every subset of them refitted on every fold, from one pass over the training rows and one over the validation rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.functions.exprs import safe_div
from bookglass.operators import evaluation as ev
from bookglass.operators.linear import finite, fold_products, matrix, solve_ridge
from bookglass.operators.ranges import kept

SCORE = "fold int, subset int, yp double, yy double, pp double"


def subsets(families: dict[str, list[str]]) -> list[tuple[str, ...]]:
    """All subsets but the empty one, smallest first. Their number doubles with each family: families are few."""
    return [chosen for n in range(1, len(families) + 1) for chosen in combinations(families, n)]


def _scores(fits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Of each task, the sums y p, y y and p p of each (fold, subset); all subsets of a fold are one matrix product."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold, y, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False), matrix(b, 2)
            for f in np.unique(fold):
                fill, weights, constants = fits[int(f)]
                own, target = x[fold == f], y[fold == f]
                p = np.where(np.isfinite(own), own, fill) @ weights + constants
                total = sums.setdefault(int(f), np.zeros((3, p.shape[1])))
                total += np.stack([target @ p, np.full(p.shape[1], target @ target), (p * p).sum(0)])
        for f, total in sums.items():
            n = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.int32()), pa.array(range(n), pa.int32()), *map(pa.array, total)], names=["fold", "subset", "yp", "yy", "pp"])

    return step


def subset_scores(df: DataFrame, families: dict[str, list[str]], *, folds: list[tuple] = ev.FOLDS, y: str = "y", alpha: float = 10.0) -> DataFrame:
    """(families, n_families, n_features, fold, cosine): a ridge on each subset of the families, refitted on each fold's training months.

    The subsets' fits are parts of the sums of all features (see linear.py), so more subsets read no more rows; the rows are written once and the sums
    taken when this is called.
    Rows without a finite target count nowhere; missing values are the fold's medians; a fold without validation rows has no score, and
    predictions or targets that are all 0 score 0.
    """
    features = [c for names in families.values() for c in names]
    at = {f: [features.index(c) for c in names] for f, names in families.items()}
    k, chosen = len(features), subsets(families)
    df = kept(df.where(finite(y)).select("month", *dict.fromkeys([y, *features])), "ablation")
    totals, medians, centre = fold_products(df, {f: (a, b) for f, a, b, _, _ in folds}, features, y=y)
    fits = {}
    for fold, total in totals.items():
        weights, constants = np.zeros((k, len(chosen))), np.zeros(len(chosen))
        for j, names in enumerate(chosen):
            own = np.array(sorted(i for n in names for i in at[n]), dtype=int)
            part = np.r_[own, k + own, 2 * k, 2 * k + 1]
            fit = solve_ridge(total[np.ix_(part, part)], medians[fold][own], centre[own], alpha)
            weights[own, j], constants[j] = fit.weights, fit.constant
        fits[fold] = (medians[fold], weights, constants)
    known = F.broadcast(df.sparkSession.createDataFrame([(f, c, d) for f, _, _, c, d in folds], "__fold int, __lo int, __hi int"))
    rows = df.join(known, F.col("month").between(F.col("__lo"), F.col("__hi"))).select("__fold", F.col(y).cast("double"), *(F.col(f).cast("double") for f in features))
    sums = rows.mapInArrow(_scores(fits), SCORE).groupBy("fold", "subset").agg(*(F.sum(c).alias(c) for c in ("yp", "yy", "pp")))
    names = df.sparkSession.createDataFrame([(j, "+".join(c), len(c), sum(len(families[f]) for f in c)) for j, c in enumerate(chosen)], "subset int, families string, n_families int, n_features int")
    cosine = F.coalesce(safe_div(F.col("yp"), F.sqrt("yy") * F.sqrt("pp")), F.lit(0.0))
    return sums.join(F.broadcast(names), "subset").select("families", "n_families", "n_features", "fold", cosine.alias("cosine"))


def ablation(scores: DataFrame) -> DataFrame:
    """(families, n_families, n_features, cosine_mean, cosine_std, cosine_min, worst_fold) of subset_scores, over the folds."""
    s = ev.stability(scores, by=["families", "n_families", "n_features"])
    return s.select("families", "n_families", "n_features", F.col("mean").alias("cosine_mean"), F.col("std").alias("cosine_std"), F.col("lowest").alias("cosine_min"), "worst_fold")


def marginal_values(table: DataFrame, families: list[str]) -> DataFrame:
    """(family, n_features, standalone, without_it, marginal_gain, share_of_full) of ablation's rows: what the full set loses without a family,
    and how much of the full set's score the family reaches alone. A family that is the only one has nothing to compare with: null."""
    spark = table.sparkSession
    names = spark.createDataFrame([(f, "+".join(families), "+".join(x for x in families if x != f)) for f in families], "family string, whole string, rest string")
    score = lambda name, value: table.select(F.col("families").alias(name), F.col("cosine_mean").alias(value))
    own = table.select(F.col("families").alias("family"), "n_features", F.col("cosine_mean").alias("standalone"))
    x = names.join(own, "family").join(score("whole", "full"), "whole").join(score("rest", "without_it"), "rest", "left")
    return x.select("family", "n_features", "standalone", "without_it", (F.col("full") - F.col("without_it")).alias("marginal_gain"), safe_div(F.col("standalone"), F.col("full")).alias("share_of_full"))
