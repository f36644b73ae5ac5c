"""Parameters chosen fold by fold, and how much of their gain is left with other draws of rows and features."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from statistics import fmean, median, pstdev

import numpy as np
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookglass.functions.exprs import cosine
from bookglass.operators.evaluation import FOLDS
from bookglass.operators.linear import finite, fold_parts, part_products, solve_ridge, span_quantiles
from bookglass.operators.models import _vector, median_impute
from bookglass.operators.ranges import kept

#: Parts that rows are dealt in by a hash of their key; a draw takes whole parts.
BAGS = 8
#: Fixed value: the last folds, which the search is scored on.
SEARCH_FOLDS = 3

#: A scorer tells, for candidates, a seed and a fold, the cosine of each candidate there.
Scorer = Callable[[list[dict], int, int], list[float]]


def bag(key: str) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 1), 16, 10).cast("int"), F.lit(BAGS))


def drawn(n: int, share: float, seed: int) -> list[int]:
    """round(share * n) of 0 to n - 1, one at least: the first in the order of the md5 of seed:place. A share of 1 takes all, whatever the seed."""
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return sorted(order[: max(1, round(share * n))])


def ridge_scorer(df: DataFrame, features: list[str], *, folds: list[tuple] = FOLDS, key: str = "sample_id", y: str = "y") -> Scorer:
    """Scores of ridges with the parameters alpha, rows and features (the shares of each that a seed draws; 10, 1 and 1 where not given).

    One pass sums the products of each part of months and bag of rows (see part_products). Any candidate's fit is the sum over the months and
    bags it draws, and its cosine follows from the products of the validation months: more candidates, seeds and folds read no
    more rows. The driver holds (2k + 2)^2 numbers per part and bag, whatever the rows; the passes run when this is called, over rows that are written once. Missing values are the medians of all
    rows of the fold's training months. Rows without a finite target count nowhere. A fold without validation rows scores 0, as do predictions of 0.
    """
    k = len(features)
    spans = {(f, role): s for f, a, b, c, d in folds for role, s in (("train", (a, b)), ("val", (c, d)))}
    rows = kept(df.where(finite(y)).select("month", *dict.fromkeys([key, y, *features])), "tuning")
    part, parts = fold_parts(spans)
    trained = {f: parts[f, "train"] for f, *_ in folds}
    medians = {f: np.nan_to_num(m) for f, m in span_quantiles(rows, part, trained, features).items()}
    centre = np.mean(list(medians.values()), axis=0)
    used = sorted({p for own in parts.values() for p in own})
    sums = part_products(rows.where(part.isin(used)), part * BAGS + bag(key), features, y, centre)
    empty = np.zeros((2 * k + 2,) * 2)
    total = lambda span, bags: sum((sums[p * BAGS + b] for p in parts[span] for b in bags if p * BAGS + b in sums), empty)
    held = {f: total((f, "val"), range(BAGS)) for f in medians}

    def score(candidates: list[dict], seed: int, fold: int) -> list[float]:
        out, trained = [], {}
        val, m = held[fold], medians[fold] - centre
        for c in candidates:
            bags, own = tuple(drawn(BAGS, c.get("rows", 1.0), seed)), np.array(drawn(k, c.get("features", 1.0), seed), dtype=int)
            if bags not in trained:
                trained[bags] = total((fold, "train"), bags)
            part = np.r_[own, k + own, 2 * k, 2 * k + 1]
            fit = solve_ridge(trained[bags][np.ix_(part, part)], medians[fold][own], centre[own], c.get("alpha", 10.0))
            v = np.zeros(2 * k + 2)  # a prediction is this times a row of what the products are of
            v[own], v[k + own], v[2 * k + 1] = fit.weights, fit.weights * m[own], fit.constant + fit.weights @ centre[own]
            size = np.sqrt(max(v @ val @ v, 0.0)) * np.sqrt(val[2 * k, 2 * k])
            out.append(float(val[2 * k] @ v / size) if size > 0 else 0.0)
        return out

    return score


def boosted_scorer(df: DataFrame, features: list[str], *, folds: list[tuple] = FOLDS, y: str = "y") -> Scorer:
    """Scores of boosted trees with the parameters rounds, depth, step and rows (the share that each tree draws; 10, 4, 0.1 and 1 where not
    given). Each fold's rows are made and written once, when a candidate is first scored on it; missing values are its own training
    medians. A fold without training or validation rows scores 0."""
    months = {f: ((a, b), (c, d)) for f, a, b, c, d in folds}
    ready: dict[int, tuple[DataFrame, DataFrame] | None] = {}
    names = [f"__f{i}" for i in range(len(features))]

    def prepared(fold: int) -> tuple[DataFrame, DataFrame] | None:
        if fold not in ready:
            a, b = (F.col("month").between(*s) for s in months[fold])
            both = df.where(finite(y) & (a | b)).select(F.col(y).cast("double").alias("__y"), a.alias("__train"), *(F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)))
            both = median_impute(kept(both, "tuning"), names, F.col("__train"))
            sides = both.where("__train"), both.where("not __train")
            ready[fold] = None if any(s.isEmpty() for s in sides) else tuple(_vector(s, names) for s in sides)
        return ready[fold]

    def score(candidates: list[dict], seed: int, fold: int) -> list[float]:
        sides = prepared(fold)
        if sides is None:
            return [0.0] * len(candidates)
        out = []
        for c in candidates:
            learner = GBTRegressor(featuresCol="__x", labelCol="__y", maxIter=c.get("rounds", 10), maxDepth=c.get("depth", 4), stepSize=c.get("step", 0.1), subsamplingRate=c.get("rows", 1.0), seed=seed)
            out.append(float(learner.fit(sides[0]).transform(sides[1]).agg(cosine(F.col("__y"), F.col("prediction")).alias("c")).first()["c"] or 0.0))
        return out

    return score


def tune(spark: SparkSession, score: Scorer, base: dict, grid: list[dict], *, folds: list[tuple] = FOLDS, seed: int = 42, checks: int = 3, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """(trials, verdict) of a grid of parameters against those in use.

    The grid is scored with ``seed`` on the last SEARCH_FOLDS folds. With ``prune``, candidates below the median of the means so far stop after each fold. Of those
    left, the best (of equals, the first) and the base are scored again with ``checks`` fresh seeds, and with ``seed`` on all folds, in pairs.
    trials: (candidate, parameters, seed, fold, cosine) of all that was scored, candidate 0 being the base.
    verdict: one row: best, its parameters, base_cv and best_cv of the search, claimed_gain; means and deviations over the fresh seeds, honest_gain
    and selection_optimism, what the choice gained by chance; paired_gain over all folds and folds_improved.
    """
    if not grid:
        raise ValueError("a grid needs a candidate")
    each = [base, *grid]
    every = [f for f, *_ in folds]
    searched = every[-SEARCH_FOLDS:]
    known: dict[tuple[int, int, int], float] = {}

    def scored(candidates: list[int], s: int, fold: int) -> None:
        new = [c for c in candidates if (c, s, fold) not in known]
        known.update({(c, s, fold): v for c, v in zip(new, score([each[c] for c in new], s, fold) if new else [], strict=True)})

    mean = lambda c, s, over: fmean(known[c, s, f] for f in over)
    left = list(range(1, len(each)))
    for i, fold in enumerate(searched):
        scored([0, *left], seed, fold)
        if prune and i + 1 < len(searched):
            so_far = {c: mean(c, seed, searched[: i + 1]) for c in left}
            left = [c for c in left if so_far[c] >= median(so_far.values())]
    best = max(left, key=lambda c: mean(c, seed, searched))
    fresh = [seed + 1 + i for i in range(checks)]
    for s in fresh:
        for fold in searched:
            scored([0, best], s, fold)
    for fold in every:
        scored([0, best], seed, fold)
    base_cv, best_cv = (mean(c, seed, searched) for c in (0, best))
    again = {c: [mean(c, s, searched) for s in fresh] for c in (0, best)}
    honest = fmean(again[best]) - fmean(again[0]) if fresh else None
    apart = [known[best, seed, f] - known[0, seed, f] for f in every]
    text = [json.dumps(c, sort_keys=True) for c in each]
    trials = spark.createDataFrame([(c, text[c], s, f, v) for (c, s, f), v in sorted(known.items())], "candidate int, parameters string, seed int, fold int, cosine double")
    row = (best, text[best], base_cv, best_cv, best_cv - base_cv, *(f(again[c]) if fresh else None for c in (best, 0) for f in (fmean, pstdev)), honest, best_cv - base_cv - honest if fresh else None, fmean(apart), sum(d > 0 for d in apart), len(every))
    names = "best int, parameters string, base_cv double, best_cv double, claimed_gain double, tuned_mean double, tuned_std double, base_mean double, base_std double, honest_gain double, selection_optimism double, paired_gain double, folds_improved int, n_folds int"
    return trials, spark.createDataFrame([row], names)
