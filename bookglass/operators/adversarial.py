"""How well two sets of rows can be told apart: classifiers fitted on one half of the rows, scored on the other, both ways."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookglass.functions.exprs import sum_all
from bookglass.operators.linear import HELD, Fit, chunks, part_products, solve_ridge, span_quantiles
from bookglass.operators.models import boosted_classifier
from bookglass.operators.ranges import kept
from bookglass.operators.research import auc

#: Groups whose digits one number tells.
DIGITS = 39


def halves(df: DataFrame, key: list[str], seed: int = 0) -> Column:
    """0 or 1 by a hash of the key, the same on every run."""
    told = F.md5(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key), F.lit(str(seed))))
    return (F.substring(told, 1, 1) >= "8").cast("int")


def _scores(groups: dict[int, list[tuple[int, bool]]], half: dict[int, int], fits: dict[tuple[int, int], Fit]):
    """Of each row of a cell, a row (group, half, positive, score) per group that it is in and whose other half has a fit."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, x in chunks(batches, HELD // 8):
            out = []
            for c in np.unique(cell).tolist():
                columns = np.ascontiguousarray(x[cell == c].T)
                lacks, n = ~np.isfinite(columns), columns.shape[1]
                for g, positive in groups[c]:
                    if (fit := fits.get((g, half[c]))) is None:
                        continue
                    score = np.full(n, fit.constant)
                    for v, lack, fill, weight in zip(columns, lacks, fit.fill, fit.weights, strict=True):  # by column, so that equal rows score the same
                        score += np.where(lack, fill, v) * weight
                    out.append((np.full(n, g, np.int32), np.full(n, half[c], np.int32), np.full(n, positive), score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], names=["group", "half", "positive", "score"])

    return step


def linear_scores(df: DataFrame, features: list[str], alpha: float) -> DataFrame:
    """(group, half, positive, score) of a ridge on the label, per group: each row is scored by the fit of its group's other half, with that
    half's medians for what is missing. ``df`` has the half, the features and ``told`` (see labelled_auc).

    Rows of one half that are told alike are a cell. A group's half is some cells, so the products and medians of all groups come from
    passes in which a row counts once, however many groups it is in.
    """
    cells = sorted((r["told"], r["half"]) for r in df.select("told", "half").distinct().collect())
    half = {i: h for i, (_, h) in enumerate(cells)}
    groups = {i: [(DIGITS * j + n, digit == 2) for j, code in enumerate(told) for n in range(DIGITS) if (digit := code // 3**n % 3)] for i, (told, _) in enumerate(cells)}
    known = df.sparkSession.createDataFrame([(told, h, i) for i, (told, h) in enumerate(cells) if groups[i]], "told array<long>, half int, cell int")
    d = df.join(F.broadcast(known), ["told", "half"])
    sides: dict[tuple[int, int], list[tuple[int, bool]]] = {}
    for i, own in groups.items():
        for g, positive in own:
            sides.setdefault((g, half[i]), []).append((i, positive))
    keys = list(sides)
    found = span_quantiles(d, F.col("cell"), {j: [i for i, _ in sides[s]] for j, s in enumerate(keys)}, features)
    medians = {s: np.nan_to_num(found[j]) for j, s in enumerate(keys)}
    centre = np.mean(list(medians.values()), axis=0) if medians else np.zeros(len(features))
    sums = part_products(d.withColumn("__one", F.lit(1.0)), F.col("cell"), features, "__one", centre)
    fits, k = {}, len(features)
    for (g, h), own in sides.items():
        total = np.zeros((2 * k + 2,) * 2)
        for i, positive in own:
            labelled = sums[i].copy()  # the label is a cell's own, so it scales the products with it
            labelled[2 * k, :] *= positive
            labelled[:, 2 * k] *= positive
            total += labelled
        fits[g, 1 - h] = solve_ridge(total, medians[g, h], centre, alpha)
    slim = d.select("cell", *(F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)))
    return slim.mapInArrow(_scores(groups, half, fits), "group int, half int, positive boolean, score double")


def boosted_scores(df: DataFrame, groups: list[tuple], by: list[str], features: list[str], rounds: int) -> DataFrame:
    """Scores of boosted trees, two fits per group. Groups are fitted one after another, each on all cores."""
    out = None
    for g in groups:
        own = df.where(reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, g, strict=True)), F.lit(True)))
        for half in (0, 1):
            scored = boosted_classifier(own.where(F.col("half") != half), own.where(F.col("half") == half), features, F.col("positive"), rounds)
            out = scored if out is None else out.unionByName(scored)
    return out


def _pooled(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc, positives, negatives). Scores of two fits have two scales: pairs are counted within a half, and halves are weighed by their pairs."""
    each = auc(scored, "score", F.col("positive"), [*by, "half"])
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return each.groupBy(*by).agg(F.try_divide(F.sum(F.col("auc") * pairs), F.sum(F.when(F.col("auc").isNotNull(), pairs))).alias("auc"), F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))


def labelled_auc(df: DataFrame, labels: list[Column], features: list[str], key: list[str], *, alpha: float = 10.0, seed: int = 0) -> DataFrame:
    """(group, auc, positives, negatives) of adversarial_auc's linear classifier for groups that share rows: ``labels`` has for each group whether a row is
    positive in it, null where it isn't in the group. A row is written, summed and ranked in medians once, whatever its groups, and
    scored in each. The ways in which rows are told (per group a digit of 0 to 2: not in it, negative, positive) must be few."""
    digit = lambda i, x: F.coalesce((x.cast("long") + 1) * 3 ** (i % DIGITS), F.lit(0).cast("long"))
    told = [sum_all([digit(i, x) for i, x in enumerate(labels) if i // DIGITS == j]) for j in range(-(-len(labels) // DIGITS))]
    d = kept(df.select(F.array(*told).cast("array<long>").alias("told"), halves(df, key, seed).alias("half"), *features), "adversarial")
    return _pooled(linear_scores(d, features, alpha), ["group"])


def adversarial_auc(df: DataFrame, positive: Column, features: list[str], key: list[str], by: list[str] | None = None, *, model: str = "linear", alpha: float = 10.0, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(by, auc, positives, negatives): how well a classifier over all features tells positive rows from the others, out of sample.

    Rows fall into two halves by a hash of their key; each is scored by the classifier fitted on the other, so no score
    remembers its own row, and every row counts. 0.5 is no difference. Groups (pairs of blocks, say) must be few. A group
    with rows of one label alone has a null auc. Groups that share rows: see labelled_auc. ``model``: linear (one pass for all groups) or boosted (trees, per group). Fits run when this is called.
    """
    by = by or []
    if model == "linear":
        known = df.where(positive.isNotNull()).select(*by).distinct().collect() if by else [()]
        inside = lambda g: reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, g, strict=True)), F.lit(True))
        found = labelled_auc(df, [F.when(inside(g), positive) for g in known], features, key, alpha=alpha, seed=seed)
        names = ", ".join(["group int", *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)])
        return found.join(F.broadcast(df.sparkSession.createDataFrame([(i, *g) for i, g in enumerate(known)], names)), "group").select(*by, "auc", "positives", "negatives")
    d = kept(df.select(*by, *key, positive.alias("positive"), *(f for f in features if f not in [*by, *key])).where("positive is not null").withColumn("half", halves(df, key, seed)), "adversarial")
    groups = [tuple(r) for r in d.select(*by).distinct().collect()] if by else [()]
    return _pooled(boosted_scores(d, groups, by, features, rounds), by)
