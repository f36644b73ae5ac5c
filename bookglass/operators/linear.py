"""Quantiles of many columns and groups, and linear fits over hundreds of columns, from sums that tasks add up by themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookglass.operators.evaluation import FOLDS
from bookglass.operators.ranges import kept, small

#: Ranks that an approximate pass tells apart. Of a group with up to ten times as many values all are put in order: a bracket is sure to
#: hold a quantile and its neighbour only beyond, and fewer bound a task anyway.
ACCURACY = 2000
#: Rows of a matrix that are sent together; the parts that tasks' sums of them are added up in first.
BLOCK, SALTS = 64, 32


def _joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left and right where all of by are equal, nulls too."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in by})
    met = reduce(Column.__and__, (left[c].eqNullSafe(F.col(f"__{c}")) for c in by), F.lit(True))
    return left.join(named, met, how).drop(*(f"__{c}" for c in by))


def group_quantiles(df: DataFrame, by: list[str], x: str, qs: dict[str, float]) -> DataFrame:
    """(by, quantiles): exact, linearly interpolated quantiles of x per group; null where a group has no value.

    A first pass counts a group's values and brackets each quantile approximately; a second counts the values below a
    bracket and each distinct value in it. Only these, a few thousandths of a group, are put in order, so neither a group nor
    a column needs to fit anywhere; both passes add up in each task before they shuffle. The first pass runs when this is called.
    NaN is a null. Null keys are a group.
    """
    v = F.col(x).cast("double")
    d = df.select(*by, F.when(~F.isnan(v), v).alias("__v"))
    wide = 3 / ACCURACY
    ends = [min(1.0, max(0.0, q + e)) for q in qs.values() for e in (-wide, wide)]
    first = kept(d.groupBy(*by).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", ends, ACCURACY).alias("__ends")), "brackets")
    known = small(first)
    inf = F.lit(float("inf"))
    every = F.col("__n") <= 10 * ACCURACY
    marks = []
    for i in range(len(qs)):
        low, high = F.when(every, -inf).otherwise(F.col("__ends")[2 * i]), F.when(every, inf).otherwise(F.col("__ends")[2 * i + 1])
        mark = lambda value, i=i: F.struct(F.lit(i).alias("i"), value.alias("v"))
        marks.append(F.when(F.col("__v") < low, mark(F.lit(None).cast("double"))).when(F.col("__v") <= high, mark(F.col("__v"))))
    found = _joined(d, known, by).select(*by, "__n", F.inline(F.filter(F.array(*marks), lambda m: m.isNotNull())))
    counts = found.groupBy(*by, "__n", "i", "v").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first())))

    def of(i: int, q: float) -> Column:
        at = F.lit(q) * (F.col("__n") - 1)
        rank = lambda k: F.min(F.when((F.col("i") == i) & F.col("v").isNotNull() & (F.col("upto") > k), F.col("v")))
        low, high = rank(F.floor(at)), rank(F.least(F.floor(at) + 1, F.col("__n") - 1))
        return low + (high - low) * F.max(at - F.floor(at))

    out = upto.groupBy(*by).agg(*(of(i, q).alias(n) for i, (n, q) in enumerate(qs.items())))
    return _joined(first.select(*by), out, by, "left")


def long_values(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, at, value): a row per row and feature, told by its place in the list; values that aren't finite are null."""
    finite = [F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")) for f in features]
    return df.select(*keys, F.posexplode(F.array(*finite)).alias("at", "value"))


def column_quantiles(df: DataFrame, features: list[str], qs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, quantiles) of the finite values of many columns, per group."""
    q = group_quantiles(long_values(df, features, keys or []), [*(keys or []), "at"], "value", qs)
    names = F.array(*map(F.lit, features))
    return q.select(*(keys or []), F.element_at(names, F.col("at") + 1).alias("feature"), *qs)


#: Values of a column that a task holds at once, over all columns; of a column's run, the least and the most samples that stand for it
#: (a sixteenth of it in between), and the distinct values of a bracket that are sent whole.
HELD, LEAST, MOST, WHOLE = 4_000_000, 128, 2048, 65_536


def matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """The columns of a batch from ``first`` on, as doubles."""
    columns = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[first:]]
    return np.column_stack(columns) if columns else np.empty((batch.num_rows, 0))


def chunks(batches: Iterable[pa.RecordBatch], values: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first column, matrix of the others) of batches put together until they hold so many values."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        held.append((b.column(0).to_numpy(zero_copy_only=False), matrix(b, 1)))
        if sum(x.size for _, x in held) >= values:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _sampled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(samples, how many values each ends, values that may hide below the next sample) of values in order, the last one included."""
    step = max(-(-len(v) // MOST), min(16, -(-len(v) // LEAST)), 1)
    at = np.unique(np.r_[np.arange(step - 1, len(v), step), len(v) - 1]) if len(v) else np.empty(0, int)
    return v[at], np.diff(at, prepend=-1), step - 1


def _brackets(units: dict[int, list[int]], low: np.ndarray | None, high: np.ndarray | None, k: int):
    """Of each HELD values of a task, a row per unit of parts and column: its values below the bracket, all of its values, and samples of those in it
    (all of them, if few are distinct). Without brackets all values are in."""
    names = ["at", "unit", "below", "n", "slack", "v", "w"]

    def told(part: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        for u, own in units.items():
            columns = np.ascontiguousarray(x[np.isin(part, own)].T)
            if not columns.shape[1]:
                continue
            columns[~np.isfinite(columns)] = np.nan
            if low is None:
                columns.sort(axis=1)  # nan last
            for j in range(k) if low is None else np.flatnonzero(~np.isnan(low[u])):
                c = columns[j]
                if low is None:
                    below, n = 0, int(len(c) - np.isnan(c).sum())
                    v, w, slack = _sampled(c[:n])
                else:
                    below, n = int((c < low[u, j]).sum()), int(len(c) - np.isnan(c).sum())
                    c = c[(c >= low[u, j]) & (c <= high[u, j])]
                    v, w = np.unique(c, return_counts=True)
                    slack = 0
                    if len(v) > WHOLE:
                        v, w, slack = _sampled(np.sort(c))
                if n:
                    for o, value in zip(out, (j, u, below, n, slack, v, w), strict=True):
                        o.append(value)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=names)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (told(part, x) for part, x in chunks(batches, HELD))

    return step


def _narrowed(q: float, members: dict[int, list[int]], lowest: np.ndarray | None):
    """Per column, for each span made of the units given: its quantile, or where that is unsure a narrower bracket that is sure to hold it and its neighbour."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for span, units in members.items():
            own = pdf[pdf["unit"].isin(units)]
            n = int(own["n"].sum())
            if not n:
                continue
            below, slack = int(own["below"].sum()), int(own["slack"].sum())
            v, w = np.concatenate(own["v"].to_list()), np.concatenate(own["w"].to_list())
            order = np.argsort(v, kind="stable")
            v, upto = v[order], below + np.cumsum(w[order])
            place = q * (n - 1)
            first = int(np.floor(place))
            high = v[np.searchsorted(upto, min(first + 1, n - 1) + 1)]
            less = np.r_[below, upto][np.searchsorted(v, v)]  # known to be below each sample
            sure = v[less + slack <= first]
            at = int(pdf["at"].iloc[0])
            before = -np.inf if lowest is None else lowest[span, at]
            low = v[np.searchsorted(upto, first + 1)] if not slack else sure[-1] if len(sure) else before
            done = not slack or low == high
            out.append((span, at, low, high, low + (high - low) * (place - first) if done else np.nan))
        return pd.DataFrame(out, columns=["span", "at", "low", "high", "value"])

    return step


def span_quantiles(df: DataFrame, part: Column, spans: dict[int, list[int]], features: list[str], q: float = 0.5) -> dict[int, np.ndarray]:
    """Exact, linearly interpolated quantiles of the finite values of many columns per span, which is some of the parts; nan where it has none.

    Spans may share parts, as expanding folds do: values are sampled once per part, in order, so that no row is copied for a span or a
    column. The samples bracket each quantile surely; a second pass sends what lies in the brackets, about a hundredth, and a further one is made
    only where that is still much. The passes run when this is called, over df as it is: write it before, if making it costs. Spans, parts and
    columns must be few; a task holds HELD values, and a column's samples meet in one.
    """
    k, at = len(features), {s: i for i, s in enumerate(spans)}
    rows = df.select(part.cast("int").alias("part"), *(F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)))
    rows = rows.where(F.col("part").isin(sorted({p for own in spans.values() for p in own})))
    parts = {i: list(spans[s]) for s, i in at.items()}
    value = np.full((len(spans), k), np.nan)
    low = high = None
    while k and spans:
        units = {p: [p] for own in parts.values() for p in own} if low is None else {i: own for i, own in parts.items() if not np.isnan(low[i]).all()}
        members = parts if low is None else {i: [i] for i in units}
        sent = rows.mapInArrow(_brackets(units, low, high, k), "at int, unit int, below long, n long, slack long, v array<double>, w array<long>")
        found = sent.groupBy("at").applyInPandas(_narrowed(q, members, low), "span int, at int, low double, high double, value double").collect()
        low, high = np.full((len(spans), k), np.nan), np.full((len(spans), k), np.nan)
        for r in found:
            if r["value"] is None or np.isnan(r["value"]):
                low[r["span"], r["at"]], high[r["span"], r["at"]] = r["low"], r["high"]
            else:
                value[r["span"], r["at"]] = r["value"]
        if np.isnan(low).all():
            break
    return {s: value[i] for s, i in at.items()}


def finite(name: str) -> Column:
    return F.abs(F.col(name).cast("double")) < float("inf")


def _products(centre: np.ndarray):
    """Of each task, rows (part, block, sums): A'A over its rows of a part, BLOCK rows of the matrix a row, from the block's diagonal on; A
    holds the values less their centre (0 where there is none), 1 where there is none, the target, and 1."""
    k = len(centre)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            part, y = b.column(0).to_numpy(zero_copy_only=False), b.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = matrix(b, 2)
            lacks = ~np.isfinite(x)
            z = np.where(lacks, 0.0, x - centre)
            some = np.flatnonzero(lacks.any(0))  # few columns lack values, and only these have products
            a = np.column_stack([z, lacks[:, some].astype(float), y, np.ones(len(y))])
            at = np.r_[np.arange(k), k + some, 2 * k, 2 * k + 1]
            for p in np.unique(part):
                rows = a[part == p]
                total = sums.setdefault(int(p), np.zeros((2 * k + 2, 2 * k + 2)))
                total[np.ix_(at, at)] += rows.T @ rows
        for p, total in sums.items():
            for i in range(0, 2 * k + 2, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([i], pa.int32()), pa.array([total[i : i + BLOCK, i:].ravel()], pa.list_(pa.float64()))], names=["part", "block", "sums"])

    return step


def part_products(df: DataFrame, part: Column, features: list[str], y: str, centre: np.ndarray) -> dict[int, np.ndarray]:
    """A'A of each part (see _products), in one pass over the rows. Rows without a finite target are left out.

    Tasks add up their rows by matrix products; their sums, BLOCK rows of the matrix at a time, are added in two steps, so the sums of
    all tasks never meet in one. (2k + 2)^2 / 2 numbers per part come to the driver: parts must be few, as
    the spans of months between the ends of folds are.
    """
    k = len(features)
    rows = df.where(F.abs(F.col(y).cast("double")) < float("inf")).select(part.cast("int").alias("part"), F.col(y).cast("double"), *(F.col(f).cast("double") for f in features))
    schema = "part int, block int, sums array<double>"
    add = lambda pdf: pd.DataFrame({"part": pdf["part"].iloc[:1], "block": pdf["block"].iloc[:1], "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})
    salted = rows.mapInArrow(_products(centre), schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    once = salted.groupBy("part", "block", "salt").applyInPandas(add, schema)
    whole = once.groupBy("part", "block").applyInPandas(add, schema)
    out: dict[int, np.ndarray] = {}
    for r in whole.toLocalIterator():
        total, i = out.setdefault(r["part"], np.zeros((2 * k + 2, 2 * k + 2))), r["block"]
        total[i : i + BLOCK, i:] = np.reshape(r["sums"], (-1, 2 * k + 2 - i))
    return {p: np.triu(m) + np.triu(m, 1).T for p, m in out.items()}


@dataclass
class Fit:
    """A linear fit: what stands in for a missing value, a weight per feature, and the constant."""

    fill: np.ndarray
    weights: np.ndarray
    constant: float


def solve_ridge(total: np.ndarray, fill: np.ndarray, centre: np.ndarray, alpha: float) -> Fit:
    """A ridge on standardised features with missing values filled, from the sums of part_products; the constant isn't shrunk.

    Filling is algebra on the sums: with m the fill less the centre, a filled column is z + m * lacks. A constant feature has weight 0.
    """
    k = len(fill)
    z, lacks, y, one = slice(0, k), slice(k, 2 * k), 2 * k, 2 * k + 1
    n = total[one, one]
    if not n:
        return Fit(fill, np.zeros(k), 0.0)
    m = fill - centre
    gram = total[z, z] + total[z, lacks] * m + (total[z, lacks] * m).T + total[lacks, lacks] * np.outer(m, m)
    mean = (total[z, one] + m * total[lacks, one]) / n
    target = total[y, one] / n
    right = total[z, y] + m * total[lacks, y] - n * mean * target
    gram = gram - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(gram) / n, 0.0))
    rounding = np.maximum(1e-12 * np.abs(mean + centre), 1e-8 * np.sqrt(np.diag(total)[z] / n))
    spread[spread <= rounding] = 0.0  # what is left of a constant
    scale = np.where(spread > 0, spread, 1.0)
    moved = np.where(spread > 0, 1.0, 0.0)
    weights = np.linalg.solve(gram * np.outer(moved / scale, moved / scale) + alpha * np.eye(k), right * moved / scale) / scale
    return Fit(fill, weights, float(target - weights @ (mean + centre)))


def fold_parts(spans: dict[int, tuple[int, int]], month: str = "month") -> tuple[Column, dict[int, list[int]]]:
    """(the part of a row's month, the parts of each span): months are cut at the spans' ends alone."""
    cuts = sorted({a for lo, hi in spans.values() for a in (lo, hi + 1)})
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(month)))
    return part, {f: list(range(cuts.index(lo) + 1, cuts.index(hi + 1) + 1)) for f, (lo, hi) in spans.items()}


def fold_products(df: DataFrame, spans: dict[int, tuple[int, int]], features: list[str], *, y: str = "y", month: str = "month") -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], np.ndarray]:
    """(sums of part_products, medians) of each span of training months, and the centre that the sums are taken about.

    Spans overlap, as expanding folds do; the products are summed once per part of months and added up per span. Values
    that aren't finite are missing; a feature without values has a median of 0, and a span without rows has sums of 0. Three passes
    over df run when this is called: write it before, if making it costs.
    """
    rows = df.where(finite(y))
    part, parts = fold_parts(spans, month)
    medians = {f: np.nan_to_num(m) for f, m in span_quantiles(rows, part, parts, features).items()}
    centre = np.mean(list(medians.values()), axis=0)
    inside = reduce(Column.__or__, (F.col(month).between(lo, hi) for lo, hi in spans.values()))
    sums = part_products(rows.where(inside), part, features, y, centre)
    empty = np.zeros((2 * len(features) + 2,) * 2)
    return {f: sum((sums[p] for p in parts[f] if p in sums), empty) for f in spans}, medians, centre


def ridge_fits(df: DataFrame, spans: dict[int, tuple[int, int]], features: list[str], *, y: str = "y", alpha: float = 10.0, month: str = "month") -> dict[int, Fit]:
    """A ridge per span of training months, each with the medians of its own rows in place of missing values (see fold_products).
    A feature without values is 0 everywhere; a span without rows predicts 0."""
    totals, medians, centre = fold_products(df, spans, features, y=y, month=month)
    return {f: solve_ridge(totals[f], medians[f], centre, alpha) for f in spans}


def with_predictions(df: DataFrame, fits: dict[int, Fit], features: list[str], *, fold: str | None = None, name: str = "prediction") -> DataFrame:
    """df with the prediction of its fold's fit (of the only fit, without a fold); rows of folds without a fit drop."""
    keep = [c for c in df.columns if c != name]
    only = None if fold else next(iter(fits.values()))

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, len(keep))
            p = np.full(len(x), np.nan)
            which = b.column(keep.index(fold)).to_numpy(zero_copy_only=False) if fold else None
            for f, fit in fits.items() if fold else [(None, only)]:
                own = which == f if fold else np.ones(len(x), bool)
                rows = x[own]
                p[own] = np.where(np.isfinite(rows), rows, fit.fill) @ fit.weights + fit.constant
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(p)], names=[*keep, name])

    known = df.where(F.col(fold).isin(list(fits))) if fold else df
    wide = known.select(*keep, *(F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` double"])
    return wide.mapInArrow(step, schema)


def walk_forward_ridge(df: DataFrame, features: list[str], *, folds: list[tuple] = FOLDS, y: str = "y", alpha: float = 10.0) -> DataFrame:
    """The validation rows of every fold with ``fold`` and the ``prediction`` of the ridge fitted on the fold's training months. The rows
    are written once, when this is called: four passes read them."""
    df = kept(df, "ridge")
    fits = ridge_fits(df, {f: (a, b) for f, a, b, _, _ in folds}, features, y=y, alpha=alpha)
    t = F.broadcast(df.sparkSession.createDataFrame([(f, c, d) for f, _, _, c, d in folds], "fold int, __lo int, __hi int"))
    val = df.join(t, F.col("month").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    return with_predictions(val, fits, features, fold="fold")


def grouped_products(df: DataFrame, features: list[str], by: list[str], y: str) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """(Gram matrix, products with y) per group, over the rows where all features and y are finite. Groups must be few: folds, blocks, seeds."""
    whole = df.where(reduce(Column.__and__, (F.abs(F.col(c).cast("double")) < float("inf") for c in [*features, y])))
    keys = [tuple(r) for r in whole.select(*by).distinct().collect()] if by else [()]
    part = F.lit(0)
    for i, key in enumerate(keys):
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, key, strict=True)), F.lit(True))
        part = F.when(same, i).otherwise(part)
    sums, k = part_products(whole, part, features, y, np.zeros(len(features))), len(features)
    return {key: (sums[i][:k, :k], sums[i][:k, 2 * k]) for i, key in enumerate(keys) if i in sums}
