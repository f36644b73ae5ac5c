"""Exact centroid clustering of integer vectors, with bounds that are loosened by the geometry of each move."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.llm.common import prepare, written

#: Share of a bound given away, so that rounding of doubles never makes it too tight.
SLACK = 1e-9
STATE = "id long, v array<long>, cluster int, distance long, lower array<double>, scans int"
PARTIAL = "cluster int, n long, far long, sums array<long>"


def kept_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: float = 64.0) -> DataFrame:
    """(id, v): vectors of exactly dims components, each turned into floor(scale * x).

    Null vectors and those with another length, a null, a non-finite component, or one so large that squared distances
    don't fit a long, are left out.
    """
    most = float(isqrt(2**61 // dims))
    x = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(scale) * c.cast("double")))
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(F.lit(scale) * c.cast("double")) < most)
    whole = (F.size(vector_col) == dims) & F.forall(F.col(vector_col), fits)
    return df.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:id`, in ascending order; repeated ids come in the order of their vectors."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: how much nearer centroid j may have come, by its move, to any vector of cluster i.

    The vectors lie in a sphere about the cluster's old centroid. For a centroid that moves by d, all of a point's gain
    d(x, old) - d(x, new) is at most d * cos(a), where a is the angle at the middle of the move between its direction and
    the point (the hyperbola through the point lies inside its asymptotes), and 0 behind the middle. In the plane of the
    sphere's centre and the move, the least angle in the sphere is that of the centre less arcsin(radius / distance).
    So a move aside or away loosens less than the full drift d, and none loosens more.
    """
    c, m = old.astype(np.float64), new.astype(np.float64)
    drift = np.sqrt(((m - c) ** 2).sum(1))
    out = np.zeros((len(old), len(old)))
    for j in np.flatnonzero(drift > 0):
        away = c - (c[j] + m[j]) / 2
        far = np.sqrt((away**2).sum(1))
        inside = far <= radius * (1 + SLACK)
        safe = np.where(far > 0, far, 1)
        angle = np.arccos(np.clip(away @ (m[j] - c[j]) / (safe * drift[j]), -1, 1))
        least = np.maximum(0, angle - np.arcsin(np.clip(radius / safe, 0, 1)) - SLACK)
        out[:, j] = np.where(inside, drift[j], drift[j] * np.maximum(0, np.cos(least)))
    return out * (1 + SLACK)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _scan(v: np.ndarray, centroids: np.ndarray, ambiguous: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest of the ambiguous centroids of each vector (ties: the smaller number), its squared distance, and the bounds made exact."""
    best, own = np.full(len(v), -1), np.full(len(v), np.iinfo(np.int64).max)
    lower = lower.copy()
    for j, c in enumerate(centroids):
        at = np.flatnonzero(ambiguous[:, j])
        d = ((v[at] - c) ** 2).sum(1)
        lower[at, j] = _root(d) * (1 - SLACK)
        nearer = d < own[at]
        best[at[nearer]], own[at[nearer]] = j, d[nearer]
    return best, own, lower


def _assigned(centroids: np.ndarray, loosen: np.ndarray | None):
    """A step over batches: the first scans all centroids for each vector; later ones those alone that its bounds don't keep away."""
    k, dims = centroids.shape

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b, dims)
            at = np.arange(len(v))
            if loosen is None:
                lower, scans = np.zeros((len(v), k)), np.zeros(len(v), np.int32)
                ambiguous = np.ones((len(v), k), bool)
            else:
                cluster, scans = b.column("cluster").to_numpy(), b.column("scans").to_numpy()
                lower = b.column("lower").flatten().to_numpy().reshape(-1, k) - loosen[cluster]
                reach = _root(((v - centroids[cluster]) ** 2).sum(1)) * (1 + SLACK)
                ambiguous = lower <= reach[:, None]
                ambiguous[at, cluster] = True
            cluster, own, lower = _scan(v, centroids, ambiguous, lower)
            scans = (scans + ambiguous.sum(1)).astype(np.int32)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, k, dtype=np.int32)), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(own, pa.int64()), bounds, pa.array(scans, pa.int32())], names=["id", "v", "cluster", "distance", "lower", "scans"])

    return step


def _summed(k: int, dims: int):
    """Of each task, a row per cluster: vectors, the largest squared distance, and sums of components."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            if b.num_rows:
                cluster = b.column("cluster").to_numpy()
                n += np.bincount(cluster, minlength=k)
                np.maximum.at(far, cluster, b.column("distance").to_numpy())
                np.add.at(sums, cluster, _matrix(b, dims))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(far[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "far", "sums"])

    return step


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The floors of the clusters' means (an empty cluster's centroid stays) and the clusters' radii about the old ones."""
    k, dims = centroids.shape
    parts = state.select("v", "cluster", "distance").mapInArrow(_summed(k, dims), PARTIAL)
    sizes = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    total = parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    new, radius, count = centroids.copy(), np.zeros(k), {}
    for r in sizes.collect():
        count[r["cluster"]] = r["n"]
        radius[r["cluster"]] = np.sqrt(float(r["far"])) * (1 + SLACK)
    for r in total.collect():
        new[r["cluster"], r["at"]] = int(r["x"]) // count[r["cluster"]]
    return new, radius


def cluster_vectors(df: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, v, cluster, distance, lower, scans) per kept vector, the final centroids): exact k-means on integers.

    Every round assigns each vector to its nearest centroid (ties: the smaller number) and moves each non-empty centroid to
    the floor of its vectors' mean; then vectors are assigned once more. A vector carries a lower bound of its distance to
    each centroid; after a move the bounds are loosened by loosening(), and a vector is measured exactly against those
    centroids alone that its bounds don't keep farther away than its own; scans counts these. All distances are whole
    numbers and what can tie is measured, so the result is that of measuring all. Nothing but k * dims sums goes to the driver: they are added up in each task
    first, so one cluster may hold any share of the vectors. Each round's state is written to the shared folder.

    Equal vectors fare alike; null ids are kept; rows that repeat an id count each; fewer than k kept vectors give fewer
    centroids; none give no rows. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    vectors = written(kept_vectors(df, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], STATE), np.zeros((0, dims), np.int64)
    state = written(vectors.mapInArrow(_assigned(centroids, None), STATE), "clusters")
    for _ in range(rounds):
        new, radius = _moved(state, centroids)
        loosen = loosening(centroids, new, radius)
        centroids = new
        state = written(state.mapInArrow(_assigned(centroids, loosen), STATE), "clusters")
    return state, centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_report(df: DataFrame, **parameters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector."""
    spark = df.sparkSession
    state, centroids = cluster_vectors(df, **parameters)
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    rows = [(j, int(s), int(whole), digest(centroids[j])) for j, s in sorted(inertia.items())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
