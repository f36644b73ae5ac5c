"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.llm.common import written

#: Edges from which a node's own go to no one task: so few nodes have as many that they may be broadcast.
HUB = 100_000
#: Edges that a task looks at together when it replaces them by stars.
STAR_EDGES = 1_000_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another node; component is its smallest reachable node.

    Nulls and loops are dropped, repeated edges count once, no edges give no rows. Each task first replaces the edges it
    has in hand by a star for each of their components, so no more edges than nodes of a task are shuffled. Minima are
    pre-aggregated; the edges of a node with HUB of them stay where they are and meet its minimum by broadcast, those of
    others are joined by node. Rounds go on until all edges are stars; they grow with the logarithm of the nodes. Each is
    written to the shared folder, so no lineage piles up.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    e = written(e.mapInArrow(_local_stars, "u long, v long").distinct(), "edges")
    while not _all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("p"))
        small = small.select("p.u", F.col("p.m").alias("v")).where("u != v")
        e = written(small.mapInArrow(_local_stars, "u long, v long").distinct(), "edges")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that connect what the given ones connect: each node of a component with its smallest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= STAR_EDGES:
            yield _stars_of(held)
            held = []
    if held:
        yield _stars_of(held)


def _stars_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = np.concatenate([x.column(i).to_numpy() for i in range(2) for x in held])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = np.split(at, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], names=["u", "v"])


def _all_stars(e: DataFrame) -> bool:
    """Whether each node either has one edge to a smaller one or is such a smaller one alone."""
    ends = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ups = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ups.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of each u."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(low.where(F.col("n") >= HUB).drop("n"))
    others = edges.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("n") < HUB).drop("n"), "u")
    return others.unionByName(edges.join(hubs, "u"))
