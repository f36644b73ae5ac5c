"""Connected components against union-find: chains, trees, several components, nulls, loops, repeated and no edges."""

from __future__ import annotations

import random

import pytest

from bookglass.llm import graph

SCHEMA = "a long, b long"


def components(edges: list[tuple]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def top(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return sorted((x, top(x)) for x in root)


@pytest.mark.parametrize("kind", ["chain", "random", "odd", "none"])
def test_components(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "HUB", 3)
    rng = random.Random(4)
    edges = {
        "chain": [(i + 1, i) for i in range(200)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "odd": [(7, 7), (None, 1), (3, None), (5, 9), (9, 5), (5, 9), (-2, 9)],
        "none": [],
    }[kind]
    rows = spark.createDataFrame(edges, SCHEMA).repartition(6)
    assert sorted(map(tuple, graph.connected_components(rows).collect())) == components(edges)


def test_small_pieces_keep_the_components():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"u": i, "v": i + 1}, {"u": i + 1, "v": 0}]) for i in range(1, 40)]
    stars = [(r["u"], r["v"]) for x in graph._local_stars(iter(batches)) for r in x.to_pylist()]
    assert sorted(stars) == [(i, 0) for i in range(1, 41)]
