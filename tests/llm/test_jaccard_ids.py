"""Repeated ids with different texts, hub nodes, odd columns."""

import random

import pytest

from bookglass.llm import graph, jaccard

A, B = (" ".join(f"{k}{i}" for i in range(80)) for k in "ab")


@pytest.mark.parametrize("count", [False, True])
def test_an_id_links_through_each_of_its_texts(spark, count):
    rows = [(5, A), (5, B), (6, A + " more"), (7, B + " more"), (3, B), (8, "nothing like it at all"), (5, A), (9, None), (None, A)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, doc long, n long")
    got = jaccard.jaccard_components(df, width=3, percent=80, count_links=count).collect()
    assert len(got) == len(rows)
    assert {(r.doc, r.component_id) for r in got} == {(5, 3), (6, 3), (7, 3), (3, 3), (8, 8), (9, 9), (None, None)}
    if count:
        links = {(r.doc, r.n_shingles): r.n_links for r in got}
        assert links[(6, 79)] == 1 and links[(7, 79)] == 2 and links[(8, 3)] == 0


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 5)
    random.seed(1)
    edges = [(0, i) for i in range(1, 40)] + [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    root = list(range(200))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] is not None and e[0] != e[1] for x in e}
    assert got == {x: top(x) for x in nodes}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lists_in_pieces_connect_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 3)
    rows = [(i, A + f" tail{i}") for i in range(30)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=80).collect()
    assert {r.component_id for r in got} == {0}
