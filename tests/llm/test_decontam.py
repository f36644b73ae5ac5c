"""Regions equal a search by the full edit matrix over every place; repeated q-grams, blocks and edge rows."""

import random

import numpy as np
import pytest

from bookglass.llm import decontam as d

SCHEMA = "doc_id long, text string, item_id string, t string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def least(p, t):
    """Fewest edits of p against any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def damaged(rng, text, n):
    s = list(text)
    for _ in range(n):
        at = rng.randrange(len(s))
        rng.choice([lambda: s.pop(at), lambda: s.insert(at, "#"), lambda: s.__setitem__(at, "#")])()
    return "".join(s)


@pytest.mark.parametrize("letters", ["ab", "abcdefghij "])
def test_items_are_found_as_by_brute_force(letters):
    rng = random.Random(letters)
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([10, 20, 60, 90])))) for i in range(8)]
    index = d.Index(items)
    for _ in range(40):
        i, item = rng.choice(items)
        text = "".join(rng.choice(letters + "xyz") for _ in range(100)) + damaged(rng, item, rng.randrange(8)) + "".join(rng.choice(letters + "xyz") for _ in range(60))
        found = {r[0] for r in index.search(text)}
        want = {j for j, t in items if len(t.strip()) >= d.Q and least(t.strip(), text) <= d.budget(len(t.strip()))}
        assert found == want


@pytest.mark.parametrize(("item", "n"), [("a" * 40, 30), ("ab" * 30, 30), ("abc " * 12, 40)])
def test_periodic_items_in_periodic_texts(item, n):
    regions = d.Index([(1, item)]).search(item * n)
    assert sum(e == 0 for *_, e in regions) >= n - 3
    assert all(a[2] <= b[1] for a, b in zip(regions, regions[1:]))
    small = d.ENTRIES, d.CELLS
    try:
        d.ENTRIES, d.CELLS = 50, 500
        assert d.Index([(1, item)]).search(item * n) == regions
    finally:
        d.ENTRIES, d.CELLS = small


def test_align_all_equals_align():
    rng = np.random.default_rng(1)
    p = rng.integers(97, 100, 15).astype(np.uint32)
    texts = rng.integers(97, 100, (60, 40)).astype(np.uint32)
    which, edits, start, end = d.align_all(p, texts, 4)
    got = {w: (e, s, t) for w, e, s, t in zip(which.tolist(), edits.tolist(), start.tolist(), end.tolist())}
    for i, t in enumerate(texts):
        assert got.get(i) == d.align(p, t, 4)
        if i in got:
            assert got[i][0] == least(p.tolist(), t.tolist()) == least(p.tolist(), t[got[i][1] : got[i][2]].tolist())


def test_blocks_long_texts_and_edge_rows(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(6)]
    near = damaged(rng, items[2][1], 3)
    rows = [(1, " ".join(rng.choice(words) for _ in range(120_000)) + " " + near), (2, None), (3, ""), (4, items[0][1]), (4, items[0][1]), (None, items[1][1]), (6, items[0][1] + " " + items[0][1])]
    bench = spark.createDataFrame([*items, (7, None), (8, ""), (9, "tiny"), (0, items[0][1])], "item_id long, text string")
    want = [(None, 1), (1, 2), (4, 0), (4, 0), (6, 0), (6, 0)]
    for chars in (d.BLOCK_CHARS, 200):
        monkeypatch.setattr(d, "BLOCK_CHARS", chars)
        got = d.contaminated_regions(frame(spark, rows), bench).select("doc_id", "item_id").collect()
        assert sorted({(r.doc_id or 0, r.item_id) for r in got}) == [(0, 1), (1, 2), (4, 0), (6, 0)]
    assert want and d.contaminated_regions(frame(spark, []), bench).count() == 0
