"""Every link between different texts is counted, inside groups too."""

import random

import pytest

from bookglass.llm import jaccard


def rows_of(seed):
    random.seed(seed)
    base = [[f"w{k}_{i}" for i in range(60)] for k in range(3)]
    out = []
    for k in range(90):
        own = list(base[k % 3])
        for _ in range(random.randrange(4)):
            own[random.randrange(60)] = f"x{random.randrange(40)}"
        own = own[: random.choice([60, 60, 55, 45])]
        out.append((k, " ".join(own)))
    return out + [(100, "short text"), (101, "short text"), (102, ""), (103, None), (None, out[0][1]), (104, out[0][1]), (105, "alone in the world of words")]


@pytest.mark.parametrize("block", [3_000_000, 2000, 400])
@pytest.mark.parametrize("percent", [80, 60])
def test_links_equal_brute_force(spark, monkeypatch, block, percent):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rows = rows_of(percent)
    sets = {d: set(jaccard.shingles((t or "").encode(), 3).tolist()) for d, t in rows if d is not None}
    link = lambda a, b: a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    want = {a: sum(bool(link(a, b)) for b in sets) for a in sets} | {None: 0}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df, width=3, percent=percent, count_links=True).collect()
    assert {r.doc: r.n_links for r in got} == want and max(want.values()) > 10
    plain = jaccard.jaccard_components(df, width=3, percent=percent).collect() if block == 2000 else None
    assert plain is None or {r.doc: r.component_id for r in plain} == {r.doc: r.component_id for r in got}
