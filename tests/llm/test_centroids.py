import hashlib

import numpy as np
import pytest
from oracle import connect, differences

from bookglass.llm import centroids, queries

SF = "/root/testdata/sf0.001"


def plain(ids, vectors, k, rounds):
    """k-means on whole numbers that measures everything."""
    v = np.array(vectors, np.int64)
    first = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), v[i].tolist()))[:k]
    c = v[first].copy()
    for r in range(rounds + 1):
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        best = d.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (best == j).any():
                    c[j] = [int(x) // int((best == j).sum()) for x in v[best == j].sum(0)]
    return best, d[np.arange(len(v)), best], c


def frame(spark, rows, schema="vec_id long, embedding array<float>"):
    return spark.createDataFrame(rows, schema)


def test_query_agrees_with_sql(spark):
    assert not differences(queries.op12_centroid_clustering(spark, SF), queries.oracle_sql()["op12_centroid_clustering"], connect(SF))


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_bounds_give_the_same_as_measuring_all(spark, spread):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 4))
    x = (middle[rng.integers(0, 6, 400)] + rng.normal(scale=spread, size=(400, 4))).astype(np.float32)
    x[100:160] = x[0]  # a vector that many rows hold
    state, c = centroids.cluster_vectors(frame(spark, [(i, r.tolist()) for i, r in enumerate(x)]), k=6, rounds=5, dims=4)
    best, d, want = plain(range(400), np.floor(x.astype(float) * 64), 6, 5)
    rows = {r["id"]: r for r in state.collect()}
    assert (c == want).all() and all((rows[i]["cluster"], rows[i]["distance"]) == (best[i], d[i]) for i in range(400))
    if spread < 0.1:
        assert sum(r["scans"] for r in rows.values()) < 0.7 * 400 * 6 * 6  # far clusters are not measured again


def test_loosening_holds_and_is_less_than_the_drift():
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(200):
        c = rng.normal(scale=10, size=(5, 3))
        m = c + rng.normal(scale=2, size=(5, 3))
        radius = rng.uniform(0.1, 6, 5)
        out = centroids.loosening(c, m, radius)
        drift = np.linalg.norm(m - c, axis=1)
        assert (out <= drift[None] * (1 + 1e-6)).all()
        less += (out < 0.5 * drift[None]).sum()
        for i in range(5):
            p = rng.normal(size=(300, 3))
            p = c[i] + p / np.linalg.norm(p, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (300, 1)) ** 0.2
            for j in range(5):
                gain = np.linalg.norm(p - c[j], axis=1) - np.linalg.norm(p - m[j], axis=1)
                assert gain.max() <= out[i, j] + 1e-9
    assert less > 1000


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 1.0])]
    state, c = centroids.cluster_vectors(frame(spark, rows), k=4, rounds=3, dims=2)
    best, d, want = plain([r[0] for r in rows], np.array([r[1] for r in rows]) * 64, 4, 3)
    assert (c == want).all() and [r["cluster"] for r in state.orderBy("id").collect()] == best.tolist()


def test_what_is_left_out_and_other_columns(spark):
    ok = [0.5, -0.25]
    rows = [(1, ok, "a"), (None, ok, None), (1, ok, "b"), (2, None, "c"), (3, [0.5], "d"), (4, [0.5, None], "e"), (5, [float("nan"), 0.0], "f"), (6, [float("inf"), 0.0], "g"), (7, [], "h"), (8, [1e30, 0.0], "i")]
    out = centroids.cluster_report(frame(spark, rows, "vec_id long, embedding array<float>, cluster string"), dims=2).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["1", "1", "None"] and {(r["cluster"], r["distance"], r["inertia"]) for r in out} == {(0, 0, 0)}
    assert out[0]["centroid_sha256"] == hashlib.sha256(b"32,-16").hexdigest()
    none = centroids.cluster_report(frame(spark, [], "vec_id long, embedding array<float>"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
