"""Refits of families' subsets against numpy, fold by fold."""

import numpy as np
from test_linear import frame, plain_ridge

from bookglass.operators.ablation import ablation, marginal_values, subset_scores, subsets
from bookglass.operators.evaluation import FOLDS

FAMILIES = {"a": ["f0", "f3"], "b": ["f1"], "c": ["f2", "f4", "f5"]}


def data(n=900):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 6)) + [0, 500, 0, 1, 0, 0]
    y = x[:, 0] - 0.5 * (x[:, 1] - 500) + 0.1 * x[:, 2] + rng.normal(size=n)
    x[rng.random((n, 6)) < 0.1] = np.nan
    x[:, 5] = np.nan  # nobody has it
    y[::50] = np.nan
    return x, rng.integers(0, 71, n), y


def test_every_subset_is_refitted_on_every_fold(spark):
    x, months, y = data()
    df, _ = frame(spark, x, months, y)
    got = {(r.families, r.fold): r for r in subset_scores(df, FAMILIES).collect()}
    assert len(got) == 7 * len(FOLDS)
    means = {}
    for chosen in subsets(FAMILIES):
        at = [int(c[1:]) for f in chosen for c in FAMILIES[f]]
        for f, a, b, c, d in FOLDS:
            train, val = ((months >= lo) & (months <= hi) & np.isfinite(y) for lo, hi in ((a, b), (c, d)))
            p = plain_ridge(x[np.ix_(train, at)], y[train], x[np.ix_(val, at)])
            want = p @ y[val] / np.sqrt((p @ p) * (y[val] @ y[val]))
            r = got["+".join(chosen), f]
            assert np.isclose(r.cosine, want, rtol=0, atol=1e-9) and r.n_families == len(chosen) and r.n_features == len(at)
            means.setdefault("+".join(chosen), []).append(want)
    table = ablation(subset_scores(df, FAMILIES))
    for r in table.collect():
        v = means[r.families]
        assert np.allclose([r.cosine_mean, r.cosine_std, r.cosine_min], [np.mean(v), np.std(v, ddof=1), min(v)], rtol=0, atol=1e-9) and r.worst_fold == int(np.argmin(v)) + 1
    full = np.mean(means["a+b+c"])
    for r in marginal_values(table, list(FAMILIES)).collect():
        rest = np.mean(means["+".join(f for f in FAMILIES if f != r.family)])
        assert np.allclose([r.standalone, r.without_it, r.marginal_gain, r.share_of_full], [np.mean(means[r.family]), rest, full - rest, np.mean(means[r.family]) / full], rtol=0, atol=1e-9)


def test_no_rows_one_family_and_zero_targets(spark):
    x, months, y = data(200)
    df, _ = frame(spark, x, months, y)
    assert subset_scores(df.where("false"), FAMILIES).count() == 0
    assert subset_scores(df.where("month < 36"), FAMILIES).count() == 0  # no validation rows
    one = marginal_values(ablation(subset_scores(df, {"b": ["f1"]})), ["b"]).collect()
    assert len(one) == 1 and one[0].without_it is None and one[0].marginal_gain is None and one[0].share_of_full == 1
    flat, _ = frame(spark, x, months, y * 0)
    assert {r.cosine for r in subset_scores(flat, {"b": ["f1"]}).collect()} == {0.0}


def test_rows_are_read_as_often_for_many_families(spark):
    x, months, y = data(200)
    df, _ = frame(spark, x, months, y)

    def passes(families):
        seen = spark.sparkContext.accumulator(0)
        features = [c for names in families.values() for c in names]
        schema = df.select("month", "y", *features).schema

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        subset_scores(df.select("month", "y", *features).mapInArrow(count, schema), families).collect()
        return seen.value

    assert passes({"a": ["f0"], "b": ["f1"], "c": ["f2"]}) == passes({"a": ["f0", "f1", "f2"]})


def test_features_are_made_once(spark):
    x, months, y = data(200)
    df, _ = frame(spark, x, months, y)
    made = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    ablation(subset_scores(df.mapInArrow(counting, df.schema), FAMILIES)).collect()
    assert made.value == 200
