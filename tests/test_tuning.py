"""The search for parameters: ridges from sums against refits with numpy, and the protocol against a scorer that is known."""

import numpy as np
import pytest
from test_linear import frame, plain_ridge

from bookglass.operators.evaluation import FOLDS
from bookglass.operators.tuning import BAGS, bag, boosted_scorer, drawn, ridge_scorer, tune


def data(n=1200):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 5)) + [0, 300, 0, 1, 0]
    y = x[:, 0] - 0.5 * (x[:, 1] - 300) + 0.1 * x[:, 2] + rng.normal(size=n)
    x[rng.random((n, 5)) < 0.1] = np.nan
    x[:, 4] = np.nan
    y[::40] = np.nan
    return x, rng.integers(0, 71, n), y


def filled_ridge(x, y, fill, new, alpha):
    """plain_ridge, but with the medians given: those of all rows, not of the draw."""
    return plain_ridge(np.where(np.isfinite(x), x, fill), y, np.where(np.isfinite(new), new, fill), alpha)


def test_candidates_are_refits_on_what_they_draw(spark):
    x, months, y = data()
    df, features = frame(spark, x, months, y)
    bags = np.zeros(len(x), int)
    for r in df.select("sample_id", bag("sample_id").alias("b")).collect():
        bags[r.sample_id] = r.b
    assert set(bags) == set(range(BAGS))
    score = ridge_scorer(df, features)
    candidates = [{}, {"alpha": 500.0}, {"rows": 0.5}, {"features": 0.6, "alpha": 1.0}, {"rows": 0.01, "features": 0.4}]
    for seed in (1, 2):
        for f, a, b, c, d in FOLDS:
            got = score(candidates, seed, f)
            train, val = ((months >= lo) & (months <= hi) & np.isfinite(y) for lo, hi in ((a, b), (c, d)))
            some = np.isfinite(x[train]).any(0)
            fill = np.where(some, np.nanmedian(np.where(some, x[train], 0.0), axis=0), 0.0)
            for given, value in zip(candidates, got, strict=True):
                own = drawn(5, given.get("features", 1.0), seed)
                rows = train & np.isin(bags, drawn(BAGS, given.get("rows", 1.0), seed))
                p = filled_ridge(x[np.ix_(rows, own)], y[rows], fill[own], x[np.ix_(val, own)], given.get("alpha", 10.0))
                assert np.isclose(value, p @ y[val] / np.sqrt((p @ p) * (y[val] @ y[val])), rtol=0, atol=1e-9)


def test_draws():
    assert drawn(8, 1.0, 3) == list(range(8)) and len(drawn(8, 0.5, 3)) == 4 and len(drawn(8, 0.0, 3)) == 1
    assert len({tuple(drawn(8, 0.5, s)) for s in range(20)}) > 10


def test_tables_without_rows_score_nothing(spark):
    x, months, y = data(100)
    df, features = frame(spark, x, months, y)
    for part in (df.where("false"), df.where("month < 36"), df.where("month > 59")):
        score = ridge_scorer(part, features)
        assert score([{}], 1, 5)[0] == 0.0 or part.where("month between 60 and 64 and y is not null").count()
    assert boosted_scorer(df.where("false"), features)([{}, {}], 1, 1) == [0.0, 0.0]


def known(calls):
    """Candidate n scores n / 10 at the search's seed in the last fold, less elsewhere; other seeds take its luck away."""

    def score(candidates, seed, fold):
        calls.extend((c["n"], seed, fold) for c in candidates)
        return [0.1 * c["n"] + 0.01 * fold - (0.05 * c["n"] if seed != 42 else 0.0) for c in candidates]

    return score


def test_the_verdict_tells_luck_from_gain(spark):
    calls = []
    trials, verdict = tune(spark, known(calls), {"n": 1}, [{"n": 2}, {"n": 4}, {"n": 3}], checks=2)
    v = verdict.first()
    assert (v.best, v.parameters, v.folds_improved, v.n_folds) == (2, '{"n": 4}', 5, 5)
    assert np.allclose([v.base_cv, v.best_cv, v.claimed_gain, v.tuned_mean, v.base_mean, v.honest_gain, v.selection_optimism, v.paired_gain, v.tuned_std, v.base_std], [0.14, 0.44, 0.3, 0.24, 0.09, 0.15, 0.15, 0.3, 0, 0])
    assert len(calls) == len(set(calls)) == trials.count() == 4 * 3 + 2 * 2 * 3 + 2 * 2  # the search, the fresh seeds, the first two folds
    assert {(r.seed, r.fold) for r in trials.where("candidate = 1").collect()} == {(42, 3), (42, 4), (42, 5)}
    with pytest.raises(ValueError, match="candidate"):
        tune(spark, known([]), {"n": 1}, [])


def test_candidates_below_the_median_stop(spark):
    calls = []
    grid = [{"n": n} for n in (5, 2, 9, 3, 7)]
    verdict = tune(spark, known(calls), {"n": 1}, grid, checks=0, prune=True)[1].first()
    assert verdict.best == 3 and verdict.honest_gain is None and verdict.selection_optimism is None
    assert [sum((n, 42, f) in calls for n in (5, 2, 9, 3, 7)) for f in (3, 4, 5)] == [5, 3, 2]


def test_boosted_candidates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    df, features = frame(spark, x, rng.integers(0, 20, 400), np.sign(x[:, 0]) * (1 + 0.1 * rng.random(400)))
    folds = [(1, 0, 9, 11, 13), (2, 0, 13, 15, 19)]
    score = boosted_scorer(df, features, folds=folds)
    good, poor = score([{"rounds": 3}, {"rounds": 1, "depth": 0}], 7, 2)
    assert good > 0.9 > abs(poor)


def test_a_folds_rows_are_made_once(spark):
    x, months, y = data(300)
    df, features = frame(spark, x, months, y)
    made = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    score = boosted_scorer(df.mapInArrow(counting, df.schema), features)
    assert all(-1 <= c <= 1 for c in score([{"rounds": 1}, {"rounds": 1, "depth": 2}], 7, 5)) and made.value == 300
