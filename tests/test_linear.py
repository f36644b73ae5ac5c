"""Ridge over many columns, quantiles of groups, and adversarial scores, each against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookglass.operators import adversarial, linear, models, research
from bookglass.operators.evaluation import FOLDS
from bookglass.plans import catalog
from bookglass.plans import research as plans

SF = "/root/testdata/sf0.001"


def frame(spark, x, months, y):
    features = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, int(months[i]), None if np.isnan(y[i]) else float(y[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "sample_id long, month int, y double, " + ", ".join(f"{f} double" for f in features)).repartition(5), features


def plain_ridge(x, y, new, alpha=10.0):
    """(predictions) of a ridge with the training rows' medians, standardised, by the textbook."""
    x, new = (np.where(np.isfinite(a), a, np.nan) for a in (x, new))
    some = np.isfinite(x).any(0)
    fill = np.where(some, np.nanmedian(np.where(some, x, 0.0), axis=0), 0.0)
    x, new = (np.where(np.isnan(a), fill, a) for a in (x, new))
    mean, spread = x.mean(0), x.std(0)
    spread[spread <= 1e-12 * np.abs(mean)] = 1
    z = (x - mean) / spread
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return (new - mean) / spread @ w + y.mean()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n, k = 1500, 70
    x = rng.normal(size=(n, k)) * 10 + rng.normal(size=k) * 1000
    x[:, 3], x[:, 8] = 0.1, x[:, 9]
    x[rng.random((n, k)) < 0.05] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 3]), np.nan, 0.1)
    x[0, 1], x[:, 7] = np.inf, np.nan
    y = np.nan_to_num(x[:, 0] - 1000, posinf=0) * 1e-2 + rng.normal(size=n)
    y[::97] = np.nan
    months = rng.integers(0, 71, n)
    return (*frame(spark, x, months, y), x, months, y)


def test_every_fold_is_the_textbook_ridge(table):
    df, features, x, months, y = table
    got = linear.walk_forward_ridge(df, features).select("fold", "sample_id", "prediction").collect()
    found = {(r["fold"], r["sample_id"]): r["prediction"] for r in got}
    for f, a, b, c, d in FOLDS:
        train, val = (months >= a) & (months <= b) & np.isfinite(y), np.flatnonzero((months >= c) & (months <= d))
        want = plain_ridge(x[train], y[train], x[val])
        assert np.allclose([found.pop((f, int(i))) for i in val], want, rtol=0, atol=1e-9)
    assert not found


def test_one_pass_over_the_rows(spark, table):
    df, features, *_ = table
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = df.mapInArrow(counting, df.schema)
    linear.part_products(rows, F.lit(0), features, "y", np.zeros(len(features)))
    assert seen.value == df.count()


def test_ridge_of_nulls_constants_and_no_rows(spark):
    x = np.array([[1.0, 5.0, np.nan], [2.0, 5.0, np.nan], [np.nan, 5.0, np.nan], [4.0, 5.0, np.nan]])
    df, features = frame(spark, x, [0] * 4, np.array([1.0, 2.0, 3.0, 4.0]))
    out = models.ridge(df, df, features, alpha=1.0).orderBy("sample_id").collect()
    assert np.allclose([r["prediction"] for r in out], plain_ridge(x, np.array([1.0, 2.0, 3.0, 4.0]), x, 1.0))
    assert [r["prediction"] for r in models.ridge(df.limit(0), df, features).collect()] == [0.0] * 4
    assert models.ridge(df, df.limit(0), features).count() == 0


def test_all_features_of_the_assembly(spark):
    view = lambda name: catalog.view(spark, SF, name)
    x, features = plans.featured(view)
    rows = x.orderBy("sample_id").collect()
    assert len(features) == 292
    a, months, y = np.array([[np.nan if r[f] is None else r[f] for f in features] for r in rows], float), np.array([r["month"] for r in rows]), np.array([r["y"] for r in rows])
    fits = linear.ridge_fits(x, {1: (0, 40), 2: (0, 64)}, features)
    for f, last in ((1, 40), (2, 64)):
        train = months <= last
        if train.sum():
            p = np.where(np.isfinite(a), a, fits[f].fill) @ fits[f].weights + fits[f].constant
            assert np.allclose(p, plain_ridge(a[train], y[train], a), atol=1e-7)


def test_quantiles_of_groups_and_columns(spark, table, monkeypatch):
    df, _, x, months, _ = table
    clean = np.where(np.isfinite(x), x, np.nan)
    qs = {"low": 0.01, "mid": 0.5, "high": 0.999}
    for accuracy, width in ((2000, 1), (30, 24)):  # all values in order, and by brackets
        monkeypatch.setattr(linear, "ACCURACY", accuracy)
        d = df.withColumn("span", F.floor(F.col("month") / width))
        got = {(r["span"], r["feature"]): [r[q] for q in qs] for r in linear.column_quantiles(d, ["f0", "f1", "f7"], qs, ["span"]).collect()}
        assert len(got) == 3 * len(set((months // width).tolist()))
        for (m, f), v in got.items():
            column = clean[months // width == m, int(f[1:])]
            assert v == [None] * 3 if f == "f7" else np.allclose(v, np.nanquantile(column, list(qs.values())), rtol=1e-12)
        every = linear.group_quantiles(df.withColumn("tied", F.floor(F.col("f0") / 1000)), [], "tied", qs).first()
        assert np.allclose(list(every), np.nanquantile(np.floor(clean[:, 0] / 1000), list(qs.values())))
    none = linear.group_quantiles(df.limit(0), ["month"], "f0", qs)
    assert none.count() == 0 and none.columns == ["month", *qs]


def test_sums_leave_out_rows_that_lack_a_value(spark):
    rows = [(1, 1.0, 2.0, 1.0), (1, None, 3.0, 2.0), (1, 3.0, 1.0, 4.0), (2, 1.0, 1.0, None)]
    s = research.sums(spark.createDataFrame(rows, "g int, a double, b double, y double"), ["a", "b"], ["g"])
    assert list(s) == [(1,)] and s[(1,)][0].tolist() == [[10.0, 5.0], [5.0, 5.0]] and s[(1,)][1].tolist() == [13.0, 6.0]


def test_adversarial_scores_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 400
    x, later, pair = rng.normal(size=(n, 5)), rng.random(n) < 0.4, rng.integers(0, 2, n)
    x[:, 0] += later * (1 + pair)
    x[rng.random((n, 5)) < 0.1] = np.nan
    df, features = frame(spark, x, pair, later.astype(float))
    d = df.withColumn("later", F.col("y") > 0)
    got = {r["month"]: r for r in adversarial.adversarial_auc(d, F.col("later"), features, ["sample_id"], ["month"], alpha=1.0).collect()}
    half = np.array([r["h"] for r in df.select("sample_id", adversarial.halves(df, ["sample_id"]).alias("h")).orderBy("sample_id").collect()])
    for g in (0, 1):
        right = pairs = 0.0
        for h in (0, 1):
            fit, score = (pair == g) & (half != h), np.flatnonzero((pair == g) & (half == h))
            s = plain_ridge(x[fit], later[fit].astype(float), x[score], 1.0)
            p, q = s[later[score]], s[~later[score]]
            right += (p[:, None] > q).sum() + (p[:, None] == q).sum() / 2
            pairs += len(p) * len(q)
        assert abs(got[g]["auc"] - right / pairs) < 1e-9 and got[g]["positives"] == (later & (pair == g)).sum()
    assert got[1]["auc"] > got[0]["auc"] > 0.65
    control = adversarial.adversarial_auc(d.withColumn("odd", F.pmod(F.xxhash64("sample_id"), F.lit(2)) == 1), F.col("odd"), features, ["sample_id"]).first()
    assert abs(control["auc"] - 0.5) < 0.1
    alone = adversarial.adversarial_auc(d, F.lit(True), features, ["sample_id"]).first()
    assert alone["auc"] is None and alone["positives"] == n


def test_groups_that_share_rows_score_as_copies_do(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, later = rng.normal(size=(500, 4)), rng.random(500) < 0.5
    x[:, 0] += later
    df, features = frame(spark, x, rng.integers(0, 4, 500), later.astype(float))
    m, made = F.col("month"), spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    # 0: months 0 and 1; 1: months 0 and 2; 2: every row by its target; 3: nobody; month 3 is in the third alone.
    labels = [F.when(m.isin(0, 1), m == 1), F.when(m.isin(0, 2), m == 2), F.col("y") > 0, F.lit(None).cast("boolean")]
    copies = None
    for i, label in enumerate(labels):
        own = df.select("*", F.lit(i).alias("g"), label.alias("positive"))
        copies = own if copies is None else copies.unionByName(own)
    want = {r["g"]: r for r in adversarial.adversarial_auc(copies, F.col("positive"), features, ["sample_id"], ["g"]).collect()}
    for digits in (39, 2):
        monkeypatch.setattr(adversarial, "DIGITS", digits)
        got = {r["group"]: r for r in adversarial.labelled_auc(df.mapInArrow(counting, df.schema), labels, features, ["sample_id"]).collect()}
        assert set(got) == set(want) == {0, 1, 2} and want[2]["auc"] > 0.65
        for g, r in got.items():
            assert abs(r["auc"] - want[g]["auc"]) < 1e-9 and (r["positives"], r["negatives"]) == (want[g]["positives"], want[g]["negatives"])
    assert made.value == 2 * 500


def test_trees_tell_what_no_line_can(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    df, features = frame(spark, x, [0] * 600, (np.abs(x[:, 0]) > 0.7).astype(float))
    auc = lambda model: adversarial.adversarial_auc(df, F.col("y") > 0, features, ["sample_id"], model=model, rounds=3).first()["auc"]
    assert auc("boosted") > 0.95 and auc("linear") < 0.65


def test_ranks_in_many_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(s), bool(p)) for g, s, p in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), rng.random(500) < 0.5, strict=True)]
    df = spark.createDataFrame(rows, "g int, s double, p boolean")
    got = {r["g"]: r["auc"] for r in research.auc(df, "s", F.col("p"), ["g"], rows=7).collect()}
    for g in range(3):
        p, q = (np.array([s for h, s, x in rows if h == g and x == side]) for side in (True, False))
        assert abs(got[g] - ((p[:, None] > q).sum() + (p[:, None] == q).sum() / 2) / (len(p) * len(q))) < 1e-12


def test_student_t_against_published_values():
    known = {1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 5: 2.570582, 9: 2.262157, 29: 2.045230, 59: 2.000995}
    for n, t in known.items():
        assert abs(research.student_t(n) - t) < 1e-6
        assert abs(research.T_VALUES[n - 1] - t) < 1e-6


def test_quantiles_of_spans_that_share_parts(spark, table, monkeypatch):
    df, features, x, months, _ = table
    spans = {7: [0, 1], 3: [0, 1, 2], 5: [2], 9: [4]}  # no row has part 4
    clean = np.where(np.isfinite(x), x, np.nan)
    for least, most, whole, held in ((128, 2048, 65_536, 4_000_000), (4, 8, 10, 7_000)):  # two passes, and many, over small runs
        for name, n in (("LEAST", least), ("MOST", most), ("WHOLE", whole), ("HELD", held)):
            monkeypatch.setattr(linear, name, n)
        for q in (0.37, 1.0):
            got = linear.span_quantiles(df.withColumn("tied", F.floor(F.col("f0") / 1000)), F.floor(F.col("month") / 24), spans, [*features[:9], "tied"], q)
            assert list(got) == list(spans) and np.isnan(got[9]).all()
            for s, own in spans.items():
                rows = clean[np.isin(months // 24, own)]
                assert s == 9 or np.isnan(got[s][7]) and np.allclose(np.delete(got[s], 7), np.nanquantile(np.delete(np.column_stack([rows[:, :9], np.floor(rows[:, 0] / 1000)]), 7, 1), q, axis=0), rtol=1e-12)


def test_features_are_made_once(spark, table):
    df, features, *_ = table
    made = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    linear.walk_forward_ridge(df.mapInArrow(counting, df.schema), features).count()
    assert made.value == df.count()
