"""Boosted trees fold by fold against fits of each fold by itself."""

import random

from pyspark.sql import functions as F

from bookglass.operators.models import boosted, median_impute, walk_forward_boosted

FOLDS = [(1, 0, 9, 11, 12), (2, 0, 12, 14, 15), (3, 40, 50, 16, 16)]


def test_folds_learn_from_their_own_months(spark):
    dice = random.Random(2)
    rows = []
    for i in range(600):
        a, b = dice.random(), dice.choice([None, 1.0, 2.0])
        rows.append((i, dice.randrange(18), None if i % 30 == 0 else (1.0 if a > 0.5 else -1.0) * (b or 1.5), a, b))
    df = spark.createDataFrame(rows, "sample_id long, month int, y double, a double, b double").repartition(3)
    got = {(r.fold, r.sample_id): r.prediction for r in walk_forward_boosted(df, ["a", "b"], folds=FOLDS, rounds=3).collect()}
    assert set(got) == {(f, r[0]) for f, _, _, c, d in FOLDS for r in rows if c <= r[1] <= d}
    assert {p for (f, _), p in got.items() if f == 3} == {0.0}  # nothing to learn from
    for f, a, b, c, d in FOLDS[:2]:
        span = df.where(F.col("month").between(a, b) & F.col("y").isNotNull()).withColumn("t", F.lit(True)).unionByName(df.where(F.col("month").between(c, d)).withColumn("t", F.lit(False)))
        whole = median_impute(span, ["a", "b"], F.col("t"))
        want = {r.sample_id: r.prediction for r in boosted(whole.where("t"), whole.where("not t").drop("prediction"), ["a", "b"], rounds=3).collect()}
        own = {i: p for (g, i), p in got.items() if g == f}
        assert set(own) == set(want) and max(abs(own[i] - want[i]) for i in own) < 0.25  # sampling inside the learner follows the partitions
        signs = [(own[r[0]] > 0) == (r[3] > 0.5) for r in rows if r[0] in own and r[2] is not None]
        assert sum(signs) > 0.95 * len(signs)
