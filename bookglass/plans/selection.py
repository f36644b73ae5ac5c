"""Registered queries of parameters chosen by folds, run records, stored feature tables and their loads, each beside the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.functions.exprs import safe_div
from bookglass.operators import tuning
from bookglass.operators.ranges import kept
from bookglass.plans.sql import FOLD_ROWS, S, cols, cos, r
from bookglass.sources import exports, records, sinks

QUERIES: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def scored(t: Callable) -> DataFrame:
    return t("scored").where(F.col("month").between(0, 70))


#: Ridges by shrinkage and share of rows, the first one in use; SEED and the fresh seeds after it.
BASE, GRID = {"alpha": 10.0, "rows": 0.75}, [{"alpha": 1000.0, "rows": 0.75}, {"alpha": 10.0, "rows": 0.5}, {"alpha": 1000.0, "rows": 0.25}, {"alpha": 100000.0, "rows": 0.5}]
SEED, CHECKS = 42, 3
CANDIDATES = ", ".join(f"({i}, {c['alpha']}::DOUBLE, {round(c['rows'] * tuning.BAGS)})" for i, c in enumerate([BASE, *GRID]))
#: sc: the cosine of every candidate, seed and fold; cv: its mean over the last folds; best: the candidate chosen.
TUNED = f"""{S}, {FOLD_ROWS}, seeds AS (SELECT unnest(range({SEED}, {SEED + CHECKS + 1})) AS seed), cand(candidate, alpha, bags) AS (VALUES {CANDIDATES}),
dr AS (SELECT seed, bag, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws(':', seed, bag))) AS place FROM seeds, (SELECT unnest(range({tuning.BAGS})) AS bag)),
tr AS (SELECT fr.*, ('0x' || substr(md5(sample_id::VARCHAR), 1, 1))::INT % {tuning.BAGS} AS bag FROM fr WHERE role = 'train'),
d AS (SELECT candidate, alpha, seed, fold, p1, p2, y FROM tr JOIN dr ON tr.bag = dr.bag JOIN cand ON place <= bags),
m AS (SELECT candidate, alpha, seed, fold, avg(p1) AS m1, avg(p2) AS m2, avg(y) AS my, stddev_pop(p1) AS s1, stddev_pop(p2) AS s2, count(*)::DOUBLE AS n FROM d GROUP BY candidate, alpha, seed, fold),
q AS (SELECT candidate, seed, fold, sum((p1 - m1) / s1 * ((p2 - m2) / s2)) AS c, sum((p1 - m1) / s1 * (y - my)) AS u, sum((p2 - m2) / s2 * (y - my)) AS v FROM d JOIN m USING (candidate, seed, fold) GROUP BY candidate, seed, fold),
w AS (SELECT *, ((n + alpha) * u - c * v) / ((n + alpha) * (n + alpha) - c * c) AS w1, ((n + alpha) * v - c * u) / ((n + alpha) * (n + alpha) - c * c) AS w2 FROM m JOIN q USING (candidate, seed, fold)),
x AS (SELECT candidate, seed, fold, y, my + w1 * (p1 - m1) / s1 + w2 * (p2 - m2) / s2 AS prediction FROM fr JOIN w USING (fold) WHERE role = 'val'),
sc AS (SELECT candidate, seed, fold, {cos('y', 'prediction')} AS cosine FROM x GROUP BY candidate, seed, fold),
cv AS (SELECT candidate, seed, avg(cosine) AS cv FROM sc WHERE fold > {5 - tuning.SEARCH_FOLDS} GROUP BY candidate, seed),
best AS (SELECT arg_max(candidate, cv) AS best FROM cv WHERE seed = {SEED} AND candidate > 0)"""


@query(f"""{TUNED}, a AS (SELECT candidate = best AS tuned, avg(cv) AS mean, stddev_pop(cv) AS std FROM cv, best WHERE seed > {SEED} AND candidate IN (0, best) GROUP BY 1),
s0 AS (SELECT best, max(CASE WHEN candidate = 0 THEN cv END) AS base_cv, max(CASE WHEN candidate = best THEN cv END) AS best_cv FROM cv, best WHERE seed = {SEED} GROUP BY best),
pr AS (SELECT a.cosine - b.cosine AS apart FROM sc a JOIN best ON a.candidate = best JOIN sc b ON b.candidate = 0 AND a.fold = b.fold AND a.seed = b.seed WHERE a.seed = {SEED})
SELECT best, {cols({'base_cv': 'base_cv', 'best_cv': 'best_cv', 'claimed_gain': 'best_cv - base_cv', 'tuned_mean': 'x.mean', 'tuned_std': 'x.std', 'base_mean': 'z.mean', 'base_std': 'z.std', 'honest_gain': 'x.mean - z.mean', 'selection_optimism': 'best_cv - base_cv - (x.mean - z.mean)', 'paired_gain': '(SELECT avg(apart) FROM pr)'})},
(SELECT count(*) FILTER (WHERE apart > 0) FROM pr)::INT AS folds_improved, 5 AS n_folds FROM s0, a x, a z WHERE x.tuned AND NOT z.tuned""")
def i_tuned_ridge(t):
    """What a grid of ridges gains over the one in use, by the search and with fresh draws of rows."""
    s = scored(t)
    return tuning.tune(s.sparkSession, tuning.ridge_scorer(s, ["p1", "p2"]), BASE, GRID, seed=SEED, checks=CHECKS)[1].drop("parameters")


@query(f"""{TUNED} SELECT candidate, seed::INT AS seed, fold, {r('cosine')} AS cosine FROM sc, best
WHERE (seed = {SEED} AND (fold > {5 - tuning.SEARCH_FOLDS} OR candidate IN (0, best))) OR (seed > {SEED} AND fold > {5 - tuning.SEARCH_FOLDS} AND candidate IN (0, best))""")
def i_tuning_trials(t):
    """All scores behind i_tuned_ridge."""
    s = scored(t)
    return tuning.tune(s.sparkSession, tuning.ridge_scorer(s, ["p1", "p2"]), BASE, GRID, seed=SEED, checks=CHECKS)[0].drop("parameters")


@query()
def i_tuned_boosted(t):
    """What shallower or slower trees gain over those in use on the last two folds, candidates below the median stopping early."""
    s = scored(t)
    folds = tuning.FOLDS[-2:]
    base, grid = {"rounds": 3, "rows": 0.8}, [{"rounds": 3, "depth": 2, "rows": 0.8}, {"rounds": 3, "step": 0.05, "rows": 0.8}]
    return tuning.tune(s.sparkSession, tuning.boosted_scorer(s, ["p1", "p2"], folds=folds), base, grid, folds=folds, checks=1, prune=True)[1]


@query(f"{S}, m AS (SELECT month, avg(y) AS mean, stddev_samp(y) AS std FROM s GROUP BY month) SELECT count(*) AS months, {cols({'lowest': 'min(std)', 'highest': 'max(std)', 'swing': 'max(std) / min(std)', 'largest_mean': 'max(abs(mean))'})} FROM m")
def d_target_swing(t):
    """How far the target's deviation moves between months, and how far its mean is ever from 0."""
    m = scored(t).groupBy("month").agg(F.avg("y").alias("mean"), F.stddev("y").alias("std"))
    return m.agg(F.count("*").alias("months"), F.min("std").alias("lowest"), F.max("std").alias("highest"), safe_div(F.max("std"), F.min("std")).alias("swing"), F.max(F.abs("mean")).alias("largest_mean"))


@query(f"""{S}, m AS (SELECT month, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', sample_id, month)), 1, 8))::BIGINT)::BIGINT AS f FROM s GROUP BY month)
SELECT sum(n)::BIGINT AS n_rows, 3 AS n_features, sha256(concat_ws(chr(10), 'p1', 'p2', 'regime')) AS features_sha256, string_agg(month || ':' || n, ',' ORDER BY month) AS rows_per_month, sum(f)::BIGINT AS fingerprint FROM m""")
def j_run_record(t):
    """The record of a run over a written table, whose files must be the same before and after."""
    s = scored(t).select("sample_id", "month", "p1", "p2", "regime")
    path = sinks.scratch(s.sparkSession, "input")
    sinks.write_parts(s, path)
    with records.unchanged(s.sparkSession, path):
        return kept(records.run_record(s.sparkSession.read.parquet(path), ["p1", "p2", "regime"]), "record")


ENDLESS = " + ".join(f"count(*) FILTER (WHERE isinf({c}))" for c in ("y", "p1", "p2", "regime"))


@query(f"""{S}, c AS (SELECT count(*) AS n_rows, count(*) = (SELECT count(*) FROM orders) AS rows_agree, (count(*) - count(DISTINCT sample_id))::BIGINT AS repeated, 0::BIGINT AS unordered, ({ENDLESS})::BIGINT AS infinite,
count(*) FILTER (WHERE y IS NULL)::BIGINT AS no_target, min(month) AS first_month, max(month) AS last_month FROM s), a AS (SELECT *, first_month = 0 AND last_month = 70 AS months_agree FROM c)
SELECT *, rows_agree AND months_agree AND repeated + infinite + no_target = 0 AS ok FROM a""")
def j_feature_faults(t):
    """What is wrong with a feature table that was exported in order."""
    s = scored(t).select("sample_id", "month", "y", "p1", "p2", "regime")
    path = sinks.scratch(s.sparkSession, "features")
    exports.export_ordered(s, path, ["sample_id"], rows_per_file=100_000)
    return records.feature_faults(s.sparkSession, path, expected=t("orders").count())


@query(f"{S} SELECT sample_id, {cols({c: f'({c})::FLOAT::DOUBLE' for c in ('p1', 'regime')})} FROM s")
def a_float_load(t):
    """Two columns of a table that was written out of order, loaded as floats and in order."""
    s = scored(t)
    path = sinks.scratch(s.sparkSession, "shuffled")
    sinks.write_parts(s.sortWithinPartitions(F.desc("sample_id")), path)
    d = records.load_features(s.sparkSession, path, ["sample_id", "p1", "regime"])
    return d.select("sample_id", *(F.col(c).cast("double").alias(c) for c in ("p1", "regime")))


@query(f"{S} SELECT sample_id, month, {cols({c: c for c in ('y', 'p1', 'p2', 'regime')})}, grp FROM s")
def c_column_groups_written(t):
    """A table written as three groups of columns, and joined again without an exchange."""
    s = scored(t).select("sample_id", "month", "y", "p1", "p2", "regime", "grp")
    groups = {"target": ["month", "y"], "predictions": ["p1", "p2"], "state": ["regime", "grp"]}
    return records.column_groups(records.write_column_groups(s, groups, sinks.scratch(s.sparkSession, "groups"), buckets=8))
