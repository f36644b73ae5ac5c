"""Registered queries of the comparison operators, each beside the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.functions.exprs import corr_safe, cosine, quantile
from bookglass.operators import comparison as cp
from bookglass.operators import evaluation as ev
from bookglass.operators import features as ft
from bookglass.operators import ranges, series
from bookglass.plans.sql import BOOK, CLOCK, DRIFT, S, WIDE, blocks_sql, cols, corr, cos, curve, r
from bookglass.sources import exports, sinks
from bookglass.sources.adapters import sql_views

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


FILLED = f"fm AS (SELECT *, coalesce(last_value(mid IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(mid IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS m FROM book WINDOW w AS (PARTITION BY sample_id ORDER BY {CLOCK} DESC, row_id))"
CHANNELS = {
    "return_bps": f"(m / last_value(m) OVER (PARTITION BY sample_id ORDER BY {CLOCK} DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - 1) * 1e4",
    "spread_bps": "coalesce(spread / m * 1e4, 0)", "micro_bps": "CASE WHEN spread IS NULL THEN 0 ELSE coalesce((microprice - m) / m * 1e4, 0) END",
    "ask_gap_bps": "coalesce(ask_slope / m * 1e4, 0)", "bid_gap_bps": "coalesce(bid_slope / m * 1e4, 0)",
    "trade_bps": "CASE WHEN transaction_count > 0 THEN coalesce((transaction_avgprice - m) / m * 1e4, 0) ELSE 0 END",
    "imb1": "coalesce((bv1 - av1) / nullif(bv1 + av1, 0), 0)", "imb12": "coalesce((bv1 + bv2 - av1 - av2) / nullif(bv1 + bv2 + av1 + av2, 0), 0)", "age": f"{CLOCK} / 600",
} | {f"log_{n}": f"ln(1 + greatest({n}::DOUBLE, 0))" for n in ("bv1", "av1", "bv2", "av2", "transaction_volume", "transaction_count")}


@query(f"{sql_views('market')}, {BOOK}, {FILLED} SELECT row_id, sample_id, {cols({k: f'({v})::DOUBLE' for k, v in CHANNELS.items()})} FROM fm")
def b_snapshot_channels(t):
    return ft.snapshot_channels(t("market"))


LONG = " UNION ALL ".join(f"SELECT split, '{f}' AS feature, {f}::DOUBLE AS v FROM wide" for f in WIDE)


@query(f"{sql_views('wide')}, u AS ({LONG}), b AS (SELECT feature, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM u WHERE split = 'train' GROUP BY feature) SELECT feature, count(v) AS n, count(*) FILTER (WHERE v < lo OR v > hi) AS outside FROM u JOIN b USING (feature) WHERE split = 'test' GROUP BY feature")
def b_outside_band(t):
    w = t("wide")
    return cp.outside_band(w.where("split = 'train'"), w.where("split = 'test'"), WIDE)


@query(f"{sql_views('market', 'trade')}, a AS (SELECT sample_id, count(*) AS snapshots FROM market GROUP BY sample_id), b AS (SELECT sample_id, count(*) AS trades FROM trade GROUP BY sample_id) SELECT a.sample_id, snapshots, trades FROM a LEFT JOIN b ON a.sample_id = b.sample_id")
def c_one_to_one_left_join(t):
    a = t("market").groupBy("sample_id").agg(F.count("*").alias("snapshots"))
    return exports.joined_once(a, t("trade").groupBy("sample_id").agg(F.count("*").alias("trades")), ["sample_id"])


IMPORTANCE = "w AS (SELECT feature, avg(abs(coalesce(v, 0))) AS mean_size FROM u GROUP BY feature)"


@query(f"{sql_views('wide')}, {DRIFT}, {IMPORTANCE} SELECT {cols({'r': corr('mean_size', 'shift'), 'median_shift': 'quantile_cont(shift, 0.5)', 'top_median_shift': 'quantile_cont(shift, 0.5) FILTER (WHERE place <= 3)'})}, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY mean_size DESC, feature) AS place FROM e JOIN w USING (feature))")
def c_importance_and_drift(t):
    j = ev.drift(t("wide"), WIDE).join(cp.importance(t("wide"), WIDE), "feature")
    top = j.orderBy(F.desc("mean_size"), "feature").limit(3).agg(quantile("shift", 0.5).alias("top_median_shift"))
    return j.agg(corr_safe(F.col("mean_size"), F.col("shift")).alias("r"), quantile("shift", 0.5).alias("median_shift"), F.count("*").alias("n")).crossJoin(F.broadcast(top))


@query(f"{S}, k AS (SELECT sample_id, month, regime, row_number() OVER w AS rn, median(regime) OVER (w ROWS 49 PRECEDING) AS md FROM s WINDOW w AS (PARTITION BY month ORDER BY sample_id)), m AS (SELECT *, CASE WHEN rn >= 10 THEN md END AS x FROM k), f AS (SELECT *, coalesce(x, first_value(x IGNORE NULLS) OVER (PARTITION BY month ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM m) SELECT sample_id, {r('y / avg(y) OVER (PARTITION BY month)')} AS scale FROM f")
def e_rolling_scale(t):
    return series.rolling_scale(scored(t), "regime").select("sample_id", "scale")


LAGS = [1, 2, 5, 10, 50]


@query(f"{S}, k AS (SELECT y, " + ", ".join(f"lag(y, {k}) OVER w AS l{k}" for k in LAGS) + " FROM s WINDOW w AS (ORDER BY month, sample_id)) " + " UNION ALL ".join(f"SELECT {k} AS lag, {r(f'corr(y, l{k})')} AS r FROM k" for k in LAGS))
def e_target_lags(t):
    return series.lag_correlations(scored(t), LAGS)


@query(f"{S}, k AS (SELECT CASE WHEN regime > 0 THEN ln(regime) END - avg(CASE WHEN regime > 0 THEN ln(regime) END) OVER (PARTITION BY month) AS v, row_number() OVER (ORDER BY month, sample_id) - 1 AS pos FROM s), {blocks_sql((10, 100))}, pm AS (SELECT avg(n) AS per FROM (SELECT count(*) AS n FROM s GROUP BY month)) SELECT block, n_blocks, {cols({'autocorr': 'e.r', 'noise_se': '1.0 / sqrt(n_blocks)', 'expected': '-1.0::DOUBLE / (per / block - 1)'})} FROM e, pm")
def e_residual_blocks(t):
    """Within months: blocks of the residuals, against what an order-free table would show."""
    return series.block_autocorrelations(scored(t), "regime", (10, 100), within=True)


@query(f"{S}, p(part, lo, hi) AS (VALUES ('train', 0, 63), ('stop', 64, 64), ('holdout', 65, 70)) SELECT part, count(*) AS n, min(month) AS first, max(month) AS last, {r('avg(y)')} AS mean FROM s JOIN p ON month BETWEEN lo AND hi GROUP BY part")
def f_named_splits(t):
    return cp.checked_splits(scored(t)).groupBy("part").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"), F.avg("y").alias("mean"))


@query(f"{S}, p(part, lo, hi) AS (VALUES ('train', 0, 67), ('stop', 68, 68), ('blend', 69, 70)) SELECT part, count(*) AS n, min(month) AS first, max(month) AS last FROM s JOIN p ON month BETWEEN lo AND hi GROUP BY part")
def f_ship_splits(t):
    return cp.checked_splits(scored(t), cp.SHIP_SPLITS).groupBy("part").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"))


@query(f"{sql_views('scored')} SELECT count(*) AS n, count(*) FILTER (WHERE month IS NULL) AS missing, count(*) FILTER (WHERE month <> floor(month)) AS not_whole, count(*) FILTER (WHERE month < 0) AS negative, count(*) FILTER (WHERE month > 70) AS late, count(*) FILTER (WHERE month < before) AS out_of_order FROM (SELECT *, lag(month) OVER (ORDER BY sample_id) AS before FROM scored)")
def f_month_faults(t):
    return cp.month_faults(t("scored"))


def buckets(reference: str) -> str:
    return f"e AS (SELECT quantile_cont(regime, 0.25) AS a, quantile_cont(regime, 0.5) AS b, quantile_cont(regime, 0.75) AS c FROM s WHERE {reference}), z AS (SELECT s.*, CASE WHEN regime IS NULL THEN 0 ELSE 1 + (regime > a)::INT + (regime > b)::INT + (regime > c)::INT END AS bucket FROM s, e)"


@query(f"{S}, {buckets('month < 60')}, g AS (SELECT bucket, {cos('y', 'p1').replace('sum(y * p1)', 'sum(y * p1) FILTER (WHERE month < 60)').replace('sum(y * y)', 'sum(y * y) FILTER (WHERE month < 60)').replace('sum(p1 * p1)', 'sum(p1 * p1) FILTER (WHERE month < 60)')} AS c, coalesce(avg(y * y) FILTER (WHERE month < 60) * count(*) FILTER (WHERE month >= 65), 0) AS ty, count(*) FILTER (WHERE month >= 65) AS nt, coalesce(sum(p1 * p1) FILTER (WHERE month >= 65), 0) AS tp, sum(y * p1) FILTER (WHERE month >= 65) AS typ, sum(y * y) FILTER (WHERE month >= 65) AS tyy FROM z GROUP BY bucket) SELECT {cols({'by_count': 'sum(c * nt) / nullif(sum(nt), 0)', 'by_magnitude': 'sum(c * sqrt(ty) * sqrt(tp)) / nullif(sqrt(sum(ty)) * sqrt(sum(tp)), 0)', 'actual': 'sum(typ) / nullif(sqrt(sum(tyy)) * sqrt(sum(tp)), 0)'})} FROM g")
def g_reweighted_forecast(t):
    return cp.reweighted_forecast(scored(t), "regime", F.col("month") < 60, F.col("month") >= 65)


@query(f"{S}, {buckets('month < 60')}, n AS (SELECT CASE WHEN month < 60 THEN 'train' ELSE 'later' END AS part, bucket, count(*) AS n FROM z GROUP BY ALL), f AS (SELECT part, bucket, n / sum(n) OVER (PARTITION BY part) AS share FROM n) SELECT f.part, f.bucket, {r('f.share')} AS share, {r('f.share - coalesce(t.share, 0)')} AS shift FROM f LEFT JOIN f t ON t.part = 'train' AND t.bucket = f.bucket")
def g_bucket_shares(t):
    early = F.col("month") < 60
    return cp.bucket_shares(scored(t), "regime", F.when(early, "train").otherwise("later"), early)


@query(f"{sql_views('wide')}, {DRIFT}, c(threshold) AS (VALUES (0.1::DOUBLE), (0.3), (0.5)) SELECT {r('threshold')} AS threshold, count(*) FILTER (WHERE NOT coalesce(shift >= threshold, false)) AS kept, count(*) FILTER (WHERE coalesce(shift >= threshold, false)) AS dropped FROM e, c GROUP BY c.threshold")
def g_drift_pruning(t):
    return cp.kept_features(ev.drift(t("wide"), WIDE), [0.1, 0.3, 0.5])


NEW, OLD = [f for f in WIDE if f.startswith("txn")], [f for f in WIDE if not f.startswith("txn")]
BLOCK = " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, round(abs(coalesce({corr(a, b)}, 0)), 9) AS r FROM z" for a in NEW for b in OLD)


@query(f"{sql_views('wide')}, z AS (SELECT " + ", ".join(f"coalesce({f}, 0)::DOUBLE AS {f}" for f in WIDE) + f" FROM wide), x AS ({BLOCK}) SELECT feature, other AS nearest, {r('r')} AS r, r > 0.9 AS duplicate, r < 0.55 AS novel FROM x QUALIFY row_number() OVER (PARTITION BY feature ORDER BY x.r DESC, other) = 1")
def g_nearest_feature(t):
    return cp.nearest_features(t("wide"), NEW, OLD)


ARMS = "a AS (" + " UNION ALL ".join(f"SELECT '{p}' AS model, month, {cos('y', p)} AS v FROM s GROUP BY month" for p in ("p1", "p2")) + ")"


@query(f"{S}, {ARMS} SELECT model, {cols({'slope': 'regr_slope(v, month)', 'r': 'corr(v, month)', 'per_period': '(arg_max(v, month) - arg_min(v, month)) / nullif(max(month) - min(month), 0)', 'projected': 'regr_slope(v, month) * 7'})} FROM a GROUP BY model")
def g_recency_trends(t):
    s = scored(t)
    arms = [s.groupBy("month").agg(cosine(F.col("y"), F.col(p)).alias("cosine")).withColumn("model", F.lit(p)) for p in ("p1", "p2")]
    return cp.score_trends(arms[0].unionByName(arms[1]), "month")


@query(f"{S}, {ARMS}, l AS (SELECT 'p1 - p2' AS model, month, sum(CASE WHEN model = 'p1' THEN v ELSE -v END) AS v FROM a GROUP BY month) SELECT model, {cols({'slope': 'regr_slope(v, month)', 'r': 'corr(v, month)', 'per_period': '(arg_max(v, month) - arg_min(v, month)) / nullif(max(month) - min(month), 0)', 'projected': 'regr_slope(v, month) * 7'})} FROM l GROUP BY model")
def g_lift_trend(t):
    m = scored(t).groupBy("month").agg((cosine(F.col("y"), F.col("p1")) - cosine(F.col("y"), F.col("p2"))).alias("cosine"))
    return cp.score_trends(m.withColumn("model", F.lit("p1 - p2")), "month")


SCORE = "(yp - c * sy) / nullif(sqrt(yy * (pp - 2 * c * sp + n * c * c)), 0)"


@query(f"{S}, u AS (SELECT month % 2 = 0 AS fit, sum(y * p1) AS yp, sum(y) AS sy, sum(p1) AS sp, sum(p1 * p1) AS pp, sum(y * y) AS yy, count(*) AS n FROM s GROUP BY fit), g AS (SELECT (i - 100) * 0.0001::DOUBLE AS c FROM range(201) x(i)), v AS (SELECT c, max({SCORE}) FILTER (WHERE fit) AS fitted, max({SCORE}) FILTER (WHERE NOT fit) AS held FROM u, g GROUP BY c) SELECT {cols({'offset': 'arg_max(c, fitted)', 'fitted_cosine': 'max(fitted)', 'held_cosine': 'arg_max(held, fitted)'}).replace('AS offset', 'AS \"offset\"')} FROM v")
def g_best_offset(t):
    return cp.best_offset(scored(t), F.col("month") % 2 == 0, 0.01)


@query(f"{S}, v AS (SELECT {cos('y', '(p1 + p2)')} AS b, {cos('y', 'p1')} AS x, {cos('y', 'p2')} AS z FROM s) SELECT 'p1' AS family, {cols({'full': 'b', 'standalone': 'x', 'without': 'z', 'marginal': 'b - z', 'share': 'x / nullif(b, 0)'}).replace('AS full', 'AS \"full\"').replace('AS without', 'AS \"without\"')} FROM v UNION ALL SELECT 'p2', {cols({'full': 'b', 'standalone': 'z', 'without': 'x', 'marginal': 'b - x', 'share': 'z / nullif(b, 0)'}).replace('AS full', 'AS \"full\"').replace('AS without', 'AS \"without\"')} FROM v")
def g_family_value(t):
    return cp.family_value(scored(t), {"p1": ["p1"], "p2": ["p2"]})


@query(f"{sql_views('wide')}, u AS ({LONG}), {IMPORTANCE} SELECT feature, {cols({'mean_size': 'mean_size', 'share': 'mean_size / sum(mean_size) OVER ()'})} FROM w")
def g_importance(t):
    return cp.importance(t("wide"), WIDE)


@query(f"{S}, u AS (SELECT sample_id, 'p1' AS feature, p1 AS v FROM s UNION ALL SELECT sample_id, 'p2', p2 FROM s UNION ALL SELECT sample_id, 'y', y FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(v) DESC, feature) AS place FROM u) SELECT sample_id, place, feature, {r('v')} AS value FROM k WHERE place <= 2")
def g_local_top(t):
    return cp.local_top(scored(t), ["p1", "p2", "y"], 2)


CURVE = curve("cost_bps", "g.cost_bps * 1e-4::DOUBLE", "ceil(0.2::DOUBLE * (SELECT count(*) FROM s))", [1.0])


def trade_curve(t: Callable) -> DataFrame:
    return ev.trade_curve(scored(t), 0.2, 1.0)


@query(f"{S}, {CURVE} SELECT month, sample_id, {cols({'pnl': 'pnl', 'equity': 'equity', 'peak': 'peak', 'drawdown': 'fall'})} FROM d WHERE traded")
def h_trade_equity(t):
    return trade_curve(t)


@query(f"{S}, {CURVE}, o AS (SELECT *, row_number() OVER (ORDER BY month, sample_id) - 1 AS pos, count(*) OVER () AS n FROM d WHERE traded), j AS (SELECT DISTINCT CASE WHEN n <= 21 THEN j ELSE round_even(j * (n - 1) / 20, 0)::BIGINT END AS spot FROM (SELECT unnest(range(21)) AS j), (SELECT max(n) AS n FROM o)) SELECT pos, month, sample_id, {cols({'pnl': 'pnl', 'equity': 'equity', 'peak': 'peak', 'drawdown': 'fall'})} FROM o WHERE pos IN (SELECT spot FROM j)")
def h_equity_points(t):
    """21 trades at even places of the curve, the first and the last among them."""
    return ranges.thinned(trade_curve(t), ["month", "sample_id"], 21)


@query(f"{sql_views('market')}, {BOOK}, m AS (SELECT avg(mid) AS a, greatest(stddev_pop(mid), 1e-6) AS b, avg(spread) AS c, greatest(stddev_pop(spread), 1e-6) AS d FROM book WHERE sample_id % 4 <> 0) SELECT row_id, {cols({'mid': 'CASE WHEN mid IS NULL THEN 0 ELSE round(greatest(-6, least(6, (mid - a) / b)), 9) END', 'spread': 'CASE WHEN spread IS NULL THEN 0 ELSE round(greatest(-6, least(6, (spread - c) / d)), 9) END'})} FROM book, m")
def i_channel_scaling(t):
    q = ft.book(t("market")).select("row_id", "sample_id", "mid", "spread")
    z = cp.channel_scaling(q, ["mid", "spread"], F.col("sample_id") % 4 != 0)
    return z.select("row_id", *(F.round(c, 9).alias(c) for c in ("mid", "spread")))  # a z-score's error is that of the mean


@query(f"{S} SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS unordered, 0::BIGINT AS overlapping, arg_min(sample_id, (month, sample_id)) AS first_id, arg_max(sample_id, (month, sample_id)) AS last_id FROM s")
def k_ordered_export(t):
    """What is read back from files numbered in the order of (month, sample_id)."""
    s = scored(t).select("month", "sample_id", "y")
    f = exports.export_ordered(s, sinks.scratch(s.sparkSession, "ordered"), ["month", "sample_id"], rows_per_file=100_000)
    return f.agg(F.sum("n").alias("n_rows"), F.sum("unordered").alias("unordered"), F.count_if("overlaps").alias("overlapping"), F.min("first")["sample_id"].alias("first_id"), F.max("last")["sample_id"].alias("last_id"))


@query(f"{S} SELECT 'scored' AS table_name, count(*) AS n_rows, 'y' AS out_of_range FROM s UNION ALL SELECT 'wide', count(*), 'mkt_price' FROM lineitem")
def j_footer_audit(t):
    """Rows and columns that leave their bounds, told from the footers of two written tables."""
    s, w = scored(t).select("sample_id", "month", "y"), t("wide")
    at = {n: sinks.scratch(s.sparkSession, n) for n in ("scored", "wide")}
    sinks.write_parts(s, at["scored"])
    sinks.write_parts(w, at["wide"])
    bounds = {"month": (0, 70), "y": (0.0, 1.0), "mkt_price": (0.0, 1.0), "ord_tax": (0.0, 1.0)}
    return exports.footer_audit(s.sparkSession, at, bounds).select("table_name", "n_rows", "out_of_range")


@query(f"{S}, a AS (SELECT month, {cos('y', 'p1')} AS c FROM s GROUP BY month) SELECT month, CASE WHEN month = 0 THEN 'only in the first' WHEN month = 70 THEN 'only in the second' WHEN abs(c - (round(c * 100) / 100)) > 0.002 THEN 'differs' ELSE 'agrees' END AS status, CASE WHEN month NOT IN (0, 70) AND abs(c - (round(c * 100) / 100)) > 0.002 THEN 'cosine' ELSE '' END AS columns FROM a")
def g_reconciled_results(t):
    """Monthly scores published as JSON, less the last month, against those published as CSV with two digits, less the first one."""
    s = scored(t).groupBy("month").agg(cosine(F.col("y"), F.col("p1")).alias("cosine"))
    spark, whole, short = s.sparkSession, *(sinks.scratch(s.sparkSession, n) for n in ("json", "csv"))
    s.where("month < 70").write.json(whole)
    s.where("month > 0").select("month", (F.round(F.col("cosine") * 100) / 100).alias("cosine")).write.option("header", True).csv(short)
    schema = "month int, cosine double"
    return exports.reconcile(spark.read.schema(schema).json(whole), spark.read.schema(schema).option("header", True).csv(short), ["month"], ["cosine"], 0.002)


@query(f"{sql_views('market', 'trade')}, a AS (SELECT sample_id, count(*) AS snapshots FROM market GROUP BY sample_id), b AS (SELECT sample_id, count(*) AS trades FROM trade GROUP BY sample_id) SELECT a.sample_id, snapshots, trades FROM a JOIN b ON a.sample_id = b.sample_id")
def c_bucketed_join(t):
    """Two tables written in as many buckets of the sample, grouped and joined without an exchange."""
    tables = []
    for name, count in (("market", "snapshots"), ("trade", "trades")):
        path = sinks.scratch(t(name).sparkSession, name)
        d = exports.write_bucketed(t(name).select("sample_id", "row_id"), f"bucketed_{path.rsplit('-', 1)[-1]}", path, buckets=8)
        tables.append(d.groupBy("sample_id").agg(F.count("*").alias(count)))
    return tables[0].join(tables[1], "sample_id")


@query(f"{S} SELECT count(*) AS n, sum(sample_id)::BIGINT AS ids FROM s")
def a_whole_load(t):
    """Rows of a load in three parts that became visible together, keyed from 0."""
    s = ranges.kept(ranges.numbered(scored(t).select("sample_id"), ["sample_id"]))
    path = sinks.scratch(s.sparkSession, "load")
    exports.load_whole({f"p{i}": s.where(F.col("pos") % 3 == i) for i in range(3)}, path, "scored", "pos")
    return exports.read_whole(s.sparkSession, path).agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"))


@query(f"{S} SELECT sample_id, {r('y')} AS y FROM s ORDER BY (sample_id * 7919) % 10007, sample_id LIMIT 100")
def k_spread_sample(t):
    return scored(t).orderBy(F.pmod(F.col("sample_id") * 7919, F.lit(10007)), "sample_id").limit(100).select("sample_id", "y")


@query(f"{sql_views('market')}, k AS (SELECT row_id, count(*) AS n FROM market GROUP BY row_id) SELECT coalesce(sum(n) FILTER (WHERE row_id IS NULL), 0)::BIGINT AS nulls, count(*) FILTER (WHERE row_id IS NOT NULL AND n > 1) AS repeated, (max(row_id) - min(row_id) + 1 - count(row_id))::BIGINT AS missing FROM k")
def a_key_faults(t):
    return sinks.key_faults(t("market"), "row_id")


@query(f"{S} SELECT month, count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', sample_id, month)), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM s GROUP BY month")
def a_table_round_trip(t):
    """What a partitioned table holds after it was written to the shared folder and read again."""
    s = scored(t).select("month", "sample_id")
    path = sinks.scratch(s.sparkSession, "table")
    sinks.write_table(s, path)
    return sinks.manifest(s.sparkSession.read.parquet(path), ["sample_id", "month"], ["month"])


@query(f"{sql_views('wide')} SELECT " + r("(" + " + ".join(f"avg(({c} IS NULL)::INT)" for c in WIDE) + f") / {len(WIDE)}") + " AS null_share FROM wide")
def g_null_share(t):
    return sinks.all_null_share(t("wide"), WIDE)
