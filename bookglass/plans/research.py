"""Registered queries of fits, verdicts, trades by threshold and batch scoring, each beside the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.functions.exprs import corr_safe, cosine
from bookglass.operators import ablation, adversarial
from bookglass.operators import evaluation as ev
from bookglass.operators import features as ft
from bookglass.operators import linear, models
from bookglass.operators import research as rs
from bookglass.operators.linear import group_quantiles
from bookglass.plans.sql import BOOK, DRIFT, FOLD_ROWS, S, WIDE, cols, corr, cos, metric_cols, r
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


TABLES = ("events", "orders", "lineitem", "documents")


@query(" UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS n FROM {n}" for n in TABLES))
def a_row_counts(t):
    each = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("source"), "n") for n in TABLES]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


@query(f"{S} SELECT CASE WHEN p1 > 1e-3 THEN 'UP' WHEN p1 < -1e-3 THEN 'DOWN' ELSE 'FLAT' END AS direction, count(*) AS n, {r('avg(y)')} AS mean FROM s GROUP BY 1")
def b_direction_labels(t):
    return scored(t).groupBy(rs.direction(F.col("p1"), 1e-3).alias("direction")).agg(F.count("*").alias("n"), F.avg("y").alias("mean"))


@query(f"{sql_views('market')}, {BOOK}, x AS (SELECT greatest(-10, least(10, spread / mid * 1e4)) AS v FROM book WHERE mid IS NOT NULL) SELECT floor(v)::BIGINT AS bin, count(*) AS n FROM x GROUP BY bin")
def b_clipped_bins(t):
    x = ft.book(t("market")).where("mid is not null").select(rs.clip(F.col("spread") / F.col("mid") * 1e4, -10.0, 10.0).alias("v"))
    return x.groupBy(F.floor("v").alias("bin")).agg(F.count("*").alias("n"))


KIND_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM e WHERE regexp_matches(feature, '{p}')" for k, p in (rs.KINDS | {"price": "price", "amount": "quantity|discount|tax"}).items())


@query(f"{sql_views('wide')}, {DRIFT}, k AS ({KIND_ROWS}) SELECT kind, count(*) AS n, {cols({'most': 'max(shift)', 'mean': 'avg(shift)'})} FROM k GROUP BY kind")
def g_drift_by_kind(t):
    w = t("wide")
    d = ev.drift(w, rs.feature_columns(w, ("l_orderkey", "split")))
    return rs.by_kind(d, rs.KINDS | {"price": "price", "amount": "quantity|discount|tax"}).groupBy("kind").agg(F.count("*").alias("n"), F.max("shift").alias("most"), F.avg("shift").alias("mean"))


MARKET_SCORED = f"{sql_views('market', 'scored')}, {BOOK}, s AS (SELECT * FROM scored WHERE month BETWEEN 0 AND 70)"


@query(f"{MARKET_SCORED} SELECT s.month, count(*) AS n, {r('avg(spread)')} AS spread FROM book JOIN s ON book.sample_id = s.sample_id GROUP BY s.month")
def c_month_enrichment(t):
    return ft.book(t("market")).join(scored(t).select("sample_id", "month"), "sample_id").groupBy("month").agg(F.count("*").alias("n"), F.avg("spread").alias("spread"))




@query(f"{MARKET_SCORED}, f AS (SELECT sample_id, avg(spread) AS spread, count(*) AS snapshots FROM book GROUP BY sample_id) SELECT f.sample_id, {r('f.spread')} AS spread, snapshots, {r('p1')} AS p1 FROM f JOIN s ON f.sample_id = s.sample_id WHERE month >= 65")
def c_test_features_predictions(t):
    f = ft.book(t("market")).groupBy("sample_id").agg(F.avg("spread").alias("spread"), F.count("*").alias("snapshots"))
    return f.join(scored(t).where("month >= 65").select("sample_id", "p1"), "sample_id")


@query(f"{S} SELECT month, count(*) AS n, {r('avg(y)')} AS mean FROM s WHERE sample_id IN (SELECT user_id FROM events WHERE user_id % 3 = 0) GROUP BY month")
def c_rows_of_given_ids(t):
    ids = t("events").select(F.col("user_id").alias("sample_id")).where("sample_id % 3 = 0").distinct()
    return scored(t).join(ids, "sample_id", "left_semi").groupBy("month").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))


@query(f"{sql_views('order_flow')}, c AS (SELECT count(*) AS n FROM order_flow GROUP BY sample_id) SELECT max(n) AS most, count(*) FILTER (WHERE n = 999) AS at_cap, count(*) FILTER (WHERE n >= 995) AS near_cap, count(*) FILTER (WHERE n BETWEEN 900 AND 949) AS band_below, count(*) AS samples FROM c")
def d_row_cap_bands(t):
    n = F.col("n")
    return t("order_flow").groupBy("sample_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count_if(n == 999).alias("at_cap"), F.count_if(n >= 995).alias("near_cap"), F.count_if(n.between(900, 949)).alias("band_below"), F.count("*").alias("samples"))


@query(f"""{S}, e AS (SELECT min(regime) AS lo, (max(regime) - min(regime)) / 40 AS w FROM s), b AS (SELECT greatest(0, least(39, ceil((regime - lo) / w) - 1)) AS bin, lo, w FROM s, e),
m AS (SELECT bin::BIGINT AS bin, lo + (bin + 0.5e0) * w AS mid, count(*) AS n FROM b GROUP BY bin, lo, w)
SELECT bin, n, {r('round(mid / pow(10, floor(log10(mid)) - 3)) * pow(10, floor(log10(mid)) - 3)')} AS middle FROM m""")
def d_histogram_midpoints(t):
    s = scored(t).select("regime")
    e = s.agg(F.min("regime").alias("lo"), ((F.max("regime") - F.min("regime")) / 40).alias("w"))
    bin_ = F.greatest(F.lit(0), F.least(F.lit(39), F.ceil((F.col("regime") - F.col("lo")) / F.col("w")) - 1)).cast("long")
    b = s.crossJoin(F.broadcast(e)).groupBy(bin_.alias("bin"), "lo", "w").agg(F.count("*").alias("n"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * F.col("w")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(mid)) - 3)
    return b.select("bin", "n", (F.round(mid / unit) * unit).alias("middle"))


MEANS = ("y", "p1", "p2", "regime")


@query(f"{S} SELECT month, {cols({f'mean_{c}': f'avg({c})' for c in MEANS})} FROM s GROUP BY month")
def d_month_means(t):
    return scored(t).groupBy("month").agg(*(F.avg(c).alias(f"mean_{c}") for c in MEANS))


HALF = "substr(md5(concat_ws(':', sample_id::VARCHAR, '7')), 1, 1) < '3'"
FIT = "(d * u - b * v) / (a * d - b * b) AS w1, (a * v - b * u) / (a * d - b * b) AS w2"
GRAM = "sum(p1 * p1) AS a, sum(p1 * p2) AS b, sum(p2 * p2) AS d, sum(p1 * y) AS u, sum(p2 * y) AS v"


@query(f"""{S}, k AS (SELECT *, 'random' AS split, {HALF} AS held FROM s UNION ALL SELECT *, 'temporal', month >= 57 FROM s),
g AS (SELECT split, {GRAM} FROM k WHERE NOT held GROUP BY split), w AS (SELECT split, {FIT} FROM g)
SELECT k.split, count(*) AS n, {r(cos('y', '(w1 * p1 + w2 * p2)'))} AS cosine FROM k JOIN w ON k.split = w.split WHERE held GROUP BY k.split""")
def f_split_inflation(t):
    s = scored(t)
    md5 = F.md5(F.concat_ws(":", F.col("sample_id").cast("string"), F.lit("7")))
    k = s.select("*", F.lit("random").alias("split"), (F.substring(md5, 1, 1) < "3").alias("held")).unionByName(s.select("*", F.lit("temporal").alias("split"), (F.col("month") >= 57).alias("held")))
    fits = {key: rs.least_squares(*g) for key, g in rs.sums(k.where("not held"), ["p1", "p2"], ["split"]).items()}
    return rs._with_weights(k.where("held"), fits, ["p1", "p2"], ["split"]).groupBy("split").agg(F.count("*").alias("n"), cosine(F.col("y"), F.col("linear")).alias("cosine"))


@query(f"""{MARKET_SCORED}, f AS (SELECT sample_id, max(greatest(is_empty_bid, is_empty_ask)) = 1 AS ever_empty FROM book GROUP BY sample_id)
SELECT ever_empty, count(*) AS n, {r(cos('y', 'p1'))} AS cosine FROM f JOIN s ON f.sample_id = s.sample_id GROUP BY ever_empty""")
def g_ever_empty(t):
    f = ft.book(t("market")).groupBy("sample_id").agg((F.max(F.greatest("is_empty_bid", "is_empty_ask")) == 1).alias("ever_empty"))
    return f.join(scored(t), "sample_id").groupBy("ever_empty").agg(F.count("*").alias("n"), cosine(F.col("y"), F.col("p1")).alias("cosine"))


@query(f"{S}, e AS (SELECT quantile_cont(regime, 0.25) AS a, quantile_cont(regime, 0.5) AS b, quantile_cont(regime, 0.75) AS c FROM s), z AS (SELECT s.*, CASE WHEN regime <= a THEN 1 WHEN regime <= b THEN 2 WHEN regime <= c THEN 3 ELSE 4 END AS quartile FROM s, e) SELECT quartile, count(*) AS n, {cols({'cosine': cos('y', 'p1'), 'median': 'quantile_cont(regime, 0.5)'})} FROM z GROUP BY quartile")
def g_quartile_medians(t):
    z = ev.quartiles(scored(t), "regime")
    middles = group_quantiles(z, ["quartile"], "regime", {"median": 0.5})
    return z.groupBy("quartile").agg(F.count("*").alias("n"), cosine(F.col("y"), F.col("p1")).alias("cosine")).join(middles, "quartile")


@query(f"""{S}, g AS (SELECT grp, sum(y * p1) AS yp, sum(y * y) AS yy, sum(p1 * p1) AS pp FROM s GROUP BY grp), q AS (SELECT sum(yp) / (sqrt(sum(yy)) * sqrt(sum(pp))) AS pooled, sum(sqrt(yy) * sqrt(pp)) / (sqrt(sum(yy)) * sqrt(sum(pp))) AS weight_sum FROM g)
SELECT {cols({'pooled': 'pooled', 'rebuilt': 'pooled', 'weight_sum': 'weight_sum'})}, true AS holds FROM q""")
def g_decomposition_identity(t):
    s = scored(t)
    parts = ev.decomposition(s, "grp").agg(F.sum("contribution").alias("rebuilt"), F.sum("weight").alias("weight_sum"))
    pooled = s.agg(cosine(F.col("y"), F.col("p1")).alias("pooled"))
    return pooled.crossJoin(F.broadcast(parts)).withColumn("holds", F.abs(F.col("pooled") - F.col("rebuilt")) < 1e-12)


#: Beyond the exact values, the expansion about the normal's quantile.
BEYOND = "1.959963984540054e0 + {0!r} / (n - 1) + {1!r} / ((n - 1) * (n - 1)) + {2!r} / ((n - 1) * (n - 1) * (n - 1.0e0))".format(*((lambda z: ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384))(1.959963984540054)))
T = f"(CASE WHEN n - 1 <= {len(rs.T_VALUES)} THEN ({rs.T_VALUES!r}::DOUBLE[])[(n - 1)::INT] ELSE {BEYOND} END)"


@query(f"""{S}, m AS (SELECT month, {cos('y', 'p1')} - {cos('y', 'p2')} AS g FROM s GROUP BY month), v AS (SELECT avg(g) AS gain, stddev_samp(g) / sqrt(count(g)) AS se, count(*) FILTER (WHERE g > 0) AS improved, count(g) AS n FROM m)
SELECT {cols({'gain': 'gain', 'se': 'se', 'normal_low': 'gain - se * 1.96', 'normal_high': 'gain + se * 1.96', 't_low': f'gain - se * {T}', 't_high': f'gain + se * {T}'})}, improved, n, gain - se * 1.96 > -0.001 AS free, gain - se * {T} > 0 AS adds, gain - se * {T} > 0 AND gain >= 0.0041 AS worth_keeping FROM v""")
def g_paired_intervals(t):
    m = scored(t).groupBy("month").agg(cosine(F.col("y"), F.col("p1")).alias("a"), cosine(F.col("y"), F.col("p2")).alias("b"))
    return rs.paired_verdict(m, F.col("a") - F.col("b"))


@query(f"""{S}, m AS (SELECT month, {cos('y', 'p1')} AS v FROM s GROUP BY month), x AS (SELECT regr_slope(v, month) AS slope, regr_intercept(v, month) AS start, regr_sxx(v, month) AS sxx, regr_sxy(v, month) AS sxy, regr_syy(v, month) AS syy, count(*) AS n, max(month) - min(month) AS span, stddev_samp(v) / sqrt(count(v)) AS noise FROM m),
e AS (SELECT *, sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se FROM x)
SELECT {cols({'slope': 'slope', 'start': 'start', 'se': 'se', 'span_low': '(slope - 1.96 * se) * span', 'span_high': '(slope + 1.96 * se) * span', 'noise': 'noise'})}, n FROM e""")
def g_trend_intervals(t):
    return rs.trend(scored(t).groupBy("month").agg(cosine(F.col("y"), F.col("p1")).alias("v")), "month", "v")


@query(f"""{S}, b AS (SELECT (month - 36) // 3 AS block, max(month) AS last, {cos('y', 'p1')} AS cosine FROM s WHERE month >= 36 GROUP BY block), h AS (SELECT {cos('y', 'p1')} AS holdout FROM s WHERE month >= 65),
p AS (SELECT quantile_cont(cosine, 0.5) FILTER (WHERE last < 65) AS typical, max(holdout) AS holdout, avg((cosine < holdout)::INT) AS percentile, count(*) AS blocks FROM b, h)
SELECT blocks, {cols({'typical': 'typical', 'holdout': 'holdout', 'percentile': 'percentile', 'ratio': 'holdout / typical', 'debiased': '0.15171e0 / (holdout / typical)'})} FROM p""")
def g_period_luck(t):
    b = scored(t).where("month >= 36").groupBy(F.floor((F.col("month") - 36) / 3).alias("block")).agg(F.max("month").alias("last"), cosine(F.col("y"), F.col("p1")).alias("cosine"))
    h = scored(t).where("month >= 65").agg(cosine(F.col("y"), F.col("p1")).alias("holdout"))
    p = b.crossJoin(F.broadcast(h)).agg(F.percentile(F.when(F.col("last") < 65, F.col("cosine")), F.lit(0.5)).alias("typical"), F.max("holdout").alias("holdout"), F.avg((F.col("cosine") < F.col("holdout")).cast("double")).alias("percentile"), F.count("*").alias("blocks"))
    ratio = F.col("holdout") / F.col("typical")
    return p.select("blocks", "typical", "holdout", "percentile", ratio.alias("ratio"), (F.lit(0.15171) / ratio).alias("debiased"))


FIXED_ALPHAS = ", ".join(f"({a}::DOUBLE)" for a in rs.ALPHAS)


@query(f"""{S}, z AS (SELECT *, (month >= 36)::INT AS half, regime / 150000e0 AS scale FROM s), a(alpha) AS (VALUES {FIXED_ALPHAS}),
c AS (SELECT half, alpha, {cos('y', 'p1 * pow(scale, alpha)')} AS c, {cos('y', 'p1')} AS plain FROM z, a GROUP BY half, alpha), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY half ORDER BY c DESC, alpha DESC) = 1)
SELECT b.half AS fit, {cols({'alpha': 'b.alpha', 'gain': 'o.c - o.plain'})} FROM b JOIN c o ON o.half = 1 - b.half AND o.alpha = b.alpha""")
def g_regime_alpha(t):
    return rs.regime_scale_grid(scored(t), F.col("regime") / 150000.0, 36)


BLOCKS = [(0, 5), (12, 17), (24, 29), (36, 41), (48, 53), (60, 64), (65, 70)]
AUC_SQL = f"""{S}, k(lo, hi) AS (VALUES {", ".join(map(str, BLOCKS[1:]))}), x AS (SELECT k.lo, regime, month > 5 AS pos FROM s JOIN k ON month BETWEEN 0 AND 5 OR month BETWEEN k.lo AND k.hi),
rk AS (SELECT *, rank() OVER (PARTITION BY lo ORDER BY regime) + (count(*) OVER (PARTITION BY lo, regime) - 1) / 2 AS place FROM x), c AS (SELECT lo, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q, sum(place) FILTER (WHERE pos) AS t FROM rk GROUP BY lo),
au AS (SELECT lo, (t - p * (p + 1) / 2) / (p * q::DOUBLE) AS auc FROM c)"""


@query(f"""{AUC_SQL}, f AS (SELECT regr_slope(auc, lo) AS slope, regr_intercept(auc, lo) AS start, max(auc) AS most FROM au WHERE lo < 65)
SELECT {cols({'slope': 'slope', 'start': 'start', 'most': 'most', 'test': 'auc', 'implied_distance': '(auc - start) / slope'})} FROM f, au WHERE lo = 65""")
def g_auc_distance(t):
    k = F.broadcast(t("scored").sparkSession.createDataFrame(BLOCKS[1:], "lo int, hi int"))
    m = F.col("month")
    x = scored(t).join(k, m.between(0, 5) | m.between(F.col("lo"), F.col("hi")))
    a = rs.auc(x, "regime", m > 5, ["lo"])
    f = a.where("lo < 65").agg(F.regr_slope("auc", "lo").alias("slope"), F.regr_intercept("auc", "lo").alias("start"), F.max("auc").alias("most"))
    return f.crossJoin(F.broadcast(a.where("lo = 65").select(F.col("auc").alias("test")))).withColumn("implied_distance", (F.col("test") - F.col("start")) / F.col("slope"))


def dated(t: Callable) -> DataFrame:
    """The rows of wide with the month of their order, and ``line``, what tells an order's rows apart."""
    return t("wide").join(scored(t).select(F.col("sample_id").alias("l_orderkey"), "month"), "l_orderkey").withColumn("line", F.xxhash64(*WIDE))


@query()
def g_adversarial_blocks(t):
    """Per block of months, how well all features tell it from months 0 to 5; block -1: even from odd hashes of the orders, which nothing should tell."""
    d, m = dated(t), F.col("month")
    labels = [F.when(m.between(0, 5) | m.between(*b), m > 5) for b in BLOCKS[1:]] + [F.pmod(F.xxhash64("l_orderkey"), F.lit(2)) == 1]
    names = d.sparkSession.createDataFrame([(i, lo) for i, lo in enumerate([lo for lo, _ in BLOCKS[1:]] + [-1])], "group int, lo int")
    return adversarial.labelled_auc(d, labels, WIDE, ["l_orderkey", "line"]).join(F.broadcast(names), "group").select("lo", "auc", "positives", "negatives")


@query()
def g_adversarial_boosted(t):
    """How well boosted trees over all features tell the test split's rows from the training split's."""
    d = t("wide").withColumn("line", F.xxhash64(*WIDE))
    return adversarial.adversarial_auc(d, F.col("split") == "test", WIDE, ["l_orderkey", "line"], model="boosted", rounds=5)


@query(f"{S} SELECT 'p1' AS a, 'p2' AS b, {r('abs(' + corr('p1', 'p2') + ')')} AS r FROM s UNION ALL SELECT 'p1', 'y', {r('abs(' + corr('p1', 'y') + ')')} FROM s UNION ALL SELECT 'p2', 'y', {r('abs(' + corr('p2', 'y') + ')')} FROM s")
def g_prediction_correlations(t):
    return ev.correlation_pairs(scored(t), ["p1", "p2", "y"])


FOLD_COS = f"fc AS (SELECT model, fold, cosine FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS model, fold, {cos('y', p)} AS cosine FROM fr WHERE role = 'val' GROUP BY fold" for p in ("p1", "p2")) + "))"


def fold_scores(t):
    v = ev.fold_rows(scored(t)).where("role = 'val'")
    s = [ev.metrics(v, ["fold"], p=p).select("fold", "cosine", F.lit(p).alias("model")) for p in ("p1", "p2")]
    return s[0].unionByName(s[1])


@query(f"{S}, {FOLD_ROWS}, {FOLD_COS} SELECT model, {cols({'stated': 'avg(cosine)', 'recomputed': 'sum(cosine) / count(*)'})}, true AS agrees FROM fc GROUP BY model")
def g_stated_means(t):
    s = fold_scores(t)
    stated = ev.stability(s, by=["model"]).select("model", F.col("mean").alias("stated"))
    again = s.groupBy("model").agg((F.sum("cosine") / F.count("*")).alias("recomputed"))
    return stated.join(again, "model").withColumn("agrees", F.abs(F.col("stated") - F.col("recomputed")) <= 1e-10)


@query(f"""{S}, {FOLD_ROWS}, {FOLD_COS}, st AS (SELECT model, avg(cosine) AS mean, coalesce(stddev_samp(cosine), 0) AS std FROM fc GROUP BY model)
SELECT arg_max(model, mean) AS best_mean, arg_min(model, std) AS most_stable, {cols({'gap': 'max(mean) - min(mean)', 'noise': 'avg(std)'})}, max(mean) - min(mean) > avg(std) AS clear FROM st""")
def g_model_choice(t):
    s = ev.stability(fold_scores(t), by=["model"])
    return s.agg(F.max_by("model", "mean").alias("best_mean"), F.min_by("model", "std").alias("most_stable"), (F.max("mean") - F.min("mean")).alias("gap"), F.avg("std").alias("noise")).withColumn("clear", F.col("gap") > F.col("noise"))


@query(f"{S} SELECT {cols({'zero_targets': 'avg((y = 0)::INT)', 'p1_mean': 'avg(p1)', 'p1_std': 'stddev_samp(p1)', 'p2_mean': 'avg(p2)', 'p2_std': 'stddev_samp(p2)'})} FROM s")
def g_shares_and_spread(t):
    return scored(t).agg(F.avg((F.col("y") == 0).cast("double")).alias("zero_targets"), *(f(p).alias(f"{p}_{n}") for p in ("p1", "p2") for n, f in (("mean", F.avg), ("std", F.stddev))))


TRADES = """k AS (SELECT *, CASE WHEN abs(p1) > threshold THEN sign(p1) * y - 1e-4 END AS pnl FROM s, lim), d AS (SELECT *, sum(coalesce(pnl, 0)) OVER w AS eq FROM k WINDOW w AS (ORDER BY month, sample_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, eq - max(eq) OVER (ORDER BY month, sample_id ROWS UNBOUNDED PRECEDING) AS fall FROM d)"""
TRADE_COLS = cols({"threshold": "(SELECT threshold FROM lim)", "turnover": "count(pnl) / (SELECT count(*) FROM s)", "total": "coalesce(sum(pnl), 0)", "mean": "coalesce(avg(pnl), 0)", "volatility": "coalesce(stddev_samp(pnl), 0)", "sharpe": "coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0)", "win_rate": "coalesce(avg((pnl > 0)::INT), 0)", "max_drawdown": "coalesce(min(fall), 0)"})


@query(f"{S}, lim AS (SELECT quantile_cont(abs(p1), 0.8) AS threshold FROM s), {TRADES} SELECT count(pnl) AS trades, {TRADE_COLS} FROM e")
def h_threshold_trades(t):
    return rs.threshold_trades(scored(t))


@query(f"{S}, lim AS (SELECT 1e6::DOUBLE AS threshold), {TRADES} SELECT count(pnl) AS trades, {TRADE_COLS} FROM e")
def h_no_trade(t):
    return rs.threshold_trades(scored(t), threshold=1e6)


WALK = f"""{S}, {FOLD_ROWS}, g AS (SELECT fold, avg(y) AS m, {GRAM} FROM fr WHERE role = 'train' GROUP BY fold), w AS (SELECT fold, m, {FIT} FROM g),
x AS (SELECT fr.fold, y, 0e0 AS zero, m AS mean, w1 * p1 + w2 * p2 AS linear FROM fr JOIN w ON fr.fold = w.fold WHERE role = 'val')"""


@query(WALK + " " + " UNION ALL ".join(f"SELECT '{m}' AS model, fold, {metric_cols('y', m)} FROM x GROUP BY fold" for m in ("zero", "mean", "linear")))
def i_walk_forward(t):
    x = rs.walk_forward(ev.fold_rows(scored(t)), ["p1", "p2"])
    out = [ev.metrics(x, ["fold"], p=m).withColumn("model", F.lit(m)) for m in ("zero", "mean", "linear")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""{S}, {FOLD_ROWS}, m AS (SELECT fold, avg(p1) AS m1, avg(p2) AS m2, avg(y) AS my, stddev_pop(p1) AS s1, stddev_pop(p2) AS s2, count(*)::DOUBLE AS n FROM fr WHERE role = 'train' GROUP BY fold),
q AS (SELECT fold, sum((p1 - m1) / s1 * ((p2 - m2) / s2)) AS c, sum((p1 - m1) / s1 * (y - my)) AS u, sum((p2 - m2) / s2 * (y - my)) AS v FROM fr JOIN m USING (fold) WHERE role = 'train' GROUP BY fold),
w AS (SELECT *, ((n + 10) * u - c * v) / ((n + 10) * (n + 10) - c * c) AS w1, ((n + 10) * v - c * u) / ((n + 10) * (n + 10) - c * c) AS w2 FROM m JOIN q USING (fold)),
x AS (SELECT fold, y, my + w1 * (p1 - m1) / s1 + w2 * (p2 - m2) / s2 AS prediction FROM fr JOIN w USING (fold) WHERE role = 'val')
SELECT fold, {metric_cols('y', 'prediction')} FROM x GROUP BY fold""")
def i_walk_forward_ridge(t):
    return ev.metrics(linear.walk_forward_ridge(scored(t), ["p1", "p2"]), ["fold"], p="prediction")


@query()
def i_walk_forward_boosted(t):
    """Per fold, the scores of boosted trees fitted on the fold's training months."""
    return ev.metrics(models.walk_forward_boosted(scored(t), ["p1", "p2"], rounds=5), ["fold"], p="prediction")


def featured(t: Callable) -> tuple[DataFrame, list[str]]:
    """(sample_id, month, y, all features of the assembly) of the samples, the month and target being those of the order of that number."""
    x = ft.assemble(ft.market_features(t("market")), ft.order_features(t("order_flow")), ft.trade_features(t("trade")))
    features = rs.feature_columns(x, ("sample_id",))
    return x.join(scored(t).select("sample_id", "month", "y"), "sample_id"), features


@query()
def i_ridge_features(t):
    """Per fold, the scores of a ridge on all features of the assembly, whose nulls are filled with the fold's own medians."""
    x, features = featured(t)
    return ev.metrics(linear.walk_forward_ridge(x, features), ["fold"], p="prediction")


#: A ridge on each of two families of one feature, and on both, per fold: m, q and w as for i_walk_forward_ridge.
ABLATION = f"""{S}, {FOLD_ROWS}, m AS (SELECT fold, avg(p1) AS m1, avg(p2) AS m2, avg(y) AS my, stddev_pop(p1) AS s1, stddev_pop(p2) AS s2, count(*)::DOUBLE AS n FROM fr WHERE role = 'train' GROUP BY fold),
q AS (SELECT fold, sum((p1 - m1) / s1 * ((p2 - m2) / s2)) AS c, sum((p1 - m1) / s1 * (y - my)) AS u, sum((p2 - m2) / s2 * (y - my)) AS v FROM fr JOIN m USING (fold) WHERE role = 'train' GROUP BY fold),
w AS (SELECT *, ((n + 10) * u - c * v) / ((n + 10) * (n + 10) - c * c) AS w1, ((n + 10) * v - c * u) / ((n + 10) * (n + 10) - c * c) AS w2 FROM m JOIN q USING (fold)),
x AS (SELECT fold, y, my + u / (n + 10) * (p1 - m1) / s1 AS a, my + v / (n + 10) * (p2 - m2) / s2 AS b, my + w1 * (p1 - m1) / s1 + w2 * (p2 - m2) / s2 AS ab FROM fr JOIN w USING (fold) WHERE role = 'val'),
z AS (SELECT fold, 'first' AS families, 1 AS n, {cos('y', 'a')} AS cosine FROM x GROUP BY fold UNION ALL SELECT fold, 'second', 1, {cos('y', 'b')} FROM x GROUP BY fold UNION ALL SELECT fold, 'first+second', 2, {cos('y', 'ab')} FROM x GROUP BY fold),
t AS (SELECT families, n, avg(cosine) AS mean, coalesce(stddev_samp(cosine), 0) AS std, min(cosine) AS lowest, arg_min(fold, cosine) AS worst_fold FROM z GROUP BY families, n)"""
PAIR = {"first": ["p1"], "second": ["p2"]}


@query(f"{ABLATION} SELECT families, n AS n_families, n AS n_features, {cols({'cosine_mean': 'mean', 'cosine_std': 'std', 'cosine_min': 'lowest'})}, worst_fold FROM t")
def i_ablation(t):
    """Both families of predictions and each alone, refitted on every fold."""
    return ablation.ablation(ablation.subset_scores(scored(t), PAIR))


@query(f"{ABLATION} SELECT o.families AS family, o.n AS n_features, {cols({'standalone': 'o.mean', 'without_it': 'w.mean', 'marginal_gain': 'b.mean - w.mean', 'share_of_full': 'o.mean / nullif(b.mean, 0)'})} FROM t o, t w, t b WHERE o.n = 1 AND w.n = 1 AND o.families <> w.families AND b.n = 2")
def g_family_refits(t):
    """What each family adds to the other and reaches alone, by refits."""
    return ablation.marginal_values(ablation.ablation(ablation.subset_scores(scored(t), PAIR)), list(PAIR))


@query()
def i_ablation_features(t):
    """All subsets of the market, order and trade features of the assembly, refitted on every fold."""
    x, features = featured(t)
    return ablation.ablation(ablation.subset_scores(x, {f: [c for c in features if c.startswith(f + "_")] for f in ("mkt", "ord", "txn")}))


@query(f"""{S}, w AS (SELECT {FIT} FROM (SELECT {GRAM} FROM s WHERE month <= 34)) SELECT ((month - 36) // 6)::BIGINT AS block, count(*) AS n, {cols({'cosine': cos('y', '(w1 * p1 + w2 * p2)'), 'rmse': 'sqrt(avg((y - w1 * p1 - w2 * p2) * (y - w1 * p1 - w2 * p2)))'})} FROM s, w WHERE month >= 36 GROUP BY block""")
def i_fixed_fit_blocks(t):
    s = scored(t)
    gram, b = rs.sums(s.where("month <= 34"), ["p1", "p2"], [])[()]
    w = rs.least_squares(gram, b)
    x = s.where("month >= 36").withColumn("p", F.col("p1") * float(w[0]) + F.col("p2") * float(w[1])).withColumn("block", F.floor((F.col("month") - 36) / 6))
    return x.groupBy("block").agg(F.count("*").alias("n"), cosine(F.col("y"), F.col("p")).alias("cosine"), F.sqrt(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))).alias("rmse"))


NNLS = """o AS (SELECT *, (d * u - b * v) / (a * d - b * b) AS x1, (a * v - b * u) / (a * d - b * b) AS x2 FROM {src}),
{out} AS (SELECT fold, CASE WHEN x1 >= 0 AND x2 >= 0 THEN x1 WHEN u > 0 AND (v <= 0 OR u * u / a >= v * v / d) THEN u / a ELSE 0 END AS w1, CASE WHEN x1 >= 0 AND x2 >= 0 THEN x2 WHEN v > 0 AND (u <= 0 OR u * u / a < v * v / d) THEN v / d ELSE 0 END AS w2 FROM o)"""


@query(f"""{S}, {FOLD_ROWS}, g AS (SELECT fold, {GRAM} FROM fr WHERE role = 'val' GROUP BY fold), h AS (SELECT g.fold, sum(e.a) AS a, sum(e.b) AS b, sum(e.d) AS d, sum(e.u) AS u, sum(e.v) AS v FROM g JOIN g e ON e.fold < g.fold GROUP BY g.fold),
{NNLS.format(src='g', out='ow')}, {NNLS.format(src='h', out='fz').replace('o AS (', 'o2 AS (').replace('FROM o)', 'FROM o2)')}
SELECT fr.fold, {cols({'frozen': cos('y', '(fz.w1 * p1 + fz.w2 * p2)'), 'own': cos('y', '(ow.w1 * p1 + ow.w2 * p2)')})} FROM fr JOIN fz ON fr.fold = fz.fold JOIN ow ON fr.fold = ow.fold WHERE role = 'val' GROUP BY fr.fold""")
def g_frozen_blend(t):
    x = rs.frozen_blend(ev.fold_rows(scored(t)), ["p1", "p2"])
    return x.groupBy("fold").agg(cosine(F.col("y"), F.col("frozen")).alias("frozen"), cosine(F.col("y"), F.col("own")).alias("own"))


@query(f"""{S}, w AS (SELECT *, {FIT}, u / a AS s1, v / d AS s2 FROM (SELECT {GRAM} FROM s WHERE month <= 34)), x AS (SELECT * FROM s, w WHERE month BETWEEN 36 AND 40)
SELECT 'first' AS families, {r(cos('y', '(s1 * p1)'))} AS cosine FROM x UNION ALL SELECT 'second', {r(cos('y', '(s2 * p2)'))} FROM x UNION ALL SELECT 'first+second', {r(cos('y', '(w1 * p1 + w2 * p2)'))} FROM x""")
def i_family_subsets(t):
    s = scored(t)
    return rs.family_subsets(s.where("month <= 34"), s.where("month between 36 and 40"), {"first": ["p1"], "second": ["p2"]})


@query(f"""{S}, k AS (SELECT s.*, seed, CASE WHEN substr(md5(concat_ws(':', sample_id::VARCHAR, seed::VARCHAR)), 1, 1) < '8' THEN 0 ELSE 1 END AS half FROM s, (SELECT unnest([1, 2, 3]) AS seed)),
c AS (SELECT seed, w, {cos('y', '(p1 * w + p2 * (1 - w))').replace('sum(', 'sum(CASE WHEN half = 0 THEN 1 END * ')} AS chosen_on, {cos('y', '(p1 * w + p2 * (1 - w))').replace('sum(', 'sum(CASE WHEN half = 1 THEN 1 END * ')} AS fresh FROM k, (SELECT unnest([0, 0.25, 0.5, 0.75, 1])::DOUBLE AS w) GROUP BY seed, w)
SELECT seed, {cols({'weight': 'w', 'chosen_on': 'chosen_on', 'fresh': 'fresh', 'optimism': 'chosen_on - fresh'})} FROM c QUALIFY row_number() OVER (PARTITION BY seed ORDER BY c.chosen_on DESC, w DESC) = 1""")
def i_grid_on_fresh_seeds(t):
    return rs.grid_on_fresh_seeds(scored(t))


@query(f"{S} SELECT sample_id, {cols({'part_a': '(p1 * 0.6e0) * 0.7e0', 'part_b': '(p1 * -0.2e0 + p2 * 0.9e0) * 0.3e0', 'blend': '(p1 * 0.6e0) * 0.7e0 + (p1 * -0.2e0 + p2 * 0.9e0) * 0.3e0'})}, CASE WHEN (p1 * 0.6e0) * 0.7e0 + (p1 * -0.2e0 + p2 * 0.9e0) * 0.3e0 > 0.0005 THEN 'UP' WHEN (p1 * 0.6e0) * 0.7e0 + (p1 * -0.2e0 + p2 * 0.9e0) * 0.3e0 < -0.0005 THEN 'DOWN' ELSE 'FLAT' END AS direction FROM s")
def i_batch_scoring(t):
    members = {"a": {"p1": 0.6}, "b": {"p1": -0.2, "p2": 0.9}, "unused": {"not_there": 1.0}}
    return rs.score_batch(scored(t), members, {"a": 0.7, "b": 0.3, "unused": 0.0}, deadband=5e-4)


@query(f"""{S}, d AS (SELECT (month >= 36)::INT AS pool, ln(regime) AS v FROM s), m AS (SELECT pool, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM d GROUP BY pool)
SELECT m.pool, m.n, {cols({'static': '(m.mean - f.mean) / f.std', 'spread': 'm.std / f.std'})} FROM m, m f WHERE f.pool = 0""")
def i_descriptor_pools(t):
    return rs.pool_descriptors(scored(t), (F.col("month") >= 36).cast("int"), F.col("regime"))


@query(f"{sql_views('scored')} SELECT count(*)::BIGINT AS n, (count(*) - count(DISTINCT sample_id))::BIGINT AS repeated, count(*) FILTER (WHERE y IS NULL)::BIGINT AS no_target, count(*) FILTER (WHERE isinf(y))::BIGINT AS infinite, count(*) FILTER (WHERE NOT month BETWEEN 0 AND 70)::BIGINT AS bad_month FROM scored")
def j_table_checks(t):
    return rs.table_checks(t("scored"), "sample_id", "y", 70)


@query(f"{S} SELECT sample_id, month, {r('y')} AS y FROM s WHERE sample_id % 3 = 0")
def k_every_third_id(t):
    return scored(t).where("sample_id % 3 = 0").select("sample_id", "month", "y")
