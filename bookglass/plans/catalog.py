"""The registered queries of the library, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookglass.functions.exprs import AGE, corr_safe, quantile, safe_div, tidy
from bookglass.operators import evaluation as ev
from bookglass.operators import features as ft
from bookglass.operators import models, series
from bookglass.operators.linear import group_quantiles
from bookglass.plans import audits, comparisons, research, selection
from bookglass.plans.sql import ORACLE
from bookglass.sources.adapters import view

WIDE = ["mkt_quantity", "mkt_price", "ord_discount", "ord_tax", "txn_quantity_copy", "txn_discount_neg", "txn_unit_price", "txn_constant"]
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    _queries[f.__name__] = lambda spark, sf_dir: tidy(f(lambda name: view(spark, sf_dir, name)))
    return f


def in_months(t) -> DataFrame:
    return t("scored").where(F.col("month").between(0, 70))


@query
def d_market_features(t):
    return ft.market_features(t("market"))


@query
def d_order_features(t):
    return ft.order_features(t("order_flow"))


@query
def d_trade_features(t):
    return ft.trade_features(t("trade"))


@query
def e_shape_features(t):
    return ft.shape_features(t("market"))


@query
def b_book_columns(t):
    return ft.book(t("market")).select("row_id", "sample_id", "is_empty_bid", "is_empty_ask", "mid", "microprice", "total_depth", *[c for c in ft.SNAPSHOT if c not in ("mid", "microprice", "total_depth")])


@query
def c_feature_assembly(t):
    return ft.assemble(ft.market_features(t("market")), ft.order_features(t("order_flow")), ft.trade_features(t("trade")))


@query
def c_column_groups_rejoined(t):
    m = t("market")
    a, b, c = m.select("row_id", "sample_id", AGE, "transaction_volume"), m.select("row_id", "ask_price_1", "bid_price_1"), m.select("row_id", "ask_price_2", "bid_price_2")
    return a.join(b, "row_id").join(c, "row_id").groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("transaction_volume").cast("long").alias("volume"), F.avg(F.col("ask_price_2") - F.col("bid_price_1")).alias("gap"))


@query
def c_alignment_proof(t):
    m, o = t("market"), t("order_flow")
    j = m.select("row_id", "sample_id", (F.col(AGE) / 10).alias("a")).join(o.select("row_id", F.col("sample_id").alias("other"), F.col(AGE).alias("b")), "row_id")
    return j.agg(F.count("*").alias("joined"), F.count_if(F.col("sample_id") != F.col("other")).alias("key_mismatches"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("clock_mismatches"))


@query
def c_asof_join(t):
    q = ft.book(t("market").withColumn(AGE, F.col(AGE) / 10))
    return ft.as_of(t("trade"), q).select("sample_id", "row_id", "price", "side", "prevailing_mid")


@query
def d_aggressor_table(t):
    j = ft.as_of(t("trade"), ft.book(t("market").withColumn(AGE, F.col(AGE) / 10)))
    m = F.col("prevailing_mid")
    return j.where(m.isNotNull()).groupBy("side").agg(F.count("*").alias("n"), F.avg((F.col("price") > m).cast("double")).alias("above"), F.avg((F.col("price") < m).cast("double")).alias("below"), F.avg((F.col("price") - m) / m * 1e4).alias("bps"))


@query
def d_window_coverage(t):
    parts = [t(n).select(F.lit(n).alias("source"), "sample_id", AGE) for n in ("market", "order_flow", "trade")]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source", "sample_id").agg(F.max(AGE).alias("span"), F.count("*").alias("n"))
    middles = group_quantiles(one, ["source"], "span", {"median_span": 0.5})
    return middles.join(one.groupBy("source").agg(F.max("span").alias("max_span"), F.count_if(F.col("span") > 60).alias("beyond_60s"), F.avg("n").alias("rows_per_sample")), "source")


@query
def d_sentinel_census(t):
    m = t("market")
    return m.agg(F.count("*").alias("n"), *(F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in ("ask_price_1", "bid_price_1")), *(F.min(F.when(F.col(c) > 0, F.col(c))).alias(f"least_{c}") for c in ("ask_price_1", "bid_price_1")), F.count_if((F.col("ask_price_1") > 0) & (F.col("bid_price_1") >= F.col("ask_price_1"))).alias("crossed"))


@query
def d_spread_naive_vs_clean(t):
    m = ft.book(t("market"))
    naive = safe_div(F.col("ask_price_1") - F.col("bid_price_1"), (F.col("ask_price_1") + F.col("bid_price_1")) / 2)
    return m.agg(F.avg(naive).alias("naive"), F.avg("rel_spread").alias("clean"))


@query
def d_row_cap_census(t):
    return t("order_flow").groupBy("sample_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count_if(F.col("n") >= 70).alias("near_cap"), F.count_if(F.col("n") > 999).alias("above_cap"))


@query
def d_rows_per_sample_histogram(t):
    return t("order_flow").groupBy("sample_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("samples"))


@query
def d_encoding_table(t):
    return t("order_flow").groupBy("order_action", "side").agg(F.count("*").alias("n"), F.avg("price").alias("price"), F.avg("volume").alias("volume"))


@query
def d_target_by_month(t):
    return in_months(t).groupBy("month").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev("y").alias("std"))


@query
def d_target_summary(t):
    s = in_months(t)
    one = s.agg(F.min("y").alias("least"), F.max("y").alias("most"), F.avg((F.col("y") == 0).cast("double")).alias("zero_share"))
    return one.crossJoin(F.broadcast(ev.exact_quantiles(s, "y", {"q1": 0.25, "q2": 0.5, "q3": 0.75})))


@query
def d_histogram(t):
    s = in_months(t).select("regime")
    e = s.agg(F.min("regime").alias("lo"), F.max("regime").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 20
    return s.crossJoin(F.broadcast(e)).withColumn("bin", F.least(F.lit(19), F.floor((F.col("regime") - F.col("lo")) / width)).cast("long")).groupBy("bin").agg(F.count("*").alias("n"))


@query
def e_forward_fill(t):
    return ft.filled_mid(ft.book(t("market"))).select("row_id", "filled")


@query
def e_sequence_steps(t):
    return ev.sequence_steps(ft.book(t("market")), 60)


@query
def e_block_autocorrelation(t):
    return series.block_autocorrelations(in_months(t), "regime")


@query
def f_fold_rows(t):
    return ev.checked_folds(in_months(t)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"))


@query
def f_fold_leakage(t):
    return ev.fold_faults(in_months(t))


@query
def f_hashed_split(t):
    return in_months(t).select("sample_id", (F.substring(F.md5(F.col("sample_id").cast("string")), 1, 1) < "3").alias("held_out"))


@query
def g_metrics_per_month(t):
    return ev.metrics(in_months(t), ["month"])


@query
def g_fold_scores(t):
    return ev.metrics(ev.fold_rows(in_months(t)).where("role = 'val'"), ["fold"])


@query
def g_model_comparison(t):
    v = ev.fold_rows(in_months(t)).where("role = 'val'")
    s = [ev.metrics(v, ["fold"], p=p).select("fold", "cosine", F.lit(p).alias("model")) for p in ("p1", "p2")]
    return ev.stability(s[0].unionByName(s[1]), by=["model"])


@query
def g_input_faults(t):
    return ev.input_faults(in_months(t))


@query
def g_cosine_decomposition(t):
    return ev.decomposition(in_months(t), "grp")


@query
def g_quartile_cosine(t):
    return ev.decomposition(ev.quartiles(in_months(t), "regime"), "quartile")


@query
def g_period_difficulty(t):
    b = in_months(t).withColumn("block", F.floor((F.col("month") - 36) / 3)).where("month >= 36").groupBy("block").agg(ev.cosine(F.col("y"), F.col("p1")).alias("cosine"))
    h = in_months(t).where("month >= 65").agg(ev.cosine(F.col("y"), F.col("p1")).alias("holdout"))
    return b.crossJoin(F.broadcast(h)).agg(quantile("cosine", 0.5).alias("median"), F.max("holdout").alias("holdout"), F.avg((F.col("cosine") < F.col("holdout")).cast("double")).alias("percentile"))


@query
def g_trend_slope(t):
    m = in_months(t).groupBy("month").agg(F.avg("y").alias("v"))
    return m.agg(F.regr_slope("v", "month").alias("slope"), F.regr_intercept("v", "month").alias("start"), F.count("*").alias("n"))


@query
def g_paired_verdict(t):
    m = in_months(t).groupBy("month").agg(ev.cosine(F.col("y"), F.col("p1")).alias("a"), ev.cosine(F.col("y"), F.col("p2")).alias("b"))
    g = F.col("a") - F.col("b")
    return m.agg(F.avg(g).alias("gain"), (F.stddev(g) / F.sqrt(F.count("*"))).alias("se"), F.count_if(g > 0).alias("improved"), F.count("*").alias("n"))


@query
def g_drift(t):
    return ev.drift(t("wide"), WIDE)


@query
def g_drift_summary(t):
    return ev.drift_summary(ev.drift(t("wide"), WIDE))


@query
def g_drift_by_family(t):
    d = ev.drift(t("wide"), WIDE).withColumn("family", F.substring_index("feature", "_", 1))
    return d.groupBy("family").agg(F.count("*").alias("n"), F.max("shift").alias("most"), F.avg("shift").alias("mean"))


@query
def g_correlation_pairs(t):
    return ev.correlation_pairs(t("wide"), WIDE)


@query
def g_duplicate_groups(t):
    return ev.duplicate_groups(ev.correlation_pairs(t("wide"), WIDE), WIDE)


@query
def g_block_bootstrap(t):
    return ev.block_bootstrap(in_months(t))


@query
def g_adversarial_auc(t):
    return research.rs.auc(t("wide").withColumn("one", F.lit(1)), "mkt_price", F.col("split") == "test", ["one"]).select("auc", "positives")


@query
def h_ranked_signals(t):
    return ev.ranked_signals(in_months(t)).select("sample_id", F.col("rank").cast("long").alias("rank"), "signal")


@query
def h_backtest_costs(t):
    return ev.backtest(in_months(t))


@query
def i_median_impute(t):
    return models.median_impute(t("wide"), ["txn_unit_price"], F.col("split") == "train").groupBy("split").agg(F.avg("txn_unit_price").alias("mean"), F.count("txn_unit_price").alias("n"))


@query
def i_standardise(t):
    s = models.standardise(t("wide"), ["mkt_price", "txn_constant"], F.col("split") == "train")
    return s.groupBy("split").agg(F.avg("mkt_price").alias("mean"), F.stddev_pop("mkt_price").alias("std"), F.max("txn_constant").alias("constant"))


@query
def i_blend_weights(t):
    return models.blend_weights(in_months(t), ["p1", "p2"])


@query
def i_ridge(t):
    s = in_months(t)
    out = models.ridge(s.where("month < 53"), s.where("month >= 55"), ["p1", "p2"])
    return ev.metrics(out, ["month"], p="prediction")


@query
def i_boosted(t):
    s = in_months(t)
    out = models.boosted(s.where("month < 60"), s.where("month >= 62"), ["p1", "p2"], rounds=5)
    return ev.metrics(out, ["month"], p="prediction")


@query
def i_regimes(t):
    m = ft.book(t("market")).groupBy("sample_id").agg(F.log(F.avg("total_depth")).alias("depth"), F.coalesce(F.avg("spread"), F.lit(0.0)).alias("spread"))
    return models.regimes(m, ["depth", "spread"]).groupBy("regime").agg(F.count("*").alias("n"), F.avg("depth").alias("depth"), F.avg("spread").alias("spread"))


@query
def j_contract_faults(t):
    c = F.col
    return ev.contract_faults(t("order_flow"), {"side": c("side").isin(0, 1), "order_action": c("order_action").isin(0, 1), "price": c("price").between(0, 2), "volume": c("volume") >= 500, AGE: c(AGE).between(0, 60.001)})


@query
def j_staging_summary(t):
    return ev.table_summary(t("market"))


@query
def j_clock_order(t):
    w = Window.partitionBy("sample_id").orderBy("row_id")
    return t("trade").withColumn("before", F.lag(AGE).over(w)).groupBy("sample_id").agg(F.count_if(F.col(AGE) > F.col("before") + 1e-6).alias("rising"))


@query
def k_month_quota(t):
    return ev.month_sample(in_months(t), 5).select("month", "sample_id", "y")


@query
def k_top_features(t):
    return ev.drift(t("wide"), WIDE).orderBy(F.desc_nulls_last("shift"), "feature").limit(3).select("feature", "shift")


@query
def k_missing_keys(t):
    return t("market").select("sample_id").distinct().join(t("trade").select("sample_id").distinct(), "sample_id", "left_anti")


@query
def b_prediction_reshaping(t):
    s = in_months(t)
    means = s.groupBy("month").agg(F.avg("p1").alias("mean"))  # a row per month
    placed = ev.month_places(s, "p1").join(F.broadcast(means), "month")
    return placed.select("sample_id", (F.col("p1") - F.col("mean")).alias("centred"), (F.signum("p1") * F.sqrt(F.abs("p1"))).alias("power"), "place")


@query
def b_row_weights(t):
    w = in_months(t).select("sample_id", F.sqrt(F.abs("y")).alias("w"))
    low = ev.exact_quantiles(w.where("w > 0"), "w", {"low": 0.01})
    g = w.crossJoin(F.broadcast(low)).select("sample_id", F.greatest("w", "low").alias("w"))
    mean = g.agg(F.avg("w").alias("mean"))
    return g.crossJoin(F.broadcast(mean)).select("sample_id", (F.col("w") / F.col("mean")).alias("weight"))


@query
def f_training_windows(t):
    return ev.window_rows(in_months(t)).groupBy("kind", "val_start").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"), F.avg("y").alias("mean"))


@query
def h_fraction_sweep(t):
    return ev.fraction_sweep(in_months(t))


@query
def k_month_fraction(t):
    return ev.month_fraction(in_months(t), 0.1).groupBy("month").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"))


for _f in (comparisons.QUERIES | research.QUERIES | audits.QUERIES | selection.QUERIES).values():
    query(_f)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (ORACLE | comparisons.ORACLE | research.ORACLE | audits.ORACLE | selection.ORACLE).items() if k in _queries}
