"""DuckDB SQL of the registered queries, over the same views. Floats lose their last bits on both sides (see ``tidy``)."""

from __future__ import annotations

from bookglass.functions.exprs import EVENT_WINDOWS, GRID, MARKET_WINDOWS, SPLIT, label
from bookglass.operators.evaluation import COSTS_BPS, FOLDS, FRACTIONS
from bookglass.sources.adapters import sql_views

CLOCK = "seconds_before_predict"
BOOK = """book AS (SELECT *, (ap1 + bp1) / 2 AS mid, ap1 - bp1 AS spread, (ap1 - bp1) / ((ap1 + bp1) / 2) AS rel_spread,
  (ap1 * bv1 + bp1 * av1) / nullif(bv1 + av1, 0) AS microprice,
  CASE WHEN ap1 IS NOT NULL AND bp1 IS NOT NULL THEN (bv1 - av1) / nullif(bv1 + av1, 0) END AS depth_imb_1,
  CASE WHEN ap1 IS NOT NULL AND bp1 IS NOT NULL THEN (bv1 + bv2 - av1 - av2) / nullif(bv1 + bv2 + av1 + av2, 0) END AS depth_imb_12,
  bv1 + bv2 + av1 + av2 AS total_depth, ap2 - ap1 AS ask_slope, bp1 - bp2 AS bid_slope
  FROM (SELECT *, nullif(ask_price_1, 0) AS ap1, nullif(bid_price_1, 0) AS bp1, nullif(ask_price_2, 0) AS ap2, nullif(bid_price_2, 0) AS bp2,
    ask_volume_1::DOUBLE AS av1, bid_volume_1::DOUBLE AS bv1, ask_volume_2::DOUBLE AS av2, bid_volume_2::DOUBLE AS bv2,
    (bid_price_1 = 0)::INT AS is_empty_bid, (ask_price_1 = 0)::INT AS is_empty_ask FROM market))"""
MONTHS = "s AS (SELECT * FROM scored WHERE month BETWEEN 0 AND 70)"
WIDE = ["mkt_quantity", "mkt_price", "ord_discount", "ord_tax", "txn_quantity_copy", "txn_discount_neg", "txn_unit_price", "txn_constant"]


def r(e: str) -> str:
    x = f"((({e}) + {GRID}) - {GRID})"
    return f"({x} * {SPLIT} - ({x} * {SPLIT} - {x})) + 0e0"


def cols(pairs: dict[str, str], counts: tuple[str, ...] = ()) -> str:
    return ",\n  ".join(f"{e if n in counts else r(e)} AS {n}" for n, e in pairs.items())


def div(a: str, b: str) -> str:
    return f"({a}) / nullif(({b})::DOUBLE, 0)"


def cos(y: str, p: str) -> str:
    return f"coalesce(sum({y} * {p}) / nullif(sqrt(sum({y} * {y})) * sqrt(sum({p} * {p})), 0), 0)"


def corr(x: str, y: str) -> str:
    both = f"FILTER (WHERE ({x}) IS NOT NULL AND ({y}) IS NOT NULL)"
    return f"covar_pop({x}, {y}) / nullif(sqrt(var_pop({x}) {both} * var_pop({y}) {both}), 0)"


#: Of rows (traded, pnl, fall), what a backtest tells.
MEASURES = {
    "trades": "count(*) FILTER (WHERE traded)", "turnover": "count(*) FILTER (WHERE traded) / (SELECT count(*) FROM s)", "total": "coalesce(sum(pnl) FILTER (WHERE traded), 0)",
    "mean": "coalesce(avg(pnl) FILTER (WHERE traded), 0)", "volatility": "coalesce(stddev_samp(pnl) FILTER (WHERE traded), 0)",
    "sharpe": "coalesce(avg(pnl) FILTER (WHERE traded) / nullif(stddev_samp(pnl) FILTER (WHERE traded), 0), 0)", "win_rate": "coalesce(avg((pnl > 0)::INT) FILTER (WHERE traded), 0)", "max_drawdown": "min(fall)",
}


def curve(by: str, cost: str, limit: str, values: list[float]) -> str:
    """d: per value of ``by`` every row of s in order, those that don't trade too, with its equity and its fall from the highest so far."""
    return f"""k AS (SELECT *, CASE WHEN p1 <> 0 THEN row_number() OVER (PARTITION BY p1 <> 0 ORDER BY abs(p1) DESC, sample_id) END AS place FROM s), g({by}) AS (VALUES {", ".join(f"({v}::DOUBLE)" for v in values)}),
t AS (SELECT g.{by}, month, sample_id, coalesce(place <= {limit}, false) AS traded, CASE WHEN place <= {limit} THEN sign(p1) * y - {cost} ELSE 0e0 END AS pnl FROM k, g),
e AS (SELECT *, sum(pnl) OVER (PARTITION BY {by} ORDER BY month, sample_id ROWS UNBOUNDED PRECEDING) AS equity FROM t),
d AS (SELECT *, max(equity) OVER (PARTITION BY {by} ORDER BY month, sample_id ROWS UNBOUNDED PRECEDING) AS peak, equity - max(equity) OVER (PARTITION BY {by} ORDER BY month, sample_id ROWS UNBOUNDED PRECEDING) AS fall FROM e)"""


def blocks_sql(sizes: tuple[int, ...]) -> str:
    """e: (block, n_blocks, r) of k (v, pos) per size."""
    return f"""z AS (SELECT unnest({list(sizes)}) AS block), m AS (SELECT block, pos // block AS spot, avg(v) AS x FROM k, z GROUP BY block, pos // block HAVING count(v) > 0),
b AS (SELECT *, lag(x) OVER (PARTITION BY block ORDER BY spot) AS before FROM m), e AS (SELECT block, count(*) AS n_blocks, CASE WHEN count(*) >= 3 THEN {corr("x", "before")} END AS r FROM b GROUP BY block)"""


def market() -> str:
    c: dict[str, str] = {}
    for w in MARKET_WINDOWS:
        t, f = label(w), f"FILTER (WHERE {CLOCK} <= {w})"
        for n, x in {"mid_mean": "mid", "spread_mean": "spread", "rel_spread_mean": "rel_spread", "depth_imb1_mean": "depth_imb_1", "depth_imb12_mean": "depth_imb_12", "micro_minus_mid": "microprice - mid", "ask_slope": "ask_slope", "bid_slope": "bid_slope", "total_depth_mean": "total_depth", "trade_aggression": "(transaction_avgprice - mid) / nullif(spread, 0)"}.items():
            c[f"mkt_{n}_{t}"] = f"avg({x}) {f}"
        c |= {f"mkt_mid_std_{t}": f"stddev_samp(mid) {f}", f"mkt_depth_imb1_std_{t}": f"stddev_samp(depth_imb_1) {f}", f"mkt_mid_range_{t}": f"max(mid) {f} - min(mid) {f}", f"mkt_trade_volume_rate_{t}": f"coalesce(sum(transaction_volume) {f}, 0) / {w}.0::DOUBLE", f"mkt_trade_count_rate_{t}": f"coalesce(sum(transaction_count) {f}, 0) / {w}.0::DOUBLE", f"mkt_snapshot_rate_{t}": f"count(*) {f} / {w}.0::DOUBLE", f"mkt_mid_start_{t}": f"arg_max(mid, ROW({CLOCK}, row_id)) FILTER (WHERE {CLOCK} <= {w} AND mid IS NOT NULL)"}
    c |= {"mkt_empty_bid_share": "avg(is_empty_bid)", "mkt_empty_ask_share": "avg(is_empty_ask)", "mkt_null_mid_share": "avg((mid IS NULL)::INT)", "mkt_spread_mean_clean": "avg(spread)", "mkt_spread_min": "min(spread)", "mkt_last_seconds_gap": f"min({CLOCK})", "mkt_n_snapshots": "count(*)"}
    last = {"mid": "mid", "spread": "spread", "rel_spread": "rel_spread", "microprice": "microprice", "depth_imb1": "depth_imb_1", "depth_imb12": "depth_imb_12", "total_depth": "total_depth", "ask_slope": "ask_slope", "bid_slope": "bid_slope"}
    lasts = {f"mkt_{n}_last": f"l.{x}" for n, x in last.items()} | {"mkt_last_valid_gap": f"l.{CLOCK}"}
    more = {f"mkt_mid_return_{label(w)}": div("l.mid", f"mkt_mid_start_{label(w)}") + " - 1" for w in MARKET_WINDOWS}
    more |= {"mkt_micro_minus_mid_last": "l.microprice - l.mid", "mkt_micro_edge_norm_last": div("l.microprice - l.mid", "l.spread"), "mkt_spread_last_vs_mean": div("l.spread", "mkt_spread_mean_600s"), "mkt_depth_last_vs_mean": div("l.total_depth", "mkt_total_depth_mean_600s")}
    for w in MARKET_WINDOWS[:-1]:
        more |= {f"mkt_snapshot_accel_{label(w)}_vs_600s": div(f"mkt_snapshot_rate_{label(w)}", "mkt_snapshot_rate_600s"), f"mkt_depth_imb1_delta_{label(w)}_vs_600s": f"mkt_depth_imb1_mean_{label(w)} - mkt_depth_imb1_mean_600s"}
    inner = ", ".join(f"{e} AS {n}" for n, e in c.items())
    return f"""{sql_views("market")}, {BOOK},
a AS (SELECT sample_id, {inner} FROM book GROUP BY sample_id),
l AS (SELECT * FROM book WHERE mid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY {CLOCK}, row_id) = 1)
SELECT a.sample_id, {cols({n: n for n in c} | lasts | more, ("mkt_n_snapshots",))} FROM a LEFT JOIN l ON a.sample_id = l.sample_id"""


def orders() -> str:
    c: dict[str, str] = {}
    kinds = {"nb": (0, 0), "na": (1, 0), "cb": (0, 1), "ca": (1, 1)}
    inner: list[str] = []
    for w in EVENT_WINDOWS:
        t = label(w)
        for k, (side, action) in kinds.items():
            f = f"FILTER (WHERE {CLOCK} <= {w} AND side = {side} AND order_action = {action})"
            inner += [f"count(*) {f} AS {k}_{t}", f"coalesce(sum(volume) {f}, 0)::DOUBLE AS v{k}_{t}"]
        inner += [f"coalesce(sum(price * volume) FILTER (WHERE {CLOCK} <= {w} AND side = {s}), 0) AS pv{n}_{t}" for n, s in (("b", 0), ("a", 1))]
        new, gone, vn, vg = f"nb_{t} + na_{t}", f"cb_{t} + ca_{t}", f"vnb_{t} + vna_{t}", f"vcb_{t} + vca_{t}"
        im = lambda a, b, t=t: div(f"{a}_{t} - {b}_{t}", f"{a}_{t} + {b}_{t}")
        c |= {f"ord_new_rate_{t}": f"({new}) / {w}.0::DOUBLE", f"ord_cancel_rate_{t}": f"({gone}) / {w}.0::DOUBLE", f"ord_cancel_new_ratio_{t}": div(gone, new), f"ord_ofi_{t}": div(f"vnb_{t} - vcb_{t} - vna_{t} + vca_{t}", f"{vn} + {vg}"), f"ord_new_count_imbalance_{t}": im("nb", "na"), f"ord_new_volume_imbalance_{t}": im("vnb", "vna"), f"ord_cancel_count_imbalance_{t}": im("cb", "ca"), f"ord_cancel_volume_imbalance_{t}": im("vcb", "vca"), f"ord_avg_new_size_{t}": div(vn, new), f"ord_avg_cancel_size_{t}": div(vg, gone), f"ord_event_rate_{t}": f"({new} + {gone}) / {w}.0::DOUBLE", f"ord_bid_vwap_{t}": div(f"pvb_{t}", f"vnb_{t} + vcb_{t}"), f"ord_ask_vwap_{t}": div(f"pva_{t}", f"vna_{t} + vca_{t}")}
    for tag, rate in (("0p1", 0.1), ("0p5", 0.5)):
        inner += [f"coalesce(sum(volume * exp(-{rate}::DOUBLE * {CLOCK})) FILTER (WHERE side = {s} AND order_action = 0), 0) AS d{n}_{tag}" for n, s in (("b", 0), ("a", 1))]
        c[f"ord_decay_imbalance_lam{tag}"] = div(f"db_{tag} - da_{tag}", f"db_{tag} + da_{tag}")
    inner += ["count(*) AS ord_n_total", f"min({CLOCK}) AS ord_last_seconds_gap", f"max({CLOCK}) AS ord_window_covered", "avg((order_action = 1)::INT) AS ord_cancel_share_total", "stddev_samp(volume) AS ord_volume_std", "max(volume) / avg(volume) AS ord_max_to_avg_size"]
    c |= {n: n for n in ("ord_n_total", "ord_last_seconds_gap", "ord_window_covered", "ord_cancel_share_total", "ord_volume_std", "ord_max_to_avg_size")}
    final = {n: n for n in c} | {f"ord_event_accel_{label(w)}_vs_60s": div(f"ord_event_rate_{label(w)}", "ord_event_rate_60s") for w in EVENT_WINDOWS[:-1]} | {f"ord_ofi_delta_{label(w)}_vs_60s": f"ord_ofi_{label(w)} - ord_ofi_60s" for w in EVENT_WINDOWS[:-1]}
    return f"""{sql_views("order_flow")}, a AS (SELECT sample_id, {", ".join(inner)} FROM order_flow GROUP BY sample_id),
b AS (SELECT sample_id, {", ".join(f"{e} AS {n}" for n, e in c.items())} FROM a)
SELECT sample_id, {cols(final, ("ord_n_total",))} FROM b"""


def trades() -> str:
    c: dict[str, str] = {}
    for w in EVENT_WINDOWS:
        t = label(w)
        f = lambda more="", w=w: f"FILTER (WHERE {CLOCK} <= {w}{more})"
        v = lambda more="", f=f: f"coalesce(sum(volume) {f(more)}, 0)::DOUBLE"
        n = lambda more="", f=f: f"count(*) {f(more)}"
        buy, sell = " AND side = 0", " AND side = 1"
        c |= {f"txn_intensity_{t}": f"{n()} / {w}.0::DOUBLE", f"txn_volume_rate_{t}": f"{v()} / {w}", f"txn_volume_imbalance_{t}": div(f"{v(buy)} - {v(sell)}", f"{v(buy)} + {v(sell)}"), f"txn_count_imbalance_{t}": div(f"{n(buy)} - {n(sell)}", f"{n(buy)} + {n(sell)}"), f"txn_vwap_{t}": div(f"coalesce(sum(price * volume) {f()}, 0)", v()), f"txn_avg_size_{t}": div(v(), n()), f"txn_price_std_{t}": f"stddev_samp(price) {f()}", f"txn_price_range_{t}": f"max(price) {f()} - min(price) {f()}"}
    age = f"ROW({CLOCK}, row_id)"
    c |= {"txn_last_price": f"arg_min(price, {age})", "txn_first_price": f"arg_max(price, {age})", "txn_last_seconds_gap": f"min({CLOCK})", "txn_n_total": "count(*)", "txn_window_covered": f"max({CLOCK})", "txn_vwap_total": div("sum(price * volume)", "sum(volume)"), "txn_large_volume_share": div("coalesce(sum(volume) FILTER (WHERE volume >= 10000), 0)", "sum(volume)"), "txn_window_return": f"arg_min(price, {age}) / nullif(arg_max(price, {age}), 0) - 1"}
    final = {n: n for n in c} | {f"txn_intensity_accel_{label(w)}_vs_60s": div(f"txn_intensity_{label(w)}", "txn_intensity_60s") for w in EVENT_WINDOWS[:-1]}
    return f"""{sql_views("trade")}, a AS (SELECT sample_id, {", ".join(f"{e} AS {n}" for n, e in c.items())} FROM trade GROUP BY sample_id)
SELECT sample_id, {cols(final, ("txn_n_total",))} FROM a"""


def shape() -> str:
    path = "sum(abs(dmid))"
    end = "max(mid) FILTER (WHERE rn = n)"
    drift = lambda x: f"avg({x}) FILTER (WHERE rn > n / 2) - avg({x}) FILTER (WHERE rn <= n / 2)"
    c = {"shp_mid_path_efficiency": div("abs(sum(dmid))", path), "shp_mid_range_over_path": div("max(mid) - min(mid)", path), "shp_mid_autocorr1": corr("dmid", "before"), "shp_sign_persistence": "avg((sign(dmid) = sign(before) AND dmid <> 0)::INT) FILTER (WHERE dmid IS NOT NULL AND before IS NOT NULL)", "shp_rv_signature_ratio": div("sqrt(sum(dmid * dmid))", "sqrt(sum(dmid4 * dmid4))")}
    c |= {f"shp_{n}_slope": div(f"covar_pop({x}, t)", "var_pop(t)") for n, x in (("imb", "depth_imb_1"), ("spread", "spread"), ("depth", "total_depth"), ("mid", "mid"))}
    c |= {"shp_imb_trend_corr": corr("depth_imb_1", "t")} | {f"shp_{n}_drift": drift(x) for n, x in (("imb", "depth_imb_1"), ("spread", "spread"), ("depth", "total_depth"))}
    c |= {"shp_mid_runup_rel": div(f"max(mid) - {end}", end), "shp_mid_drawdown_rel": div(f"{end} - min(mid)", end), "shp_gap_cv": div("stddev_pop(dt)", "abs(avg(dt))"), "shp_max_gap": "max(abs(dt))", "shp_n_snaps": "count(*)"}
    return f"""{sql_views("market")}, {BOOK},
p AS (SELECT *, -{CLOCK} AS t, mid - lag(mid) OVER w AS dmid, {CLOCK} - lag({CLOCK}) OVER w AS dt, row_number() OVER w AS rn, count(*) OVER (PARTITION BY sample_id) AS n
  FROM book WINDOW w AS (PARTITION BY sample_id ORDER BY {CLOCK} DESC, row_id)),
q AS (SELECT *, lag(dmid) OVER w AS before, CASE WHEN rn % 4 = 0 THEN mid - lag(mid, 4) OVER w END AS dmid4
  FROM p WINDOW w AS (PARTITION BY sample_id ORDER BY {CLOCK} DESC, row_id))
SELECT sample_id, {cols(c, ("shp_n_snaps",))} FROM q GROUP BY sample_id"""


FOLD_ROWS = "f(fold, role, lo, hi) AS (VALUES " + ", ".join(f"({f}, 'train', {a}, {b}), ({f}, 'val', {c}, {d})" for f, a, b, c, d in FOLDS) + "), fr AS (SELECT s.*, f.fold, f.role FROM s JOIN f ON s.month BETWEEN f.lo AND f.hi)"
ASOF = f"""q AS (SELECT sample_id, {CLOCK} / 10 AS clock, row_id, 0 AS kind, mid, NULL AS price, NULL AS side FROM book
  UNION ALL SELECT sample_id, {CLOCK}, row_id, 1, NULL, price, side FROM trade),
j AS (SELECT *, last_value(mid IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY clock DESC, kind, row_id ROWS UNBOUNDED PRECEDING) AS prevailing_mid FROM q)"""


def metric_cols(y: str = "y", p: str = "p1") -> str:
    return cols({"cosine": cos(y, p), "mae": f"avg(abs({y} - {p}))", "rmse": f"sqrt(avg(({y} - {p}) * ({y} - {p})))", "pearson": f"coalesce({corr(y, p)}, 0)", "direction": f"coalesce(avg((sign({y}) = sign({p}))::INT) FILTER (WHERE {y} <> 0), 0)", "n": "count(*)"}, ("n",))


def decomposition(source: str, group: str) -> str:
    return f"""g AS (SELECT {group}, sum(y * p1) AS yp, sum(y * y) AS yy, sum(p1 * p1) AS pp, count(*) AS n FROM {source} GROUP BY {group})
SELECT {group}, n, {cols({"cosine": "coalesce(yp / nullif(sqrt(yy) * sqrt(pp), 0), 0)", "weight": "sqrt(yy) * sqrt(pp) / (sqrt(sum(yy) OVER ()) * sqrt(sum(pp) OVER ()))", "count_weight": "n / sum(n) OVER ()", "contribution": "yp / (sqrt(sum(yy) OVER ()) * sqrt(sum(pp) OVER ()))"})} FROM g"""


DRIFT = f"""u AS ({" UNION ALL ".join(f"SELECT split, '{f}' AS feature, {f}::DOUBLE AS v FROM wide" for f in WIDE)}),
d AS (SELECT feature, avg(v) FILTER (WHERE split = 'train') AS m1, avg(v) FILTER (WHERE split = 'test') AS m2, stddev_samp(v) FILTER (WHERE split = 'train') AS s1, stddev_samp(v) FILTER (WHERE split = 'test') AS s2,
  avg((v IS NULL)::INT) FILTER (WHERE split = 'test') - avg((v IS NULL)::INT) FILTER (WHERE split = 'train') AS null_delta FROM u GROUP BY feature),
e AS (SELECT *, abs(m2 - m1) / nullif(s1, 0) AS shift, s2 / nullif(s1, 0) AS std_ratio FROM d)"""


def pairs() -> str:
    filled = ", ".join(f"coalesce({f}, 0)::DOUBLE AS {f}" for f in WIDE)
    each = [f"SELECT '{a}' AS a, '{b}' AS b, abs(coalesce({corr(a, b)}, 0)) AS r FROM z" for i, a in enumerate(WIDE) for b in WIDE[i + 1 :]]
    return f"{sql_views('wide')}, z AS (SELECT {filled} FROM wide), pr AS ({' UNION ALL '.join(each)})"


S = sql_views("scored") + ", " + MONTHS
ORACLE = {
    "d_market_features": market(),
    "d_order_features": orders(),
    "d_trade_features": trades(),
    "e_shape_features": shape(),
    "b_book_columns": f"{sql_views('market')}, {BOOK} SELECT row_id, sample_id, is_empty_bid, is_empty_ask, {cols({c: c for c in ('mid', 'microprice', 'total_depth', 'spread', 'rel_spread', 'depth_imb_1', 'depth_imb_12', 'ask_slope', 'bid_slope')})} FROM book",
    "c_feature_assembly": f"WITH m AS ({market()}), o AS ({orders()}), t AS ({trades()}) SELECT m.*, o.* EXCLUDE (sample_id), t.* EXCLUDE (sample_id) FROM m JOIN o ON m.sample_id = o.sample_id JOIN t ON m.sample_id = t.sample_id",
    "c_column_groups_rejoined": f"{sql_views('market')} SELECT sample_id, count(*) AS n, sum(transaction_volume)::BIGINT AS volume, {r('avg(ask_price_2 - bid_price_1)')} AS gap FROM market GROUP BY sample_id",
    "c_alignment_proof": f"{sql_views('market', 'order_flow')} SELECT count(*) AS joined, count(*) FILTER (WHERE m.sample_id <> o.sample_id) AS key_mismatches, count(*) FILTER (WHERE abs(m.{CLOCK} / 10 - o.{CLOCK}) > 1e-9) AS clock_mismatches FROM market m JOIN order_flow o ON m.row_id = o.row_id",
    "c_asof_join": f"{sql_views('market', 'trade')}, {BOOK}, {ASOF} SELECT sample_id, row_id, {r('price')} AS price, side, {r('prevailing_mid')} AS prevailing_mid FROM j WHERE kind = 1",
    "d_aggressor_table": f"{sql_views('market', 'trade')}, {BOOK}, {ASOF} SELECT side, count(*) AS n, {cols({'above': 'avg((price > prevailing_mid)::INT)', 'below': 'avg((price < prevailing_mid)::INT)', 'bps': 'avg((price - prevailing_mid) / prevailing_mid * 1e4::DOUBLE)'})} FROM j WHERE kind = 1 AND prevailing_mid IS NOT NULL GROUP BY side",
    "d_window_coverage": f"{sql_views('market', 'order_flow', 'trade')}, u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS source, sample_id, max({CLOCK}) AS span, count(*) AS n FROM {n} GROUP BY sample_id" for n in ("market", "order_flow", "trade")) + f") SELECT source, {r('quantile_cont(span, 0.5)')} AS median_span, {r('max(span)')} AS max_span, count(*) FILTER (WHERE span > 60) AS beyond_60s, {r('avg(n)')} AS rows_per_sample FROM u GROUP BY source",
    "d_sentinel_census": f"{sql_views('market')} SELECT count(*) AS n, count(*) FILTER (WHERE ask_price_1 = 0) AS zero_ask_price_1, count(*) FILTER (WHERE bid_price_1 = 0) AS zero_bid_price_1, {r('min(ask_price_1) FILTER (WHERE ask_price_1 > 0)')} AS least_ask_price_1, {r('min(bid_price_1) FILTER (WHERE bid_price_1 > 0)')} AS least_bid_price_1, count(*) FILTER (WHERE ask_price_1 > 0 AND bid_price_1 >= ask_price_1) AS crossed FROM market",
    "d_spread_naive_vs_clean": f"{sql_views('market')}, {BOOK} SELECT {cols({'naive': 'avg((ask_price_1 - bid_price_1) / nullif((ask_price_1 + bid_price_1) / 2, 0))', 'clean': 'avg(rel_spread)'})} FROM book",
    "d_row_cap_census": f"{sql_views('order_flow')}, c AS (SELECT count(*) AS n FROM order_flow GROUP BY sample_id) SELECT max(n) AS most, count(*) FILTER (WHERE n >= 70) AS near_cap, count(*) FILTER (WHERE n > 999) AS above_cap FROM c",
    "d_rows_per_sample_histogram": f"{sql_views('order_flow')}, c AS (SELECT count(*) AS n FROM order_flow GROUP BY sample_id) SELECT n, count(*) AS samples FROM c GROUP BY n",
    "d_encoding_table": f"{sql_views('order_flow')} SELECT order_action, side, count(*) AS n, {cols({'price': 'avg(price)', 'volume': 'avg(volume)'})} FROM order_flow GROUP BY order_action, side",
    "d_target_by_month": f"{S} SELECT month, count(*) AS n, {cols({'mean': 'avg(y)', 'std': 'stddev_samp(y)'})} FROM s GROUP BY month",
    "d_target_summary": f"{S} SELECT {cols({'least': 'min(y)', 'q1': 'quantile_cont(y, 0.25)', 'q2': 'quantile_cont(y, 0.5)', 'q3': 'quantile_cont(y, 0.75)', 'most': 'max(y)', 'zero_share': 'avg((y = 0)::INT)'})} FROM s",
    "d_histogram": f"{S}, e AS (SELECT min(regime) AS lo, max(regime) AS hi FROM s) SELECT least(19, floor((regime - lo) / ((hi - lo) / 20)))::BIGINT AS bin, count(*) AS n FROM s, e GROUP BY bin",
    "e_forward_fill": f"{sql_views('market')}, {BOOK} SELECT row_id, {r('coalesce(last_value(mid IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(mid IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)')} AS filled FROM book WINDOW w AS (PARTITION BY sample_id ORDER BY {CLOCK} DESC, row_id)",
    "e_sequence_steps": f"""{sql_views('market')}, {BOOK}, k AS (SELECT sample_id, mid, spread, row_number() OVER (PARTITION BY sample_id ORDER BY {CLOCK}, row_id) AS back, count(*) OVER (PARTITION BY sample_id) AS n FROM book),
i AS (SELECT DISTINCT sample_id, least(n, 60) AS n FROM k), g AS (SELECT sample_id, n, unnest(range(1, 61)) AS back FROM i)
SELECT g.sample_id, (60 - g.back)::INT AS step, {cols({'mid': 'k.mid', 'spread': 'k.spread'})}, (g.back <= g.n)::INT AS valid FROM g JOIN k ON g.sample_id = k.sample_id AND k.back = least(g.back, g.n)""",
    "e_block_autocorrelation": f"{S}, k AS (SELECT CASE WHEN regime > 0 THEN ln(regime) END AS v, row_number() OVER (ORDER BY month, sample_id) - 1 AS pos FROM s), {blocks_sql((10, 100, 1000, 10000))} SELECT block, n_blocks, {cols({'autocorr': 'r', 'noise_se': '1.0 / sqrt(n_blocks)', 'expected': 'NULL::DOUBLE'})} FROM e",
    "b_prediction_reshaping": f"{S} SELECT sample_id, {cols({'centred': 'p1 - avg(p1) OVER (PARTITION BY month)', 'power': 'sign(p1) * sqrt(abs(p1))', 'place': '(rank() OVER (PARTITION BY month ORDER BY p1)) + ((count(*) OVER (PARTITION BY month, p1)) - 1) / 2'})} FROM s",
    "b_row_weights": f"{S}, w AS (SELECT sample_id, sqrt(abs(y)) AS w FROM s), q AS (SELECT quantile_cont(w, 0.01) AS low FROM w WHERE w > 0), g AS (SELECT sample_id, greatest(w, low) AS w FROM w, q), h AS (SELECT sample_id, w / (SELECT avg(w) FROM g) AS w FROM g) SELECT sample_id, {r('w')} AS weight FROM h",
    "f_training_windows": f"{S}, t AS (SELECT * FROM (VALUES ('cumulative', 36, 0, 34), ('cumulative', 48, 0, 46), ('cumulative', 60, 0, 58), ('fixed', 36, 23, 34), ('fixed', 48, 35, 46), ('fixed', 60, 47, 58)) v(kind, val_start, lo, hi)) SELECT kind, val_start, count(*) AS n, min(month) AS first, max(month) AS last, {r('avg(y)')} AS mean FROM s JOIN t ON month BETWEEN lo AND hi GROUP BY kind, val_start",
    "h_fraction_sweep": f"{S}, {curve('fraction', '1e-4::DOUBLE', 'ceil(g.fraction * (SELECT count(*) FROM s))', FRACTIONS)}, q AS (" + " UNION ALL ".join(f"SELECT {f}::DOUBLE AS fraction, quantile_cont(abs(p1), {1.0 - f!r}) AS threshold FROM s" for f in FRACTIONS) + f") SELECT {r('d.fraction')} AS fraction, {r('max(q.threshold)')} AS threshold, {cols(MEASURES, ('trades',))} FROM d JOIN q ON q.fraction = d.fraction GROUP BY d.fraction",
    "k_month_fraction": f"{S}, k AS (SELECT month, sample_id, row_number() OVER (PARTITION BY month ORDER BY (sample_id * 7919) % 10007, sample_id) AS n, count(*) OVER (PARTITION BY month) AS total FROM s) SELECT month, count(*) AS n, sum(sample_id)::BIGINT AS ids FROM k WHERE n <= round(total * 0.1::DOUBLE) GROUP BY month",
    "f_hashed_split": f"{S} SELECT sample_id, substr(md5(sample_id::VARCHAR), 1, 1) < '3' AS held_out FROM s",
    "i_ridge": f"""{S}, m AS (SELECT avg(p1) AS m1, avg(p2) AS m2, avg(y) AS my, stddev_pop(p1) AS s1, stddev_pop(p2) AS s2, count(*)::DOUBLE AS n FROM s WHERE month < 53),
q AS (SELECT sum((p1 - m1) / s1 * ((p2 - m2) / s2)) AS c, sum((p1 - m1) / s1 * (y - my)) AS u, sum((p2 - m2) / s2 * (y - my)) AS v FROM s, m WHERE month < 53),
w AS (SELECT *, ((n + 10) * u - c * v) / ((n + 10) * (n + 10) - c * c) AS w1, ((n + 10) * v - c * u) / ((n + 10) * (n + 10) - c * c) AS w2 FROM m, q),
x AS (SELECT month, y, my + w1 * (p1 - m1) / s1 + w2 * (p2 - m2) / s2 AS prediction FROM s, w WHERE month >= 55)
SELECT month, {metric_cols('y', 'prediction')} FROM x GROUP BY month""",
    "g_block_bootstrap": f"""{S}, m AS (SELECT month, {cos('y', 'p1')} AS p1, {cos('y', 'p2')} AS p2 FROM s GROUP BY month), n AS (SELECT count(*) AS n, min(month) AS lo FROM m),
b AS (SELECT unnest([1, 2]) AS len), g AS (SELECT len, n, lo, (n + len - 1) // len AS many FROM b, n), st AS (SELECT len, n, lo, draw, unnest(range(many)) AS block FROM g, range(10000) d(draw)),
h AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '42', len::VARCHAR, draw::VARCHAR, block::VARCHAR)), 1, 12))::BIGINT % n AS start FROM st),
pl AS (SELECT len, draw, (start + step) % n + lo AS month FROM h, range(2) k(step) WHERE step < len AND block * len + step < n),
d AS (SELECT len, draw, avg(p1) AS a, avg(p2) AS b, avg(p2 - p1) AS c, avg(p1 - p1) AS z FROM pl JOIN m ON pl.month = m.month GROUP BY len, draw),
w AS (SELECT avg(p1) AS a, avg(p2) AS b, avg(p2 - p1) AS c, count(*) FILTER (WHERE p2 > p1) AS wins FROM m)
SELECT 'p1' AS model, len::BIGINT AS block_length, (SELECT n FROM n)::BIGINT AS periods, count(*) AS draws, {cols({'mean_cosine': 'any_value(w.a)', 'interval_low': 'quantile_cont(d.a, 0.025)', 'interval_high': 'quantile_cont(d.a, 0.975)', 'paired_delta': '0e0', 'delta_low': 'quantile_cont(d.z, 0.025)', 'delta_high': 'quantile_cont(d.z, 0.975)'})}, 0::BIGINT AS wins_vs_reference FROM d, w GROUP BY len
UNION ALL SELECT 'p2', len, (SELECT n FROM n), count(*), {cols({'mean_cosine': 'any_value(w.b)', 'interval_low': 'quantile_cont(d.b, 0.025)', 'interval_high': 'quantile_cont(d.b, 0.975)', 'paired_delta': 'any_value(w.c)', 'delta_low': 'quantile_cont(d.c, 0.025)', 'delta_high': 'quantile_cont(d.c, 0.975)'})}, any_value(w.wins) FROM d, w GROUP BY len""",
    "f_fold_rows": f"{S}, {FOLD_ROWS} SELECT fold, role, count(*) AS n, min(month) AS first, max(month) AS last FROM fr GROUP BY fold, role",
    "f_fold_leakage": f"{S}, {FOLD_ROWS}, a AS (SELECT fold, max(month) FILTER (WHERE role = 'train') AS last_train, min(month) FILTER (WHERE role = 'val') AS first_val, max(month) AS last_month FROM fr GROUP BY fold) SELECT *, first_val - last_train - 1 AS embargo, last_train >= first_val OR last_month >= 65 AS leaks FROM a",
    "g_metrics_per_month": f"{S} SELECT month, {metric_cols()} FROM s GROUP BY month",
    "g_fold_scores": f"{S}, {FOLD_ROWS} SELECT fold, {metric_cols()} FROM fr WHERE role = 'val' GROUP BY fold",
    "g_model_comparison": f"{S}, {FOLD_ROWS}, c AS (" + " UNION ALL ".join(f"SELECT '{p}' AS model, fold, {cos('y', p)} AS cosine FROM fr WHERE role = 'val' GROUP BY fold" for p in ("p1", "p2")) + f") SELECT model, {cols({'mean': 'avg(cosine)', 'std': 'coalesce(stddev_samp(cosine), 0)', 'lowest': 'min(cosine)', 'highest': 'max(cosine)'})}, arg_min(fold, cosine) AS worst_fold FROM c GROUP BY model",
    "g_input_faults": f"{S} SELECT count(*) AS n, count(*) FILTER (WHERE y IS NULL OR isnan(y) OR isinf(y)) AS bad_y, count(*) FILTER (WHERE p1 IS NULL OR isnan(p1) OR isinf(p1)) AS bad_p FROM s",
    "g_cosine_decomposition": f"{S}, {decomposition('s', 'grp')}",
    "g_quartile_cosine": f"{S}, e AS (SELECT quantile_cont(regime, 0.25) AS a, quantile_cont(regime, 0.5) AS b, quantile_cont(regime, 0.75) AS c FROM s), z AS (SELECT s.*, CASE WHEN regime IS NULL THEN NULL WHEN regime <= a THEN 1 WHEN regime <= b THEN 2 WHEN regime <= c THEN 3 ELSE 4 END AS quartile FROM s, e), {decomposition('z', 'quartile')}",
    "g_period_difficulty": f"{S}, b AS (SELECT (month - 36) // 3 AS block, {cos('y', 'p1')} AS cosine FROM s WHERE month >= 36 GROUP BY block), h AS (SELECT {cos('y', 'p1')} AS holdout FROM s WHERE month >= 65) SELECT {cols({'median': 'quantile_cont(cosine, 0.5)', 'holdout': 'max(holdout)', 'percentile': 'avg((cosine < holdout)::INT)'})} FROM b, h",
    "g_trend_slope": f"{S}, m AS (SELECT month, avg(y) AS v FROM s GROUP BY month) SELECT {cols({'slope': 'regr_slope(v, month)', 'start': 'regr_intercept(v, month)', 'n': 'count(*)'}, ('n',))} FROM m",
    "g_paired_verdict": f"{S}, m AS (SELECT month, {cos('y', 'p1')} - {cos('y', 'p2')} AS g FROM s GROUP BY month) SELECT {cols({'gain': 'avg(g)', 'se': 'stddev_samp(g) / sqrt(count(*))', 'improved': 'count(*) FILTER (WHERE g > 0)', 'n': 'count(*)'}, ('improved', 'n'))} FROM m",
    "g_drift": f"{sql_views('wide')}, {DRIFT} SELECT feature, {cols({'mean_train': 'm1', 'mean_test': 'm2', 'shift': 'shift', 'std_ratio': 'std_ratio', 'null_delta': 'null_delta'})} FROM e",
    "g_drift_summary": f"{sql_views('wide')}, {DRIFT} SELECT count(*) AS features, count(*) FILTER (WHERE shift < 0.1) AS below_0p1, count(*) FILTER (WHERE shift >= 0.1 AND shift < 0.3) AS from_0p1, count(*) FILTER (WHERE shift >= 0.3 AND shift < 0.5) AS from_0p3, count(*) FILTER (WHERE shift >= 0.5) AS from_0p5, {cols({'median_shift': 'quantile_cont(shift, 0.5)', 'max_shift': 'max(shift)'})}, count(*) FILTER (WHERE abs(null_delta) > 0.1) AS null_changes FROM e",
    "g_drift_by_family": f"{sql_views('wide')}, {DRIFT} SELECT split_part(feature, '_', 1) AS family, count(*) AS n, {cols({'most': 'max(shift)', 'mean': 'avg(shift)'})} FROM e GROUP BY family",
    "g_correlation_pairs": f"{pairs()} SELECT a, b, {r('r')} AS r FROM pr",
    "g_duplicate_groups": pairs().replace("WITH ", "WITH RECURSIVE ", 1) + ", n(feature, i) AS (VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(WIDE)) + "), ed AS (SELECT a, b FROM pr WHERE r > 0.999 UNION ALL SELECT b, a FROM pr WHERE r > 0.999), reach(feature, other) AS (SELECT feature, feature FROM n UNION SELECT reach.feature, ed.b FROM reach JOIN ed ON reach.other = ed.a) SELECT feature, leader, feature <> leader AS duplicate FROM (SELECT reach.feature, arg_min(other, n.i) AS leader FROM reach JOIN n ON other = n.feature GROUP BY reach.feature)",
    "g_adversarial_auc": f"{sql_views('wide')}, k AS (SELECT split, rank() OVER (ORDER BY mkt_price) + (count(*) OVER (PARTITION BY mkt_price) - 1) / 2 AS rk FROM wide), c AS (SELECT count(*) FILTER (WHERE split = 'test') AS p, count(*) FILTER (WHERE split = 'train') AS q, sum(rk) FILTER (WHERE split = 'test') AS s FROM k) SELECT {r('(s - p * (p + 1) / 2) / p / q')} AS auc, p AS positives FROM c",
    "h_ranked_signals": f"{S} SELECT sample_id, row_number() OVER (ORDER BY abs(p1) DESC, sample_id) AS rank, {r('sign(p1)::DOUBLE')} AS signal FROM s WHERE p1 <> 0",
    "h_backtest_costs": f"{S}, {curve('cost_bps', 'g.cost_bps * 1e-4::DOUBLE', 'ceil(0.2::DOUBLE * (SELECT count(*) FROM s))', COSTS_BPS)} SELECT cost_bps, {r('(SELECT quantile_cont(abs(p1), 0.8) FROM s)')} AS threshold, {cols(MEASURES, ('trades',))} FROM d GROUP BY cost_bps",
    "i_median_impute": f"{sql_views('wide')}, m AS (SELECT coalesce(quantile_cont(txn_unit_price, 0.5) FILTER (WHERE split = 'train'), 0) AS v FROM wide) SELECT split, {r('avg(coalesce(txn_unit_price, v))')} AS mean, count(*) AS n FROM wide, m GROUP BY split",
    "i_standardise": f"{sql_views('wide')}, m AS (SELECT avg(mkt_price) FILTER (WHERE split = 'train') AS a, stddev_pop(mkt_price) FILTER (WHERE split = 'train') AS s FROM wide) SELECT split, {cols({'mean': 'avg((mkt_price - a) / s)', 'std': 'stddev_pop((mkt_price - a) / s)', 'constant': '0.0::DOUBLE'})} FROM wide, m GROUP BY split",
    "i_blend_weights": f"{S}, g AS (SELECT sum(p1*p1) AS a, sum(p1*p2) AS b, sum(p2*p2) AS d, sum(p1*y) AS u, sum(p2*y) AS v FROM s), w AS (SELECT (d*u - b*v) / (a*d - b*b) AS w1, (a*v - b*u) / (a*d - b*b) AS w2 FROM g) SELECT 'p1' AS model, {r('w1 / (abs(w1) + abs(w2))')} AS weight FROM w UNION ALL SELECT 'p2', {r('w2 / (abs(w1) + abs(w2))')} FROM w",
    "j_contract_faults": f"""{sql_views('order_flow')}, v AS (SELECT count(*) FILTER (WHERE side NOT IN (0, 1)) AS a, count(*) FILTER (WHERE order_action NOT IN (0, 1)) AS b, count(*) FILTER (WHERE NOT price BETWEEN 0 AND 2) AS c, count(*) FILTER (WHERE volume < 500) AS d, count(*) FILTER (WHERE NOT {CLOCK} BETWEEN 0 AND 60.001) AS e FROM order_flow)
SELECT 'side' AS rule, a AS violations FROM v UNION ALL SELECT 'order_action', b FROM v UNION ALL SELECT 'price', c FROM v UNION ALL SELECT 'volume', d FROM v UNION ALL SELECT '{CLOCK}', e FROM v""",
    "j_staging_summary": f"{sql_views('market')} SELECT count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples, {r(f'min({CLOCK})')} AS min_seconds, {r(f'max({CLOCK})')} AS max_seconds, count(*) FILTER (WHERE {CLOCK} < 0) AS ahead FROM market",
    "j_clock_order": f"{sql_views('trade')}, b AS (SELECT *, lag({CLOCK}) OVER (PARTITION BY sample_id ORDER BY row_id) AS before FROM trade) SELECT sample_id, count(*) FILTER (WHERE {CLOCK} > before + 1e-6) AS rising FROM b GROUP BY sample_id",
    "k_month_quota": f"{S} SELECT month, sample_id, {r('y')} AS y FROM s QUALIFY row_number() OVER (PARTITION BY month ORDER BY sample_id) <= 5",
    "k_top_features": f"{sql_views('wide')}, {DRIFT} SELECT feature, {r('shift')} AS shift FROM e ORDER BY e.shift DESC NULLS LAST, feature LIMIT 3",
    "k_missing_keys": f"{sql_views('market', 'trade')} SELECT DISTINCT sample_id FROM market WHERE sample_id NOT IN (SELECT sample_id FROM trade)",
}
