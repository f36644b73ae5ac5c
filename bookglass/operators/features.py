"""Per-sample features of nested windows: one scan each, rows combined by sample before they are exchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookglass.functions.exprs import AGE, EVENT_WINDOWS, MARKET_WINDOWS, corr_safe, count, imbalance, label, mean_in, safe_div, slope, total, within

BID, ASK, NEW, CANCEL, BUY, SELL = 0, 1, 0, 1, 0, 1
#: Trades of this volume and more are large.
LARGE_TRADE = 10_000
DECAYS = {"0p1": 0.1, "0p5": 0.5}
SNAPSHOT = ["mid", "spread", "rel_spread", "microprice", "depth_imb_1", "depth_imb_12", "total_depth", "ask_slope", "bid_slope"]


def book(raw: DataFrame) -> DataFrame:
    """Raw snapshots with a price of 0 as an empty level, and the book's derived columns. Stateless: runs on a stream too."""
    price = lambda c: F.nullif(F.col(c), F.lit(0.0))
    d = raw.withColumns({"ap1": price("ask_price_1"), "bp1": price("bid_price_1"), "ap2": price("ask_price_2"), "bp2": price("bid_price_2")} | {n: F.col(c).cast("double") for n, c in {"av1": "ask_volume_1", "bv1": "bid_volume_1", "av2": "ask_volume_2", "bv2": "bid_volume_2"}.items()})
    c = F.col
    two_sided = c("ap1").isNotNull() & c("bp1").isNotNull()
    return d.withColumns({
        "is_empty_bid": (c("bid_price_1") == 0).cast("int"),
        "is_empty_ask": (c("ask_price_1") == 0).cast("int"),
        "mid": (c("ap1") + c("bp1")) / 2,
        "spread": c("ap1") - c("bp1"),
        "rel_spread": safe_div(c("ap1") - c("bp1"), (c("ap1") + c("bp1")) / 2),
        "microprice": safe_div(c("ap1") * c("bv1") + c("bp1") * c("av1"), c("bv1") + c("av1")),
        "depth_imb_1": F.when(two_sided, imbalance(c("bv1"), c("av1"))),
        "depth_imb_12": F.when(two_sided, imbalance(c("bv1") + c("bv2"), c("av1") + c("av2"))),
        "total_depth": c("bv1") + c("bv2") + c("av1") + c("av2"),
        "ask_slope": c("ap2") - c("ap1"),
        "bid_slope": c("bp1") - c("bp2"),
    })


def ring(windows: list[int]) -> Column:
    """The place of the smallest window that a row is in; their number for rows in none or without an age."""
    at = F.lit(len(windows))
    for i, w in reversed(list(enumerate(windows))):
        at = F.when(within(w), F.lit(i)).otherwise(at)
    return at


def market_features(raw: DataFrame, windows: list[int] = MARKET_WINDOWS) -> DataFrame:
    """159 features of each sample's book. Each row counts once, in its ring: the part of its smallest window that the next smaller one leaves.
    The rings, at most one more than the windows for each sample, are added up to windows after a second exchange, which carries them alone;
    deviations are merged about the newest ring's mean. A sample of any number of rows is combined before it is exchanged.
    Equal ages go by row_id; rows without an age are in no window, and are nobody's newest or oldest."""
    c = F.col
    b = book(raw).withColumn("ring", ring(windows))
    means = {"mid_mean": c("mid"), "spread_mean": c("spread"), "rel_spread_mean": c("rel_spread"), "depth_imb1_mean": c("depth_imb_1"), "depth_imb12_mean": c("depth_imb_12"), "micro_minus_mid": c("microprice") - c("mid"), "ask_slope": c("ask_slope"), "bid_slope": c("bid_slope"), "total_depth_mean": c("total_depth"), "trade_aggression": safe_div(c("transaction_avgprice") - c("mid"), c("spread"))}
    spreads = {"mid_std": ("mid", "mid_mean"), "depth_imb1_std": ("depth_imb_1", "depth_imb1_mean")}
    age, seen = F.struct(c(AGE), c("row_id")), c("mid").isNotNull() & c(AGE).isNotNull()
    parts = [x for n, v in means.items() for x in (F.sum(v).alias(f"s_{n}"), F.count(v).alias(f"n_{n}"))]
    parts += [F.var_pop(v).alias(f"v_{n}") for n, (v, _) in spreads.items()]
    parts += [F.max("mid").alias("high"), F.min("mid").alias("low"), F.sum(c("transaction_volume").cast("double")).alias("volume"), F.sum(c("transaction_count").cast("double")).alias("trades"), F.count("*").alias("rows"), F.sum("is_empty_bid").alias("no_bid"), F.count("is_empty_bid").alias("bids"), F.sum("is_empty_ask").alias("no_ask"), F.count("is_empty_ask").alias("asks"), count(c("mid").isNull()).alias("no_mid"), F.min("spread").alias("least_spread"), F.min(AGE).alias("newest_age")]
    parts += [F.min_by(F.struct(*SNAPSHOT, AGE), F.when(seen, age)).alias("newest"), F.max_by("mid", F.when(seen, age)).alias("oldest_mid")]
    outward = Window.partitionBy("sample_id").orderBy("ring")
    rings = b.groupBy("sample_id", "ring").agg(*parts)
    near = {n: safe_div(c(f"s_{m}"), c(f"n_{m}")) for n, (_, m) in spreads.items()}
    rings = rings.withColumns({f"d_{n}": x - F.first(x, ignorenulls=True).over(outward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for n, x in near.items()})

    sums: list[Column] = []
    for i, w in enumerate(windows):
        t, on = label(w), c("ring") <= i
        inside = lambda x, on=on: F.sum(F.when(on, x))
        sums += [safe_div(inside(c(f"s_{n}")), inside(c(f"n_{n}"))).alias(f"mkt_{n}_{t}") for n in means]
        for n, (_, m) in spreads.items():
            rows, d = c(f"n_{m}"), c(f"d_{n}")
            apart = inside(rows * c(f"v_{n}")) + inside(rows * d * d) - safe_div(inside(rows * d) * inside(rows * d), inside(rows))
            sums.append(F.sqrt(safe_div(F.when(apart < 0, 0.0).otherwise(apart), inside(rows) - 1)).alias(f"mkt_{n}_{t}"))
        sums += [(F.max(F.when(on, c("high"))) - F.min(F.when(on, c("low")))).alias(f"mkt_mid_range_{t}"), F.max_by("oldest_mid", F.when(on & c("oldest_mid").isNotNull(), c("ring"))).alias(f"mkt_mid_start_{t}")]
        sums += [(total(on, x) / w).alias(f"mkt_{n}_{t}") for n, x in (("trade_volume_rate", F.coalesce("volume", F.lit(0.0))), ("trade_count_rate", F.coalesce("trades", F.lit(0.0))), ("snapshot_rate", c("rows")))]
    sums += [safe_div(F.sum("no_bid"), F.sum("bids")).alias("mkt_empty_bid_share"), safe_div(F.sum("no_ask"), F.sum("asks")).alias("mkt_empty_ask_share"), (F.sum("no_mid") / F.sum("rows")).alias("mkt_null_mid_share"), safe_div(F.sum("s_spread_mean"), F.sum("n_spread_mean")).alias("mkt_spread_mean_clean"), F.min("least_spread").alias("mkt_spread_min"), F.min("newest_age").alias("mkt_last_seconds_gap"), F.sum("rows").alias("mkt_n_snapshots"), F.min_by("newest", F.when(c("newest").isNotNull(), c("ring"))).alias("last")]
    one = rings.groupBy("sample_id").agg(*sums)
    names = {f: f"mkt_{f.replace('imb_1', 'imb1')}_last" for f in SNAPSHOT} | {AGE: "mkt_last_valid_gap"}
    one = one.withColumns({n: c(f"last.{f}") for f, n in names.items()}).drop("last")
    far = label(windows[-1])
    more = {f"mkt_mid_return_{label(w)}": safe_div(c("mkt_mid_last"), c(f"mkt_mid_start_{label(w)}")) - 1 for w in windows}
    more |= {"mkt_micro_minus_mid_last": c("mkt_microprice_last") - c("mkt_mid_last"), "mkt_micro_edge_norm_last": safe_div(c("mkt_microprice_last") - c("mkt_mid_last"), c("mkt_spread_last")), "mkt_spread_last_vs_mean": safe_div(c("mkt_spread_last"), c(f"mkt_spread_mean_{far}")), "mkt_depth_last_vs_mean": safe_div(c("mkt_total_depth_last"), c(f"mkt_total_depth_mean_{far}"))}
    for w in windows[:-1]:
        t = label(w)
        more |= {f"mkt_snapshot_accel_{t}_vs_{far}": safe_div(c(f"mkt_snapshot_rate_{t}"), c(f"mkt_snapshot_rate_{far}")), f"mkt_depth_imb1_delta_{t}_vs_{far}": c(f"mkt_depth_imb1_mean_{t}") - c(f"mkt_depth_imb1_mean_{far}")}
    return one.withColumns(more)


def order_features(orders: DataFrame, windows: list[int] = EVENT_WINDOWS) -> DataFrame:
    """81 features of each sample's order flow."""
    c, v = F.col, F.col("volume").cast("double")
    is_ = lambda side, action: (c("side") == side) & (c("order_action") == action)
    raw: list[Column] = []
    derived: dict[str, Column] = {}
    for w in windows:
        t, on = label(w), within(w)
        for name, side, action in (("nb", BID, NEW), ("na", ASK, NEW), ("cb", BID, CANCEL), ("ca", ASK, CANCEL)):
            raw += [count(on & is_(side, action)).alias(f"{name}_{t}"), total(on & is_(side, action), v).alias(f"v{name}_{t}")]
        for side, name in ((BID, "b"), (ASK, "a")):
            raw += [total(on & (c("side") == side), c("price") * v).alias(f"pv{name}_{t}")]
        x = {n: c(f"{n}_{t}") for n in ("nb", "na", "cb", "ca", "vnb", "vna", "vcb", "vca", "pvb", "pva")}
        new, gone, vnew, vgone = x["nb"] + x["na"], x["cb"] + x["ca"], x["vnb"] + x["vna"], x["vcb"] + x["vca"]
        derived |= {
            f"ord_new_rate_{t}": new / w, f"ord_cancel_rate_{t}": gone / w, f"ord_cancel_new_ratio_{t}": safe_div(gone, new),
            f"ord_ofi_{t}": safe_div(x["vnb"] - x["vcb"] - x["vna"] + x["vca"], vnew + vgone),
            f"ord_new_count_imbalance_{t}": imbalance(x["nb"], x["na"]), f"ord_new_volume_imbalance_{t}": imbalance(x["vnb"], x["vna"]),
            f"ord_cancel_count_imbalance_{t}": imbalance(x["cb"], x["ca"]), f"ord_cancel_volume_imbalance_{t}": imbalance(x["vcb"], x["vca"]),
            f"ord_avg_new_size_{t}": safe_div(vnew, new), f"ord_avg_cancel_size_{t}": safe_div(vgone, gone), f"ord_event_rate_{t}": (new + gone) / w,
            f"ord_bid_vwap_{t}": safe_div(x["pvb"], x["vnb"] + x["vcb"]), f"ord_ask_vwap_{t}": safe_div(x["pva"], x["vna"] + x["vca"]),
        }
    for tag, rate in DECAYS.items():
        decayed = v * F.exp(-rate * c(AGE))
        raw += [total(is_(BID, NEW), decayed).alias(f"db_{tag}"), total(is_(ASK, NEW), decayed).alias(f"da_{tag}")]
        derived[f"ord_decay_imbalance_lam{tag}"] = imbalance(c(f"db_{tag}"), c(f"da_{tag}"))
    plain = {"ord_n_total": F.count("*"), "ord_last_seconds_gap": F.min(AGE), "ord_window_covered": F.max(AGE), "ord_cancel_share_total": count(c("order_action") == CANCEL) / F.count("*"), "ord_volume_std": F.stddev("volume"), "ord_max_to_avg_size": safe_div(F.max("volume"), F.avg("volume"))}
    one = orders.groupBy("sample_id").agg(*raw, *(x.alias(n) for n, x in plain.items())).select("sample_id", *plain, *(x.alias(n) for n, x in derived.items()))
    far = label(windows[-1])
    return one.withColumns({f"ord_event_accel_{label(w)}_vs_{far}": safe_div(c(f"ord_event_rate_{label(w)}"), c(f"ord_event_rate_{far}")) for w in windows[:-1]} | {f"ord_ofi_delta_{label(w)}_vs_{far}": c(f"ord_ofi_{label(w)}") - c(f"ord_ofi_{far}") for w in windows[:-1]})


def trade_features(trades: DataFrame, windows: list[int] = EVENT_WINDOWS) -> DataFrame:
    """52 features of each sample's trades."""
    c, v = F.col, F.col("volume").cast("double")
    cols: dict[str, Column] = {}
    for w in windows:
        t, on = label(w), within(w)
        buy, sell = on & (c("side") == BUY), on & (c("side") == SELL)
        cols |= {
            f"txn_intensity_{t}": count(on) / w, f"txn_volume_rate_{t}": total(on, v) / w,
            f"txn_volume_imbalance_{t}": imbalance(total(buy, v), total(sell, v)), f"txn_count_imbalance_{t}": imbalance(count(buy), count(sell)),
            f"txn_vwap_{t}": safe_div(total(on, c("price") * v), total(on, v)), f"txn_avg_size_{t}": safe_div(total(on, v), count(on)),
            f"txn_price_std_{t}": F.stddev(F.when(on, c("price"))), f"txn_price_range_{t}": F.max(F.when(on, c("price"))) - F.min(F.when(on, c("price"))),
        }
    age = F.struct(c(AGE), c("row_id"))
    cols |= {"txn_last_price": F.min_by("price", age), "txn_first_price": F.max_by("price", age), "txn_last_seconds_gap": F.min(AGE), "txn_n_total": F.count("*"), "txn_window_covered": F.max(AGE), "txn_vwap_total": safe_div(F.sum(c("price") * v), F.sum(v)), "txn_large_volume_share": safe_div(total(c("volume") >= LARGE_TRADE, v), F.sum(v))}
    one = trades.groupBy("sample_id").agg(*(x.alias(n) for n, x in cols.items())).withColumn("txn_window_return", safe_div(c("txn_last_price"), c("txn_first_price")) - 1)
    far = label(windows[-1])
    return one.withColumns({f"txn_intensity_accel_{label(w)}_vs_{far}": safe_div(c(f"txn_intensity_{label(w)}"), c(f"txn_intensity_{far}")) for w in windows[:-1]})


def shape_features(raw: DataFrame) -> DataFrame:
    """18 features of the path of each sample's book, in time order; one exchange serves the windows and the aggregate."""
    c = F.col
    w = Window.partitionBy("sample_id").orderBy(c(AGE).desc(), "row_id")
    s = book(raw).select("sample_id", "row_id", AGE, (-c(AGE)).alias("t"), "mid", "spread", "depth_imb_1", "total_depth", (c("mid") - F.lag("mid").over(w)).alias("dmid"), (c(AGE) - F.lag(AGE).over(w)).alias("dt"), F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("sample_id")).alias("n"))
    s = s.withColumns({"before": F.lag("dmid").over(w), "dmid4": F.when(c("rn") % 4 == 0, c("mid") - F.lag("mid", 4).over(w))})
    path, end = F.sum(F.abs("dmid")), F.max(F.when(c("rn") == c("n"), c("mid")))
    late = c("rn") > c("n") / 2
    drift = lambda x: F.avg(F.when(late, c(x))) - F.avg(F.when(~late, c(x)))
    same = (F.signum("dmid") == F.signum("before")) & (c("dmid") != 0)
    return s.groupBy("sample_id").agg(
        safe_div(F.abs(F.sum("dmid")), path).alias("shp_mid_path_efficiency"),
        safe_div(F.max("mid") - F.min("mid"), path).alias("shp_mid_range_over_path"),
        corr_safe(c("dmid"), c("before")).alias("shp_mid_autocorr1"),
        F.avg(F.when(c("dmid").isNotNull() & c("before").isNotNull(), same.cast("double"))).alias("shp_sign_persistence"),
        safe_div(F.sqrt(F.sum(c("dmid") * c("dmid"))), F.sqrt(F.sum(c("dmid4") * c("dmid4")))).alias("shp_rv_signature_ratio"),
        *(slope(c(x), c("t")).alias(f"shp_{n}_slope") for n, x in (("imb", "depth_imb_1"), ("spread", "spread"), ("depth", "total_depth"), ("mid", "mid"))),
        corr_safe(c("depth_imb_1"), c("t")).alias("shp_imb_trend_corr"),
        *(drift(x).alias(f"shp_{n}_drift") for n, x in (("imb", "depth_imb_1"), ("spread", "spread"), ("depth", "total_depth"))),
        safe_div(F.max("mid") - end, end).alias("shp_mid_runup_rel"),
        safe_div(end - F.min("mid"), end).alias("shp_mid_drawdown_rel"),
        safe_div(F.stddev_pop("dt"), F.abs(F.avg("dt"))).alias("shp_gap_cv"),
        F.max(F.abs("dt")).alias("shp_max_gap"),
        F.count("*").alias("shp_n_snaps"),
    )


def assemble(*blocks: DataFrame) -> DataFrame:
    """Feature blocks joined by sample; samples that a block lacks drop. Blocks come partitioned by sample, so no exchange is added."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, "sample_id")
    return out


def as_of(trades: DataFrame, quotes: DataFrame, value: str = "mid") -> DataFrame:
    """Each trade with the newest earlier quote of its sample: both streams in one ordered window, quotes before trades of the same instant."""
    both = quotes.select("sample_id", AGE, "row_id", F.lit(0).alias("kind"), F.col(value), F.lit(None).cast("double").alias("price"), F.lit(None).cast("int").alias("side")).unionByName(trades.select("sample_id", AGE, "row_id", F.lit(1).alias("kind"), F.lit(None).cast("double").alias(value), F.col("price"), F.col("side").cast("int")))
    w = Window.partitionBy("sample_id").orderBy(F.col(AGE).desc(), "kind", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"prevailing_{value}", F.last(value, ignorenulls=True).over(w)).where("kind = 1").drop("kind", value)


def filled_mid(quotes: DataFrame) -> DataFrame:
    """quotes with ``filled``: the sample's last mid so far, else its next one, else 1."""
    w = Window.partitionBy("sample_id").orderBy(F.col(AGE).desc(), "row_id")
    back = F.last("mid", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    turned = Window.partitionBy("sample_id").orderBy(AGE, F.col("row_id").desc())  # from the other end, so that the frame grows
    ahead = F.last("mid", ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, 0))
    return quotes.withColumn("filled", F.coalesce(back, ahead, F.lit(1.0)))


def snapshot_channels(raw: DataFrame) -> DataFrame:
    """(row_id, sample_id, 15 channels) of each snapshot, in basis points of the filled mid, logs of volumes, and the age.
    Empty levels and snapshots without a trade give 0; all windows share one partitioning."""
    c, m = F.col, F.col("filled")
    bps = lambda x: F.coalesce(x / m * 1e4, F.lit(0.0))
    log = lambda n: F.log1p(F.greatest(F.col(n).cast("double"), F.lit(0.0)))
    whole = Window.partitionBy("sample_id").orderBy(c(AGE).desc(), "row_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    channels = {
        "return_bps": (m / F.last("filled").over(whole) - 1) * 1e4,
        "spread_bps": bps(c("spread")), "micro_bps": F.when(c("spread").isNotNull(), bps(c("microprice") - m)).otherwise(0.0),
        "ask_gap_bps": bps(c("ask_slope")), "bid_gap_bps": bps(c("bid_slope")),
        "trade_bps": F.when(c("transaction_count") > 0, bps(c("transaction_avgprice") - m)).otherwise(0.0),
        "imb1": F.coalesce(imbalance(c("bv1"), c("av1")), F.lit(0.0)), "imb12": F.coalesce(imbalance(c("bv1") + c("bv2"), c("av1") + c("av2")), F.lit(0.0)),
        "age": c(AGE) / 600.0,
    } | {f"log_{n}": log(n) for n in ("bv1", "av1", "bv2", "av2", "transaction_volume", "transaction_count")}
    return filled_mid(book(raw)).select("row_id", "sample_id", *(v.cast("double").alias(k) for k, v in channels.items()))
