"""Registered queries of contracts, audits, running scales and channel sequences, each beside the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.operators import audit, series
from bookglass.operators import features as ft
from bookglass.operators import pools
from bookglass.operators.audit import Rule
from bookglass.plans.comparisons import CHANNELS, FILLED
from bookglass.plans.sql import BOOK, CLOCK, S, cols, r
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


def running_sql(behind: int, ahead: int) -> str:
    return f"""{sql_views('scored')}, k AS (SELECT sample_id, month, median(regime) OVER w AS md, count(regime) OVER w AS n FROM scored
  WINDOW w AS (ORDER BY month, sample_id ROWS BETWEEN {behind} PRECEDING AND {ahead} FOLLOWING)),
m AS (SELECT sample_id, month, CASE WHEN n >= 50 THEN md END AS x FROM k),
f AS (SELECT sample_id, coalesce(first_value(x IGNORE NULLS) OVER (ORDER BY month, sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(x IGNORE NULLS) OVER (ORDER BY month, sample_id ROWS UNBOUNDED PRECEDING)) AS x FROM m)
SELECT sample_id, {r('x / avg(x) OVER ()')} AS scale FROM f"""


@query(running_sql(100, 99))
def e_centred_scale(t):
    return series.running_scale(t("scored"), "regime", centred=True).select("sample_id", "scale")


@query(running_sql(199, 0))
def e_causal_scale(t):
    return series.running_scale(t("scored"), "regime").select("sample_id", "scale")


@query(f"""{sql_views('market')}, {BOOK}, {FILLED}, c AS (SELECT row_id, sample_id, {CLOCK} AS clock, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in CHANNELS.items())} FROM fm),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY clock, row_id DESC) AS back, count(*) OVER (PARTITION BY sample_id) AS n FROM c),
g AS (SELECT unnest(range(1, {series.STEPS + 1})) AS slot)
SELECT sample_id, ({series.STEPS} - slot)::INT AS step, {cols({k: k for k in CHANNELS})}, (slot = back)::INT AS valid FROM k JOIN g ON slot = back OR (back = n AND slot > back)""")
def e_channel_sequences(t):
    return series.channel_sequences(t("market"))


ORDER_RULES = {
    "sample_id": Rule("int", low=0), "row_id": Rule("bigint", unique=True), "side": Rule("int", among=(0, 1)),
    "order_action": Rule("int", among=(0,)), "price": Rule("double", low=1.0, high=1.001), "volume": Rule("bigint", low=500), "month": Rule("int"),
}


@query(f"""{sql_views('order_flow')}, v AS (SELECT count(*) FILTER (WHERE sample_id IS NULL) AS a, count(*) FILTER (WHERE sample_id < 0) AS b, count(*) FILTER (WHERE row_id IS NULL) AS c,
  count(row_id) - count(DISTINCT row_id) AS d, count(*) FILTER (WHERE side IS NULL) AS e, count(*) FILTER (WHERE side NOT IN (0, 1)) AS f, count(*) FILTER (WHERE order_action IS NULL) AS g,
  count(*) FILTER (WHERE order_action NOT IN (0)) AS h, count(*) FILTER (WHERE price IS NULL) AS i, count(*) FILTER (WHERE price < 1.0) AS j, count(*) FILTER (WHERE price > 1.001) AS k,
  count(*) FILTER (WHERE volume IS NULL) AS l, count(*) FILTER (WHERE volume < 500) AS m FROM order_flow)
SELECT u.* FROM v, LATERAL (VALUES ('sample_id', 'type', 1), ('row_id', 'type', 0), ('side', 'type', 0), ('order_action', 'type', 0), ('price', 'type', 0), ('volume', 'type', 1), ('month', 'missing', 1),
  ('sample_id', 'null', a), ('sample_id', 'low', b), ('row_id', 'null', c), ('row_id', 'unique', d), ('side', 'null', e), ('side', 'member', f), ('order_action', 'null', g), ('order_action', 'member', h),
  ('price', 'null', i), ('price', 'low', j), ('price', 'high', k), ('volume', 'null', l), ('volume', 'low', m)) u("column", "rule", violations)""")
def j_contract_report(t):
    return audit.contract_report(t("order_flow"), ORDER_RULES)


@query(f"""{sql_views('wide')}, x AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-07-01 00:00:00' THEN 'train' ELSE 'test' END AS table_name, count(*) AS expected FROM lineitem GROUP BY 1),
n AS (SELECT 'train' AS table_name, count(*) AS n_rows, 4 AS n_columns, 'l_orderkey:bigint,mkt_price:double,mkt_quantity:double,split:string' AS s, 'test: other columns' AS faults FROM wide WHERE split = 'train'
  UNION ALL SELECT 'test', count(*), 4, 'l_orderkey:bigint,mkt_price:double,ord_tax:double,split:string', 'mkt_quantity: missing, not double; split: must not be here' FROM wide WHERE split = 'test')
SELECT table_name, n_rows, n_rows = expected AS rows_agree, n_columns, sha256(s) AS schema_sha256, faults FROM n JOIN x USING (table_name)""")
def j_table_audit(t):
    w = t("wide")
    tables = {"train": w.where("split = 'train'").select("l_orderkey", "split", "mkt_quantity", "mkt_price"), "test": w.where("split = 'test'").select("l_orderkey", "split", "mkt_price", "ord_tax")}
    expected = t("lineitem").groupBy(F.when(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp"), "train").otherwise("test").alias("table_name")).agg(F.count("*").alias("expected"))
    need = {"l_orderkey": "bigint", "mkt_price": "double", "mkt_quantity": "double"}
    return audit.table_audit(tables, expected, {"train": need, "test": need}, {"test": {"split"}}, [("train", "test")], {"split"})


def signals(t: Callable) -> DataFrame:
    return ft.book(t("market")).groupBy("sample_id").agg(F.avg("total_depth").alias("depth"), F.avg("spread").alias("spread"), F.stddev_samp("mid").alias("volatility"))


@query()
def i_regime_descriptors(t):
    s = signals(t)
    return audit.regime_descriptors(s.where("sample_id % 4 <> 0"), s, ["depth", "spread", "volatility"])


@query()
def i_pool_regimes(t):
    """Samples of three pools by the regimes of the first, and by their own pool's."""
    s = signals(t)
    name = F.when(F.col("sample_id") % 4 == 0, "test").when(F.col("sample_id") % 4 == 1, "val").otherwise("train")
    return pools.pool_regimes(s.withColumn("pool", name), ["train", "val", "test"], ["depth", "spread", "volatility"])
