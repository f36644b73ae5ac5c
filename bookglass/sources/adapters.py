"""Order-book shaped views over star-schema tables: each user is a sample, event time becomes a backward clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: SQL of each view, valid for Spark and DuckDB; the 80 calendar months of the orders are laid onto months 0 to 70; {src} is what it reads, {micros} the clock in microseconds.
VIEWS = {
    "base": ("events", """SELECT event_id AS row_id, user_id AS sample_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
  CAST((1706659200000000 - {micros}) AS DOUBLE) / 2592000000000.0E0 AS age FROM {src}"""),
    "market": ("base", """SELECT row_id, sample_id, age * 600.0E0 AS seconds_before_predict,
  1.0E0 + (k - 50) * 1.0E-4 + (row_id % 5 - 2) * 1.0E-4 AS transaction_avgprice,
  CAST(floor(value) AS INT) AS transaction_volume, CAST(row_id % 40 AS INT) AS transaction_count,
  CASE WHEN event_type = 'error' AND k < 30 THEN 0.0E0 ELSE 1.0E0 + (k - 50) * 1.0E-4 + (5 + row_id % 7) * 1.0E-4 END AS ask_price_1,
  CASE WHEN event_type = 'error' AND k < 30 THEN 0 ELSE 100 + (row_id % 50) * 10 END AS ask_volume_1,
  CASE WHEN event_type = 'signup' AND k < 10 THEN 0.0E0 ELSE 1.0E0 + (k - 50) * 1.0E-4 - (5 + row_id % 7) * 1.0E-4 END AS bid_price_1,
  CASE WHEN event_type = 'signup' AND k < 10 THEN 0 ELSE 100 + (row_id % 37) * 10 END AS bid_volume_1,
  CASE WHEN event_type = 'error' AND k < 30 THEN 0.0E0 ELSE 1.0E0 + (k - 50) * 1.0E-4 + (9 + row_id % 11) * 1.0E-4 + 6.0E-4 END AS ask_price_2,
  CASE WHEN event_type = 'error' AND k < 30 THEN 0 ELSE 100 + (row_id % 61) * 10 END AS ask_volume_2,
  CASE WHEN event_type = 'signup' AND k < 10 THEN 0.0E0 ELSE 1.0E0 + (k - 50) * 1.0E-4 - (9 + row_id % 13) * 1.0E-4 - 6.0E-4 END AS bid_price_2,
  CASE WHEN event_type = 'signup' AND k < 10 THEN 0 ELSE 100 + (row_id % 43) * 10 END AS bid_volume_2 FROM {src}"""),
    "order_flow": ("base", """SELECT row_id, sample_id, age * 60.0E0 AS seconds_before_predict, 1.0E0 + (2 * (row_id % 2) - 1) * (1.0E-3 + k * 1.0E-5) AS price,
  100 * (1 + k) AS volume, CAST(row_id % 2 AS INT) AS side, CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS order_action FROM {src}"""),
    "trade": ("base", """SELECT row_id, sample_id, age * 60.0E0 AS seconds_before_predict, 1.0E0 + (CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END) * (5.0E-4 + k * 1.0E-6) AS price,
  CAST(floor(value * 100.0E0) AS BIGINT) AS volume, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS side FROM {src} WHERE event_type IN ('purchase', 'click')"""),
    "scored": ("orders", """SELECT o_orderkey AS sample_id, CAST(floor(((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1) * 71 / 80.0E0) AS INT) AS month,
  (CAST(floor(o_totalprice) AS BIGINT) % 101 - 50) * 1.0E-4 AS y,
  (CAST(floor(o_totalprice) AS BIGINT) % 101 - 50) * 2.0E-5 + (o_custkey % 97 - 48) * 1.0E-4 AS p1,
  (CAST(floor(o_totalprice) AS BIGINT) % 101 - 50) * 1.0E-5 + (o_orderkey % 89 - 44) * 1.0E-4 AS p2,
  o_orderpriority AS grp, o_totalprice AS regime FROM {src}"""),
    "wide": ("lineitem", """SELECT l_orderkey, CASE WHEN l_shipdate < TIMESTAMP '1998-07-01 00:00:00' THEN 'train' ELSE 'test' END AS split,
  CAST(l_quantity AS DOUBLE) AS mkt_quantity, CAST(l_extendedprice AS DOUBLE) AS mkt_price, CAST(l_discount AS DOUBLE) AS ord_discount, CAST(l_tax AS DOUBLE) AS ord_tax,
  2.0E0 * l_quantity AS txn_quantity_copy, -1.0E0 * l_discount AS txn_discount_neg,
  CASE WHEN l_discount > 0.08E0 THEN NULL ELSE l_extendedprice / nullif(l_quantity, 0.0E0) END AS txn_unit_price, 1.0E0 AS txn_constant FROM {src}"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the columns that a query uses are read."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, text = VIEWS[name]
    return spark.sql(text.replace("{micros}", "unix_micros(CAST(ts AS TIMESTAMP))"), src=view(spark, sf_dir, source))


def sql_views(*names: str) -> str:
    """The same views as common table expressions of DuckDB, in the order of their needs."""
    order: list[str] = []

    def need(n: str) -> None:
        if n in VIEWS and n not in order:
            need(VIEWS[n][0])
            order.append(n)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1].replace('{micros}', 'epoch_us(ts)').replace('{src}', VIEWS[n][0])})" for n in order)
