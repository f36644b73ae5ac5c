"""Column contracts and audits of tables, as rows of faults; regime descriptors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.operators.evaluation import exact_quantiles

#: Added to signals before the logarithm.
FLOOR = 1e-9


@dataclass(frozen=True)
class Rule:
    """What a column must be: Spark's name of its type, bounds, allowed values, and whether it may be null or must not repeat."""

    kind: str
    low: float | None = None
    high: float | None = None
    among: tuple = ()
    nullable: bool = False
    unique: bool = False


def contract_report(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(column, rule, violations) of every rule, kept ones too, so that no fault hides another. Nulls break only the null rule; a column that is
    missing has one row, missing, 1. Values are counted in one pass; a unique column's rows beyond each value's first in one more."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    facts, counts = [], []
    for name, rule in rules.items():
        if name not in have:
            facts.append((name, "missing", 1))
            continue
        facts.append((name, "type", int(have[name] != rule.kind)))
        c = F.col(name)
        tests = {"null": None if rule.nullable else c.isNull(), "low": None if rule.low is None else c < rule.low, "high": None if rule.high is None else c > rule.high, "member": ~c.isin(*rule.among) if rule.among else None}
        counts += [F.struct(F.lit(name).alias("column"), F.lit(k).alias("rule"), F.count_if(t).alias("violations")) for k, t in tests.items() if t is not None]
    parts = [df.sparkSession.createDataFrame(facts, "column string, rule string, violations long")]
    if counts:
        parts.append(df.agg(F.array(*counts).alias("a")).select(F.inline("a")))
    for name in (n for n, rule in rules.items() if rule.unique and n in have):
        keys = df.where(F.col(name).isNotNull()).groupBy(name).agg((F.count("*") - 1).alias("n"))
        parts.append(keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(name).alias("column"), F.lit("unique").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def schema_text(df: DataFrame, leave: set[str] = frozenset()) -> str:
    """name:type of the columns in order of their names."""
    return ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema if f.name not in leave))


def table_audit(tables: dict[str, DataFrame], expected: DataFrame, required: dict[str, dict[str, str]], leaks: dict[str, set[str]], alike: list[tuple[str, str]], labels: set[str] = frozenset()) -> DataFrame:
    """(table_name, n_rows, rows_agree, n_columns, schema_sha256, faults) of each table.

    ``expected`` has (table_name, expected); rows_agree is null where it has no row. faults names, in order: required columns that are
    absent or of another type, columns that must not be in the table, and the tables of ``alike`` whose columns differ once ``labels`` are left out.
    """
    parts = []
    for name, d in tables.items():
        have = {f.name: f.dataType.simpleString() for f in d.schema}
        faults = [f"{c}: {have.get(c, 'missing')}, not {k}" for c, k in required.get(name, {}).items() if have.get(c) != k]
        faults += [f"{c}: must not be here" for c in leaks.get(name, ()) if c in have]
        faults += [f"{b}: other columns" for a, b in alike if a == name and schema_text(d, labels) != schema_text(tables[b], labels)]
        parts.append(d.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(have)).alias("n_columns"), F.sha2(F.lit(schema_text(d)), 256).alias("schema_sha256"), F.lit("; ".join(sorted(faults))).alias("faults")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.join(F.broadcast(expected), "table_name", "left").select("table_name", "n_rows", (F.col("n_rows") == F.col("expected")).alias("rows_agree"), "n_columns", "schema_sha256", "faults")


def regime_descriptors(pool: DataFrame, df: DataFrame, signals: list[str], k: int = 4, key: str = "sample_id", seed: int = 7) -> DataFrame:
    """(key, regime, centre_<signal>, regime_share, regime_dist) of df, by k-means over the pool's standardised log signals.

    Nulls and signals without a logarithm are filled with the pool's exact median. Centres are in log units, the share is the
    pool's rows in the regime, the distance is to the own centre in standardised units. What comes to the driver is a few numbers per signal and regime.
    """
    logs = lambda d: d.select(key, *(F.log(F.col(s).cast("double") + FLOOR).alias(s) for s in signals))
    p = logs(pool)
    fill = {s: exact_quantiles(p, s, {"q": 0.5}).first()["q"] or 0.0 for s in signals}
    m = p.fillna(fill).agg(*(F.avg(s).alias(f"m_{s}") for s in signals), *(F.stddev_pop(s).alias(f"s_{s}") for s in signals)).first()
    at = {s: (m[f"m_{s}"] or 0.0, (m[f"s_{s}"] or 0.0) + 1e-12) for s in signals}
    scaled = lambda d: VectorAssembler(inputCols=[f"__{s}" for s in signals], outputCol="__z").transform(d.fillna(fill).withColumns({f"__{s}": (F.col(s) - a) / b for s, (a, b) in at.items()}))
    z = scaled(p)
    fit = KMeans(featuresCol="__z", predictionCol="regime", k=k, seed=seed).fit(z)
    sizes = {r["regime"]: r["n"] for r in fit.transform(z).groupBy("regime").agg(F.count("*").alias("n")).collect()}  # k rows
    centres = fit.clusterCenters()
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("regime") + 1)
    out = fit.transform(scaled(logs(df)))
    dist = F.sqrt(sum(((F.col(f"__{s}") - pick([c[i] for c in centres])) ** 2 for i, s in enumerate(signals)), F.lit(0.0)))
    share = pick([sizes.get(i, 0) / sum(sizes.values()) for i in range(len(centres))])
    return out.select(key, "regime", *(pick([c[i] * at[s][1] + at[s][0] for c in centres]).alias(f"centre_{s}") for i, s in enumerate(signals)), share.alias("regime_share"), dist.alias("regime_dist"))
