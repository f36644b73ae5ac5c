"""Tables that are checked as files: ordered exports, bucketed tables, footers, loads that become visible as a whole, reconciled results."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookglass.sources.sinks import key_faults

#: Sorted keys in one file of an export, more or less.
ROWS_PER_FILE = 1_000_000


def export_ordered(df: DataFrame, path: str, keys: list[str], rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """df in files numbered in the order of its keys, and order_faults of what was written; raises ValueError where the keys don't
    strictly increase over all files: a repeated key, that is, or a null one.

    Rows are dealt by ranges of the keys, so no task sorts the table; the check reads the keys back, file by file.
    """
    many = max(1, -(-df.count() // rows_per_file))
    df.repartitionByRange(many, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)
    faults = order_faults(df.sparkSession, path, keys)
    bad = faults.where("unordered + nulls > 0 or overlaps").select("file").limit(5).collect()
    if bad:
        raise ValueError(f"keys don't increase in or before {', '.join(r['file'] for r in bad)}")
    return faults


def order_faults(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(file, n, first, last, unordered, nulls, overlaps) per file in the order of the names: rows whose keys aren't above those of the row before, rows
    with a null key, and whether the file's first keys aren't above the last ones of the file before. Files are bounded; neighbours meet as a row per file."""
    d = spark.read.parquet(path).select(*keys, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    key = F.struct(*keys)
    before = F.lag(key).over(Window.partitionBy("file").orderBy("at"))
    d = d.withColumns({"key": key, "bad": before.isNotNull() & ~F.coalesce(before < key, F.lit(False)), "empty": reduce(Column.__or__, (F.col(k).isNull() for k in keys))})
    files = d.groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"), F.count_if("bad").alias("unordered"), F.count_if("empty").alias("nulls"))
    previous = F.lag("last").over(Window.partitionBy(F.lit(1)).orderBy("file"))  # a row per file
    return files.withColumn("overlaps", previous.isNotNull() & ~F.coalesce(previous < F.col("first"), F.lit(False)))


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "sample_id", buckets: int = 64) -> DataFrame:
    """df as a table whose rows are dealt in buckets of the key, one file each, sorted by it: tables of as many buckets join and
    group by the key without an exchange. The table's files lie under ``path``; its name is the session's."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, n_rows) of the Parquet files of a table. No column is read: rows are counted from the footers, in tasks."""
    m = F.col("_metadata")
    return spark.read.parquet(path).groupBy(m["file_name"].alias("file"), m["file_size"].alias("bytes")).agg(F.count(F.lit(1)).alias("n_rows"))


def footer_ranges(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(column, n_rows, present, least, most) of numeric columns, from the statistics in the footers alone, by Spark's pushed-down aggregates. One
    row per column comes back; the session's settings are as before afterwards."""
    confs = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        d = spark.read.parquet(path)
        one = d.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("p", F.count), ("lo", F.min), ("hi", F.max)))).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    number = lambda x: None if x is None else float(x)
    rows = [(c, one["n"], one[f"p{i}"], number(one[f"lo{i}"]), number(one[f"hi{i}"])) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "column string, n_rows long, present long, least double, most double")


def footer_audit(spark: SparkSession, tables: dict[str, str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(table_name, n_files, bytes, n_rows, out_of_range) per table: the columns (with commas) whose least or most is out of its bounds, without reading data."""
    out = None
    for name, path in tables.items():
        known = [c for c in bounds if c in spark.read.parquet(path).columns]
        bad = sorted(r["column"] for r in footer_ranges(spark, path, known).collect() if r["least"] is not None and not (bounds[r["column"]][0] <= r["least"] and r["most"] <= bounds[r["column"]][1])) if known else []
        s = file_sizes(spark, path).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.lit(",".join(bad)).alias("out_of_range"))
        out = s if out is None else out.unionByName(s)
    return out


VERSIONS = "version long, part string, folder string, n_rows long, source string"


def _rows(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(VERSIONS).parquet(path).collect()  # a row per part of a load
    except AnalysisException:
        return []


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _folders(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]


def load_whole(parts: dict[str, DataFrame], path: str, source: str, key: str) -> int:
    """Rows of a load that readers (read_whole) see as a whole or not at all.

    Parts are written to the source's own folder, each followed by a row of progress, and those with a row aren't written again
    when a load that was cut is taken up. Then keys are checked to be 0 to n - 1, once each (ValueError otherwise, and what readers see
    stays), and one file of rows, a version, makes the parts visible. Only then the folders of older versions and of loads
    that were given up are removed, and with them all stale parts.
    """
    spark = next(iter(parts.values())).sparkSession
    progress, versions = f"{path}/_progress", f"{path}/_versions"
    done = {r["part"]: r for r in _rows(spark, progress) if r["source"] == source and r["part"] in parts}
    live = _rows(spark, versions)
    for name in parts:
        if name not in done:
            folder = f"run-{uuid.uuid4().hex}"
            parts[name].write.parquet(f"{path}/{folder}")
            n = spark.read.parquet(f"{path}/{folder}").count()
            spark.createDataFrame([(0, name, folder, n, source)], VERSIONS).coalesce(1).write.mode("append").parquet(progress)
            done[name] = spark.createDataFrame([(0, name, folder, n, source)], VERSIONS).first()
    whole = spark.read.parquet(*(f"{path}/{r['folder']}" for r in done.values()))
    n = sum(r["n_rows"] for r in done.values())
    f = key_faults(whole, key).first()
    ends = whole.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if f["nulls"] or f["repeated"] or f["missing"] or (n and (ends["lo"], ends["hi"]) != (0, n - 1)):
        raise ValueError(f"keys aren't 0 to {n - 1}, once each: {f['nulls']} null, {f['repeated']} repeated, {f['missing']} missing, from {ends['lo']} to {ends['hi']}")
    version = 1 + max((r["version"] for r in live), default=0)
    spark.createDataFrame([(version, p, r["folder"], r["n_rows"], source) for p, r in done.items()], VERSIONS).coalesce(1).write.mode("append").parquet(versions)
    kept = {r["folder"] for r in done.values()}
    for folder in _folders(spark, path):
        if folder.startswith("run-") and folder not in kept:
            _remove(spark, f"{path}/{folder}")
    _remove(spark, progress)
    return n


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version of a load; raises FileNotFoundError before the first."""
    rows = _rows(spark, f"{path}/_versions")
    if not rows:
        raise FileNotFoundError(f"no load of {path} is finished")
    newest = max(r["version"] for r in rows)
    return spark.read.parquet(*(f"{path}/{r['folder']}" for r in rows if r["version"] == newest))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-10) -> DataFrame:
    """(keys, status, columns) of every key of two published results: agrees, differs (in which columns, with commas), only in the first, or only in
    the second. Null and null agree, null and a number differ. A repeated key is ``repeated``."""
    side = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(f"__n{n}"), *(F.first(v).alias(f"__{n}_{i}") for i, v in enumerate(values)))
    left, right = side(a, "a"), side(b, "b").withColumnsRenamed({k: f"__{k}" for k in keys})
    met = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    j = left.join(right, met, "full")

    def apart(i: int) -> Column:
        x, y = F.col(f"__a_{i}"), F.col(f"__b_{i}")
        near = F.abs(x.cast("double") - y.cast("double")) <= tolerance if dict(a.dtypes)[values[i]] != "string" else x == y
        return ~F.coalesce(near, x.isNull() & y.isNull())

    differ = F.filter(F.array(*(F.when(apart(i), F.lit(v)) for i, v in enumerate(values))), lambda c: c.isNotNull())
    status = F.when(F.col("__nb").isNull(), "only in the first").when(F.col("__na").isNull(), "only in the second").when((F.col("__na") > 1) | (F.col("__nb") > 1), "repeated").when(F.size(differ) > 0, "differs").otherwise("agrees")
    return j.select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), status.alias("status"), F.when(status == "differs", F.array_join(differ, ",")).otherwise("").alias("columns"))


def joined_once(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right, one row for one; raises ValueError where a key is repeated on either side. Null keys meet nothing."""
    for name, d in (("left", left), ("right", right)):
        many = d.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))).groupBy(*keys).count().where("count > 1").limit(3).collect()
        if many:
            raise ValueError(f"keys are repeated on the {name}: {[tuple(r)[:-1] for r in many]}")
    return left.join(right, keys, "left")


def spread_sample(spark: SparkSession, path: str, files: int, every: int = 1) -> DataFrame:
    """Rows of ``files`` of a table's files at even places of their order, and of each of these every ``every``-th row: the same rows on every run. Other
    files are not read beyond their footers; nothing is sorted or shuffled."""
    names = sorted(r["file"] for r in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct().collect())  # a row per file
    if len(names) > files:
        names = [names[round(j * (len(names) - 1) / max(1, files - 1))] for j in range(files)]
    d = spark.read.option("basePath", path).parquet(*dict.fromkeys(names))
    return d.where(F.col("_metadata.row_index") % every == 0)
