"""Writing and reading back: part files, partitioned tables, published results, submissions; manifests and checks of what was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bookglass.functions.exprs import sum_all

#: Rows a part file holds at most.
ROWS_PER_FILE = 5_000_000
#: Ids in one bucket of a table without months.
IDS_PER_BUCKET = 5_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a folder of this machine only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_parts(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Parquet parts of bounded size; writing again replaces all of them."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def write_table(df: DataFrame, path: str, by: str | None = "month", slices: int = 8, rows_per_file: int = ROWS_PER_FILE) -> None:
    """A table partitioned by ``by`` (None: by buckets of the id), sorted by sample_id inside files. A partition is dealt over
    ``slices`` tasks by the id, so that one large month isn't one task's."""
    key = by or "id_bucket"
    d = df if by else df.withColumn(key, F.floor(F.col("sample_id") / IDS_PER_BUCKET))
    d = d.repartition(key, F.pmod(F.xxhash64("sample_id"), F.lit(slices))).sortWithinPartitions(key, "sample_id")
    d.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").partitionBy(key).parquet(path)


def publish(df: DataFrame, path: str, run_id: str) -> None:
    """Results replaced as a whole, each row stamped with the run."""
    write_parts(df.withColumn("run_id", F.lit(run_id)), path)


def _written(df: DataFrame, path: str, mode: str) -> int:
    """Rows of df, counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return seen.get["n"]


def load_in_steps(parts: list[DataFrame], path: str) -> int:
    """Parts written one by one, the first of which replaces what is there; returns the rows and raises if they don't add up."""
    want = sum(_written(part, path, "append" if i else "overwrite") for i, part in enumerate(parts))
    got = parts[0].sparkSession.read.parquet(path).count()
    if want != got:
        raise ValueError(f"{got} rows were written, not {want}")
    return got


def _manifest_rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("part string, n_rows long, source string").parquet(f"{path}/_manifest")
    except AnalysisException:  # no part is done yet
        return None


def load_resumable(parts: dict[str, DataFrame], path: str, source: str) -> tuple[int, int]:
    """(rows, parts written now) of a load that takes up where it stopped.

    Each part replaces its own folder, and only then gets a manifest row with its rows, counted while they were written, and the source's
    identity. Parts with a row are not evaluated again. Raises where the folder holds another source's parts or stale ones, or
    where what is read back has not the rows of the manifest; a half-written part has no row and is never read.
    """
    spark = next(iter(parts.values())).sparkSession
    rows = _manifest_rows(spark, path)
    done = {r["part"]: r for r in rows.collect()} if rows else {}  # a row per part
    if any(r["source"] != source for r in done.values()):
        raise ValueError("the folder holds parts of another source")
    if stale := sorted(done.keys() - parts.keys()):
        raise ValueError(f"stale parts: {', '.join(stale)}")
    left = [n for n in parts if n not in done]
    for name in left:
        n = _written(parts[name], f"{path}/part={name}", "overwrite")
        spark.createDataFrame([(name, n, source)], "part string, n_rows long, source string").coalesce(1).write.mode("append").parquet(f"{path}/_manifest")
    want, got = _manifest_rows(spark, path).agg(F.sum("n_rows")).first()[0], read_loaded(spark, path).count()
    if want != got:
        raise ValueError(f"{got} rows are there, not {want}")
    return got, len(left)


def read_loaded(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the parts that load_resumable has finished."""
    names = sorted(r["part"] for r in _manifest_rows(spark, path).select("part").collect())
    return spark.read.parquet(*(f"{path}/part={n}" for n in names))


def write_submission(predictions: DataFrame, template: DataFrame, path: str, key: str = "sample_id") -> None:
    """CSV of predictions; raises unless their keys are the template's, each once."""
    p = predictions.groupBy(key).agg(F.count("*").alias("__p"))
    t = template.groupBy(key).agg(F.count("*").alias("__t"))
    bad = p.join(t, key, "full").where((F.coalesce("__p", F.lit(0)) != 1) | (F.coalesce("__t", F.lit(0)) != 1)).count()
    if bad:
        raise ValueError(f"{bad} keys are missing, repeated or not in the template")
    predictions.write.mode("overwrite").option("header", True).csv(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(model, fold, cosine) rows of a nested JSON summary: a list of models, each with a list of folds."""
    d = spark.read.schema("models array<struct<model: string, per_fold: array<struct<fold: int, cosine: double>>>>").option("multiLine", True).json(path)
    return d.select(F.explode("models").alias("m")).select("m.model", F.explode("m.per_fold").alias("f")).select("model", "f.fold", "f.cosine")


def read_tagged_csv(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """CSV sources under one another, each row with its source's name."""
    first, *rest = [spark.read.option("header", True).schema(schema).csv(p).withColumn("kind", F.lit(k)) for k, p in paths.items()]
    for d in rest:
        first = first.unionByName(d)
    return first


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the part files below a path, hashed on the executors; part files are bounded in size."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(columns: list[str]) -> Column:
    """An aggregate that equal sets of rows share in any order: the sum of a 32-bit hash of each row's text; null is written as such."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    return F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))


def manifest(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows and fingerprint of what a table holds, per group."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), fingerprint(columns).alias("fingerprint"))


def key_faults(df: DataFrame, key: str) -> DataFrame:
    """One row: keys that are null, repeated, or missing between the least and the largest. Keys are grouped where they lie."""
    k = df.groupBy(key).agg(F.count("*").alias("n"))
    known = F.col(key).isNotNull()
    return k.agg(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"), F.count_if(known & (F.col("n") > 1)).alias("repeated"), F.coalesce(F.max(key) - F.min(key) + 1 - F.count_if(known), F.lit(0)).cast("long").alias("missing"))


def count_faults(sources: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(source, n_rows, agrees) of each source against what it should hold."""
    first, *rest = [d.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("source"), "n_rows", (F.col("n_rows") == expected[n]).alias("agrees")) for n, d in sources.items()]
    for d in rest:
        first = first.unionByName(d)
    return first


def schema_faults(df: DataFrame, required: dict[str, str]) -> list[str]:
    """What a schema lacks, has in another type, or has beyond the required columns, in order of the names."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    faults = [f"{n}: missing" for n in required.keys() - have.keys()] + [f"{n}: not required" for n in have.keys() - required.keys()]
    return sorted(faults + [f"{n}: {have[n]}, not {required[n]}" for n in required.keys() & have.keys() if have[n] != required[n]])


def all_null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """The mean share of nulls over columns, in one pass."""
    return df.agg((sum_all([F.avg(F.col(c).isNull().cast("double")) for c in columns]) / len(columns)).alias("null_share"))
