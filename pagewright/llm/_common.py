"""What the operators of this subpackage share: tables, cut lineage and gapless ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and the master is local (tests), a new local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    kept = getattr(spark, "_pagewright_shared", None)
    if kept is None:
        kept = spark._pagewright_shared = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    return kept


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    The files outlive executors. They go with release(), or when the driver ends. While df is made, Python workers get BATCH_ROWS rows at a
    time, as rows may be long texts; the session's own setting comes back after.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/pagewright/{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(where)
    finally:
        spark.conf.set(BATCH, before)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._pagewright_table = where
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files of tables that stash() gave. Nothing that is still to be computed may read them; other frames are left alone."""
    for df in tables:
        if (where := getattr(df, "_pagewright_table", None)) is not None:
            _delete(df.sparkSession, where)


#: Keys that hold more than this part of the rows count as hot; there can be no more of them than its inverse.
HOT_PARTS = 4096


def join_hot(rows: DataFrame, keys: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with keys on `key`, with no task that holds a hot key's rows. how: inner or left.

    keys holds a key once, and in `n` how many of rows have it. The hot ones, HOT_PARTS at most by what hot means, are broadcast,
    so their rows stay where they are; all others are joined by a shuffle, in which no key has more than a HOT_PARTS-th of the rows.
    Both tables are read twice: pass stashed ones.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_PARTS > total
    few = F.broadcast(keys.where(hot))
    rest = rows.join(F.broadcast(keys.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(keys.where(~hot), key, how))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, keys: list[str], order: list[str], spread: Column, out: str, buckets: int) -> DataFrame:
    """Add `out`: a gapless rank from 0 within keys, with no task that holds a whole key.

    Rows go to `buckets` by `spread`, a column of integers; they rank within (keys, bucket) in
    `order`, and the buckets' counts, summed up before, shift them. The counts are
    keys x buckets rows. `order` has to tell any two rows of a bucket apart.
    """
    b = "_bucket"
    rows = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, b, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(*keys, b).orderBy(*order)
    placed = rows.withColumn("_r", F.row_number().over(inner))
    return placed.join(shifts, [*keys, b]).withColumn(out, F.col("_shift") + F.col("_r") - 1).drop("_shift", "_r", b)


def rank_buckets(n_rows: int, per_bucket: int = 20_000) -> int:
    """Buckets for ranked() that keep each near per_bucket rows, at 16 at least."""
    return max(16, -(-n_rows // per_bucket))
