"""The folder that driver and executors share, and sinks with a contract."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a temporary folder, but only if driver and executors are one process (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="courtside-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "rows", keep: list[str] | None = None, compression: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """The same rows as a table in the shared folder: cut from their lineage, and safe from lost executors. Unlike a
    checkpoint it carries no constraints over to the next plan, which would grow with each step of a fit.
    keep: gets the table's path, for discard(). group_rows: of a row group, for large rows: readers hold a group whole, and the writer bounds it by compressed bytes alone (128 MB)."""
    path = fresh_path(df.sparkSession, name)
    out = df.write.option("compression", compression)
    (out.option("parquet.block.row.count.limit", group_rows) if group_rows else out).parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs within gives Python workers at most so many rows at once (for large rows: Spark itself gathers 64 MB, and worker and JVM each hold them)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def folder(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a folder on any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written() tables that no later plan reads."""
    for path in paths:
        fs, at = folder(spark, path)
        fs.delete(at, True)
    paths.clear()


def upserted(old: DataFrame, new: DataFrame, keys: list[str], newest: list) -> DataFrame:
    """old with new's rows in place of those of the same keys; of several new rows of a key the first by `newest` counts."""
    new = newest_by_key(new, keys, newest)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def quarantined(rows: DataFrame, reason: F.Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad with its reason): nothing is dropped silently."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def read_lenient(spark: SparkSession, path: str, schema: str, kind: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt lines) of JSON or CSV files with an explicit schema; each with its file. Files are parsed once, into the shared folder."""
    reader = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
    df = reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)
    df = written(df.withColumn("file", F.col("_metadata.file_path")), "parsed")
    return df.where("_corrupt is null").drop("_corrupt"), df.where("_corrupt is not null").select("_corrupt", "file")


def newest_by_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def load_days(table_path: str, rows: DataFrame, day: str, volatile: int = 3) -> int:
    """Loads rows into a table with a folder for each day, of which only the newest days can still change; how many days were written.

    Days of `rows` from `volatile` before the newest day (of the table and the rows) on replace what the table has of them; older days that the table has are
    final and stay as they are; older days that it hasn't are new and are loaded. Rows hold each such day as a whole, as a source fetched
    again gives it. Only folders of days that are written change, all at once when the job is done, so a run that fails leaves the table as it was and
    a run that is repeated changes nothing.
    """
    spark = rows.sparkSession
    fs, at = folder(spark, table_path)
    there = spark.read.parquet(table_path).select(day).distinct() if fs.exists(at) else None
    batch = rows.agg(F.max(day)).first()[0]
    if batch is None:
        return 0
    newest = max(batch, there.agg(F.max(day)).first()[0]) if there is not None else batch
    fresh = rows.where(F.col(day) >= F.date_sub(F.lit(newest), volatile))
    if there is not None:  # days of the table: a row a day
        old = rows.where(F.col(day) < F.date_sub(F.lit(newest), volatile)).join(F.broadcast(there), day, "left_anti")
        fresh = fresh.unionByName(old)
    else:
        fresh = rows
    days = Observation()
    out = fresh.repartition(day, F.pmod(F.xxhash64(*(c for c in rows.columns if c != day)), F.lit(8)))  # a day is up to eight files
    out.observe(days, F.collect_set(day).alias("days")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(table_path)
    return len(days.get["days"])


def written_with_counts(tables: dict[str, tuple[DataFrame, str]], path: str) -> DataFrame:
    """Writes tables (rows and their key column) below path; a row for each: what, n, missing (keys), taken while it was written, without another scan."""
    spark, out = next(iter(tables.values()))[0].sparkSession, []
    for name, (rows, key) in tables.items():
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("missing")).write.parquet(f"{path}/{name}")
        out.append((name, seen.get["n"], seen.get["missing"]))
    return spark.createDataFrame(out, "what string, n long, missing long")
