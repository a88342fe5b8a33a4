"""Reading, caching and writing: dated Parquet, JSON lines, CSV leaderboards and computed caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_days(spark: SparkSession, path: str, days: list[str] | None = None, columns: list[str] | None = None, day: str = "date") -> DataFrame:
    """A Parquet table, with only the columns and the days (ISO dates) that are wanted: both reach the scan."""
    df = spark.read.parquet(path)
    if days is not None:
        df = df.filter(F.col(day).isin(*(F.lit(d).cast("date") for d in days)))
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished write is there, in whatever store Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False, by: str | None = None) -> DataFrame:
    """What is at path, computed and written first if absent or forced; by partitions the files."""
    if force or not exists(spark, path):
        writer = make().write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def recent_json(spark: SparkSession, path: str, schema: str, order: list[Column], n: int) -> DataFrame:
    """The first n records by order; lines that don't parse are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(*order).limit(n)


def merge_leaderboard(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """Both, the newer row of equal keys, numbered by descending score."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    newest = both.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_age", F.col(score).desc()))).filter("_k = 1").drop("_k", "_age")
    return newest.orderBy(F.col(score).desc(), key)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all present and finite."""
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")) for c in columns]
    for f in finite:
        df = df.filter(f)
    return df


def write_submission(rows: DataFrame, path: str, files_a_day: int = 1) -> None:
    """rows(date, datetime, security_id, alpha) as Parquet, a folder a day, each day's rows in order in files_a_day files."""
    dealt = rows.withColumn("day", F.col("date")).repartition("day") if files_a_day == 1 else rows.withColumns({"day": F.col("date"), "_file": F.pmod(F.xxhash64("security_id"), F.lit(files_a_day))}).repartition("day", "_file").drop("_file")
    dealt.sortWithinPartitions("day", "datetime", "security_id").write.mode("overwrite").partitionBy("day").parquet(path)


def write_diagnostics(report: DataFrame, series: dict[str, DataFrame], path: str) -> None:
    """A report of few rows as JSON, and each of its series as CSV beside it."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    for name, df in series.items():
        write_csv(df, f"{path}/{name}")


def write_documents(rows: DataFrame, path: str, version: str) -> None:
    """A JSON document store: each write is a version beside the others."""
    rows.write.mode("overwrite").json(f"{path}/version={version}")


def read_documents(spark: SparkSession, path: str, schema: str, version: str | None = None) -> DataFrame:
    """The documents of a version, or of the greatest there is."""
    every = spark.read.schema(f"{schema}, version string").json(path)
    latest = F.lit(version) if version is not None else every.agg(F.max("version").alias("v")).first()["v"]  # one value
    return every.filter(F.col("version") == latest).drop("version")


def file_statistics(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row: files, bytes and the newest change, from the listing alone; no file is read but for its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{fmt}").load(path).select("path", "length", "modificationTime")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modificationTime").alias("changed"))
