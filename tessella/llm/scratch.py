"""Where operators cut lineage: the folder that spark.checkpoint.dir names, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master, whose executors are this process, gets one of its own if unset."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and read again from the shared folder, whichever executors are lost later."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which a query's shuffle files go once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _run_once(spark: SparkSession) -> Iterator[None]:
    """Queries within are run once, so their shuffle files need not stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """As checkpointed(), but as compressed Parquet, for wide or large rows. discard() deletes it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _run_once(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: Rows read for a pass of written_by(), passes at most, as each may read the input anew, and rows of a task of one.
PASS, PASSES, PASS_TASK = 1 << 22, 8, 1 << 18


def written_by(df: DataFrame, name: str, key: Column, rows: int, split: str | None = None) -> DataFrame:
    """As written(), but if many rows are read for df, in passes over some of the key's values each: what one pass shuffles is gone before the next. The filter
    by key reaches the scan where windows, groups and joins are by it. split: a column by whose values the rows lie in folders of their own, for folder_of()."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    passes = min(PASSES, max(1, -(-rows // PASS)))
    with _run_once(df.sparkSession):
        for k in range(passes):
            part = df if passes == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(passes)) == k).coalesce(max(1, -(-rows // passes // PASS_TASK)))
            _append(part, path, split)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _append(df: DataFrame, path: str, split: str | None = None) -> None:
    writer = df.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(split) if split else writer).parquet(path)


def folder_of(table: DataFrame, split: str, value: int) -> DataFrame | None:
    """The rows of a table of written_by() whose `split` has the value, without that column; None if there are none. discard() deletes them."""
    spark, path = table.sparkSession, f"{table._written_to}/{split}={value}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    out = spark.read.schema(table.drop(split).schema).parquet(path)
    out._written_to = path
    return out


def written_parts(spark: SparkSession, name: str, schema: StructType, parts: Iterator[DataFrame]) -> DataFrame:
    """As written(), of the rows of all parts, one part after the other."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _append(spark.createDataFrame([], schema), path)
    for part in parts:
        with _run_once(spark):
            _append(part, path)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what written() has written, once nothing that is still to run reads it."""
    for t in tables:
        remove(t.sparkSession, t._written_to)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
