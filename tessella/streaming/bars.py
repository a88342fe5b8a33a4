"""OHLCV bars of a stream of ticks, by Structured Streaming: windows per entity, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio


def streaming_bars(ticks: DataFrame, width: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """ticks(security_id, ts timestamp, event_id, price, size) -> bars. In append mode a bar is emitted once ticks that late can't
    come any more; state per entity and open bar is a handful of numbers."""
    at = F.when(F.col("price").isNotNull(), F.struct("ts", "event_id"))  # missing prices open and close no bar
    dvolume, volume = F.sum(F.col("price") * F.col("size")), F.sum("size")
    grouped = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "security_id")
    out = grouped.agg(
        F.min_by("price", at).alias("open_trade_px"), F.max("price").alias("high_trade_px"), F.min("price").alias("low_trade_px"), F.max_by("price", at).alias("close_trade_px"),
        F.count("*").alias("trade_count"), volume.alias("volume"), dvolume.alias("dvolume"), F.when(volume > 0, ratio(dvolume, volume)).alias("vwap"),
    )
    return out.select(F.col("window.start").alias("datetime"), "security_id", *(c for c in out.columns if c not in ("window", "security_id")))


def upsert_batches(target: str, key: list[str], order: list[str] | None = None):
    """A foreachBatch function that keeps the latest row of each key in a Parquet folder: each batch writes a new version beside the
    old, so a batch that is run again gives the same; versions before the last but one are removed. Of a batch's rows of
    one key the greatest by `order` counts (then by the other columns, so that ties are settled)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(target)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        versions = sorted(int(v[1:]) for v in before if v.startswith("v") and int(v[1:]) < batch_id and fs.exists(hadoop.Path(f"{target}/{v}/_SUCCESS")))
        by = [F.col(c).desc_nulls_last() for c in [*(order or []), *(c for c in batch.columns if c not in key)]]
        rows = batch.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter("_place = 1").drop("_place")
        if versions:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/v{versions[-1]}").join(batch.select(*key).distinct(), key, "left_anti"))
        rows.write.mode("overwrite").parquet(f"{target}/v{batch_id}")
        for v in versions[:-1]:
            fs.delete(hadoop.Path(f"{target}/v{v}"), True)

    return write
