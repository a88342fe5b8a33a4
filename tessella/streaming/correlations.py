"""Correlations of signals as they arrive: only pairs with a new signal are computed, against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.operators.metrics import correlation

#: Common rows below which a pair has no correlation (a fixed value).
LEAST = 200
SCHEMA = "signal string, date date, security_id long, z double"


def z_scores(rows: DataFrame) -> DataFrame:
    """rows(signal, date, security_id, alpha) -> (signal, date, security_id, z): deviations from the signal's day, in its sample deviations; rows without one go."""
    w = Window.partitionBy("signal", "date")
    z = ratio(F.col("alpha") - F.avg("alpha").over(w), F.stddev_samp("alpha").over(w))
    return rows.select("signal", "date", "security_id", z.alias("z")).filter("z is not null")


def _correlated(pairs: DataFrame, least: int) -> DataFrame:
    """Of rows(a, b, x, y) the pairs' correlations."""
    found = pairs.groupBy("a", "b").agg(correlation("x", "y").alias("corr"), F.count("*").alias("n"))
    return found.withColumn("corr", F.when(F.col("n") >= least, F.col("corr")))


def new_pairs(new: DataFrame, known: DataFrame, least: int = LEAST) -> DataFrame:
    """(a, b, corr, n), a < b, for each pair of new signals and of a new with a known one, over the rows that both have; corr is NULL below `least` of these. Both
    sides are z_scores(); their rows meet by date and entity, so a key has as many rows as there are signals."""
    every = new.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)))
    met = new.alias("x").join(every.alias("y"), (F.col("x.date") == F.col("y.date")) & (F.col("x.security_id") == F.col("y.security_id")) & (F.col("x.signal") != F.col("y.signal")) & (~F.col("y._new") | (F.col("x.signal") < F.col("y.signal"))))
    rows = met.select(F.least("x.signal", "y.signal").alias("a"), F.greatest("x.signal", "y.signal").alias("b"), F.col("x.z").alias("x"), F.col("y.z").alias("y"))
    return _correlated(rows, least)


def new_pairs_beside(rows: DataFrame, new: list[str], known: list[str], least: int = LEAST) -> DataFrame:
    """As new_pairs() of the z_scores() of the columns new and known of rows(date, security_id, ...), one row an entity and day. The signals of a row lie beside each other, so none is
    exchanged: the days' means and deviations are aggregated and broadcast, and pairs are made within the row."""
    names = [*new, *known]
    days = rows.groupBy(F.col("date").alias("_day")).agg(*(f(n).alias(f"_{k}_{n}") for n in names for k, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    scored = rows.filter("date is not null and security_id is not null").join(F.broadcast(days), F.col("date") == F.col("_day"))
    z = scored.select(*(ratio(F.col(n) - F.col(f"_mean_{n}"), F.col(f"_sd_{n}")).alias(n) for n in names))
    pairs = sorted({(min(a, b), max(a, b)) for a in new for b in names if a != b})
    every = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs))
    return _correlated(z.select(F.inline(every)).filter("x is not null and y is not null"), least)


def correlate_batches(target: str, least: int = LEAST):
    """A foreachBatch function for a stream of rows(signal, date, security_id, alpha), a signal's rows all in one batch. Under the folder `target` each batch writes its
    z-scores and its pairs to folders of its own and reads those of earlier batches only, so a batch that is run again gives the same.
    spark.read.parquet(f"{target}/pairs") has all pairs so far."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{target}/z")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        earlier = [f"{target}/z/{n}" for n in names if n.startswith("batch=") and int(n.removeprefix("batch=")) < batch_id]
        z_scores(batch).write.mode("overwrite").parquet(f"{target}/z/batch={batch_id}")
        new = spark.read.schema(SCHEMA).parquet(f"{target}/z/batch={batch_id}")
        known = spark.read.schema(SCHEMA).parquet(*earlier) if earlier else spark.createDataFrame([], SCHEMA)
        known = known.join(F.broadcast(new.select("signal").distinct()), "signal", "left_anti")  # a signal that comes again counts as it is now
        new_pairs(new, known, least).write.mode("overwrite").parquet(f"{target}/pairs/batch={batch_id}")

    return write


def latest_pairs(pairs: DataFrame) -> DataFrame:
    """Of each pair what its last batch says; pairs(a, b, corr, n, batch)."""
    return pairs.groupBy("a", "b").agg(F.max_by(F.struct("corr", "n"), "batch").alias("r")).select("a", "b", "r.*")
