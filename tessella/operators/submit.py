"""Submissions: the full grid of the universe, and the checks before it is handed in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import metrics


def submission(alpha: DataFrame, universe: DataFrame, stamps: list[str]) -> DataFrame:
    """date x stamps x the day's universe, alpha clipped to [-1, 1] and 0 where missing; stamps are HH:mm:ss. The stamps are a
    literal list, so the grid is an explode of the universe, not a product of tables."""
    grid = universe.filter("eq_univ").select("date", "security_id").withColumn("stamp", F.explode(F.array(*map(F.lit, stamps))))
    keyed = alpha.select("date", "security_id", F.date_format("datetime", "HH:mm:ss").alias("stamp"), "alpha")
    out = grid.join(keyed, ["date", "security_id", "stamp"], "left")
    clipped = F.coalesce(F.greatest(F.least(F.col("alpha"), F.lit(1.0)), F.lit(-1.0)), F.lit(0.0))
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), "stamp").alias("datetime"), "security_id", clipped.cast("float").alias("alpha"))


def sanity(rows: DataFrame, days: DataFrame, bars_a_day: int, universe: DataFrame | None = None, stamps: list[str] | None = None) -> DataFrame:
    """One row of counts that a submission(date, datetime, security_id, alpha) must have at zero, and its bars per day. outside: rows of an entity that the day's universe lacks, or of
    a time that is no stamp; 0 if neither is given."""
    repeated = rows.groupBy("date", "datetime", "security_id").count().filter("count > 1").agg(F.count("*").alias("duplicates"))
    per_day = rows.groupBy("date").agg(F.countDistinct("datetime").alias("bars"))
    spans = per_day.agg(F.min("bars").alias("min_bars"), F.max("bars").alias("max_bars"))
    missing = days.select(F.date_format("date", "yyyy-MM-dd").alias("date")).distinct().join(per_day, "date", "left_anti").agg(F.count("*").alias("missing_days"))
    placed = rows.withColumn("_in", F.substring("datetime", 12, 8).isin(*stamps) if stamps else F.lit(True))
    if universe is not None:
        known = universe.filter("eq_univ").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "security_id").distinct().withColumn("_known", F.lit(True))
        placed = placed.join(known, ["date", "security_id"], "left").withColumn("_in", F.col("_in") & F.coalesce("_known", F.lit(False)))
    outside = placed.agg(F.count(F.when(~F.col("_in"), 1)).alias("outside"))
    own = rows.agg(F.count("*").alias("rows"), F.count(F.when(F.abs("alpha") > 1, 1)).alias("out_of_bounds"), F.count(F.when(F.col("alpha").isNull(), 1)).alias("nulls"), (F.countDistinct("alpha") <= 1).alias("constant"))
    out = own.join(F.broadcast(repeated)).join(F.broadcast(spans)).join(F.broadcast(missing)).join(F.broadcast(outside))
    return out.withColumn("ready", (F.col("duplicates") + F.col("out_of_bounds") + F.col("nulls") + F.col("missing_days") + F.col("outside") == 0) & ~F.col("constant") & (F.col("min_bars") == bars_a_day) & (F.col("max_bars") == bars_a_day))


def compliance(signal: DataFrame, alpha: str = "alpha", bound: float = 100.0) -> DataFrame:
    """One row: shares and counts that a usable signal keeps within bounds; off_grid: rows whose minute is no quarter of an hour."""
    a = F.col(alpha)
    days = signal.groupBy("date").agg(F.count(a).alias("n")).agg(F.avg((F.col("n") > 0).cast("double")).alias("coverage"))
    one = signal.agg(
        F.count("*").alias("rows"), F.avg(a.isNull().cast("double")).alias("missing"), F.count(F.when(F.abs(a) > bound, 1)).alias("unbounded"), F.countDistinct(a).alias("distinct_values"), (F.max(F.abs(a)) / F.sum(F.abs(a))).alias("largest_share"),
        F.count(F.when(~F.minute("datetime").isin(0, 15, 30, 45), 1)).alias("off_grid"),
    )
    out = one.join(F.broadcast(days))
    return out.withColumn("compliant", (F.col("rows") > 0) & (F.col("off_grid") == 0) & (F.col("unbounded") == 0) & (F.col("distinct_values") > 1) & (F.col("coverage") > 0.95) & (F.col("missing") < 0.5) & (F.col("largest_share") < 0.1))


def read_exports(spark: SparkSession, *paths: str, run: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """All stored submissions below the paths in one scan, with run_id by `run` from each file's path: its folder, unless told otherwise."""
    rows = spark.read.option("recursiveFileLookup", "true").schema("date string, datetime string, security_id long, alpha float").parquet(*paths)
    return rows.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), run, 1))


def recheck(exports: DataFrame, panel: DataFrame) -> DataFrame:
    """(run_id, ic, ir, tvr, unconcentrated, passes, score) of many stored submissions(run_id, datetime, security_id, alpha) against a panel's labels and restrictions, all in
    one pass: rows meet by stamp and entity, what follows is grouped by run. A submission has the day's universe at each of its stamps."""
    alpha = exports.select("run_id", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "security_id", F.col("alpha").cast("double").alias("alpha"))
    labels = panel.select("date", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "bar_idx", "security_id", "resp", "trading_restriction")
    return metrics.evaluate(alpha.join(labels, ["datetime", "security_id"]), by=["run_id"])


def updated(library: DataFrame, found: DataFrame) -> DataFrame:
    """library(run_id, passes, score, ...) after a recheck: runs get their new figures and the status ok; those whose submission is gone pass no more and get the status
    recompute_error; new runs are added. Other columns of the library stay."""
    new = found.select("run_id", *(F.col(c).alias(f"_{c}") for c in ("ic", "ir", "tvr", "passes", "score")), F.lit(True).alias("_seen"))
    both = library.join(new, "run_id", "full")
    seen = F.coalesce("_seen", F.lit(False))
    out = both.withColumns({"passes": F.when(seen, F.col("_passes")).otherwise(False), "score": F.when(seen, F.col("_score")).otherwise(0.0), "status": F.when(seen, "ok").otherwise("recompute_error"), **{c: F.col(f"_{c}") for c in ("ic", "ir", "tvr")}})
    return out.drop("_ic", "_ir", "_tvr", "_passes", "_score", "_seen")
