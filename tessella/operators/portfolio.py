"""Portfolios of a daily prediction: quantile baskets, rank weights, their profit, drawdown and turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.operators import cs
from tessella.operators.metrics import YEAR, correlation


def daily_frame(signal: DataFrame, alpha: str = "alpha", resp: str = "resp") -> DataFrame:
    """(date, security_id, pred, ret): means over a day's bars, rows with both. Predictions equal to ten places are ties, so ranks
    don't hang on the order of summation."""
    out = signal.groupBy("date", "security_id").agg(F.round(F.avg(alpha), 10).alias("pred"), F.avg(resp).alias("ret"))
    return out.filter("pred is not null and ret is not null")


def baskets(days: DataFrame, q: float = 0.2) -> DataFrame:
    """side: 1 in the top q of a day's predictions, -1 in the bottom q, else 0; at least one and at most half on each side."""
    w = Window.partitionBy("date")
    ranked = days.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy("pred", "security_id"))})
    size = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * q)), F.floor(F.col("_n") / 2))
    side = F.when(F.col("_k") <= size, -1).when(F.col("_k") > F.col("_n") - size, 1).otherwise(0)
    return ranked.withColumns({"side": side, "_size": size}).drop("_k")


def weighted(days: DataFrame, long_only: bool = False, q: float = 0.2) -> DataFrame:
    """weight: equal within a basket; long and short each sum to one half, or long to one."""
    held = baskets(days, q)
    size = F.when(F.col("_size") > 0, F.col("_size"))
    return held.withColumn("weight", F.coalesce(F.when(F.col("side") == 1, 1.0 / size).otherwise(0.0) if long_only else F.col("side") * 0.5 / size, F.lit(0.0))).drop("_n", "_size")


def rank_weighted(days: DataFrame) -> DataFrame:
    """weight: the demeaned rank over the day's sum of absolute demeaned ranks."""
    w = Window.partitionBy("date")
    ranked = days.withColumn("_r", F.row_number().over(w.orderBy("pred", "security_id")) - 1.0)
    centred = ranked.withColumn("_c", F.col("_r") - F.avg("_r").over(w))
    return centred.withColumn("weight", F.coalesce(ratio(F.col("_c"), F.sum(F.abs("_c")).over(w)), F.lit(0.0))).drop("_r", "_c")


def pnl(held: DataFrame, fee: float = 0.0) -> DataFrame:
    """(date, pnl, turnover): turnover is half the sum of weight changes against the entity's previous day; the first counts whole."""
    entity = Window.partitionBy("security_id").orderBy("date")
    moved = held.withColumn("_d", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(entity), F.lit(0.0))))
    out = moved.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"), (F.sum("_d") / 2.0).alias("turnover"))
    return out.select("date", (F.col("gross") - fee * F.col("turnover")).alias("pnl"), "turnover")


def curve(days: DataFrame) -> DataFrame:
    """Running sum, its peak and the distance below it. Days are few: one task orders them."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    summed = days.withColumn("cum", F.sum("pnl").over(w))
    return summed.withColumn("drawdown", F.col("cum") - F.max("cum").over(w))


def summary(days: DataFrame) -> DataFrame:
    sd = F.stddev_samp("pnl")
    return curve(days).agg(F.sum("pnl").alias("total"), F.coalesce(ratio(F.avg("pnl"), F.when(sd > 0, sd)) * F.sqrt(F.lit(YEAR)), F.lit(0.0)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit"), F.avg("turnover").alias("turnover"))


def split_of(date: Column, cuts: dict[str, str]) -> Column:
    """The first split whose last day, as an ISO date, is not before date; "test" after them."""
    out = F.lit("test")
    for name, last in reversed(cuts.items()):
        out = F.when(date <= F.lit(last).cast("date"), name).otherwise(out)
    return out


def split_metrics(days: DataFrame, cuts: dict[str, str]) -> DataFrame:
    """Per split: mean daily IC and rank IC, and the mean squared error."""
    ranked = days.withColumns({"_p": cs.average_rank(F.col("pred"), "date"), "_r": cs.average_rank(F.col("ret"), "date")})
    per_day = ranked.groupBy("date").agg(correlation("pred", "ret").alias("ic"), correlation("_p", "_r").alias("rank_ic"), F.sum(F.pow(F.col("pred") - F.col("ret"), 2)).alias("se"), F.count("*").alias("n"))
    return per_day.groupBy(split_of(F.col("date"), cuts).alias("split")).agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), (F.sum("se") / F.sum("n")).alias("mse"))


def spread(days: DataFrame, q: float = 0.2) -> DataFrame:
    """Per day: mean return of the top and bottom baskets, and their difference."""
    top, low = F.avg(F.when(F.col("side") == 1, F.col("ret"))), F.avg(F.when(F.col("side") == -1, F.col("ret")))
    return baskets(days, q).groupBy("date").agg(F.avg("pred").alias("pred"), F.avg("ret").alias("ret"), top.alias("top"), low.alias("bottom"), (top - low).alias("spread"))


def comparison(days: DataFrame, q: float = 0.2, least: int = 20) -> DataFrame:
    """Per day of (date, security_id, pred, ret): the means of both, their spreads between the top and bottom q of the predictions, IC and rank IC
    (0 where undefined), the profit of a book of one long and one short, and mean and spread of the predictions brought to the returns' mean and deviation over all days.

    Days of fewer than `least` entities are 0 throughout. One shuffle by day; what follows has a row a day."""
    ranked = baskets(days, q).withColumns({"_p": cs.average_rank(F.col("pred"), "date"), "_r": cs.average_rank(F.col("ret"), "date")})
    side = lambda k, c: F.avg(F.when(F.col("side") == k, F.col(c)))
    gap = lambda c: side(1, c) - side(-1, c)
    book = F.sum(ratio(F.col("side"), F.col("_size")) * F.col("ret"))  # a day of one entity has empty baskets
    made = {
        "mean_prediction": F.avg("pred"), "mean_return": F.avg("ret"), "predicted_spread": gap("pred"), "realized_spread": gap("ret"), "ic": correlation("pred", "ret"),
        "rank_ic": correlation("_p", "_r"), "pnl": book,
    }
    by_day = ranked.groupBy("date").agg(F.count("*").alias("_n"), *(v.alias(c) for c, v in made.items()))
    by_day = by_day.select("date", *(F.when(F.col("_n") >= least, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in made))
    return by_day.withColumns({"mean_prediction_aligned": _aligned("mean_prediction", "mean_return"), "predicted_spread_aligned": _aligned("predicted_spread", "realized_spread")})


def _aligned(source: str, target: str) -> Column:
    """source with the mean and sample deviation of target over all rows, which are few; target's mean where source is constant."""
    w = Window.partitionBy()
    sd = F.stddev_samp(source).over(w)
    scaled = (F.col(source) - F.avg(source).over(w)) * F.coalesce(F.stddev_samp(target).over(w), F.lit(0.0)) / sd
    return F.when(sd > 0, scaled).otherwise(0.0) + F.avg(target).over(w)
