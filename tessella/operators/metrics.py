"""How well a signal predicts and what it costs: per bar, then per day, month and year, then one row of gates and score.

One aggregation by bar makes all the sums; what follows has as many rows as there are bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.llm.scratch import written
from tessella.operators import cs

#: Gates and weights of the two scoring modes (fixed values): ic and turnover are times the scale.
MODES = {
    "official": {"ic": 0.006, "ir": 2.5, "tvr": 400.0, "scale": 1.0},
    "submission": {"ic": 0.6, "ir": 2.5, "tvr": 400.0, "scale": 100.0},
}
TVR_WEIGHT, YEAR = 0.0005, 252.0


def restricted(alpha: Column, code: Column) -> Column:
    """alpha, NULL where the restriction (1: no shorts, 2: no longs, 3: neither) forbids its sign."""
    code = F.coalesce(code, F.lit(0))
    return F.when(~((code == 3) | ((code == 1) & (alpha < 0)) | ((code == 2) & (alpha > 0))) | alpha.isNull(), alpha)


def correlation(a: str, b: str) -> Column:
    """Pearson over rows where both are present; NULL where either is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), ratio(F.covar_pop(x, y), sx * sy))


def bar_ic(signal: DataFrame, alpha: str = "alpha", resp: str = "resp") -> DataFrame:
    both = F.count(F.when(F.col(alpha).isNotNull() & F.col(resp).isNotNull(), 1))
    return signal.groupBy("date", "bar_idx").agg(both.alias("n"), correlation(alpha, resp).alias("ic"))


def bar_rank_ic(signal: DataFrame, alpha: str = "alpha", resp: str = "resp") -> DataFrame:
    """Pearson of average ranks among rows where both are present."""
    pairs = signal.filter(F.col(alpha).isNotNull() & F.col(resp).isNotNull())
    ranked = cs.with_ranks(pairs, {"_a": (cs.average_rank, F.col(alpha)), "_r": (cs.average_rank, F.col(resp))})
    return ranked.groupBy("date", "bar_idx").agg(correlation("_a", "_r").alias("rank_ic"))


def daily(per_bar: DataFrame, value: str) -> DataFrame:
    return per_bar.groupBy("date").agg(F.avg(value).alias(value))


def ir(value: str) -> Column:
    """Mean over sample deviation, annualised; 0 where that is undefined."""
    sd = F.stddev_samp(value)
    return F.coalesce(F.when(sd > 0, F.avg(value) / F.when(sd > 0, sd) * F.sqrt(F.lit(YEAR))), F.lit(0.0))


def _with_present(signal: DataFrame, x: Column, keys: list[str], stored: bool = False) -> DataFrame:
    """signal with _present: whether its bar has any x. A large signal is written once, unless it is stored, as it is read to count and again, and dealt out by entity in tasks of about cs.TASK rows."""
    if cs.small(signal):
        return signal.withColumn("_present", F.count(x).over(Window.partitionBy(*keys)) > 0)
    signal = signal if stored else written(signal, "scored-rows")
    entity = [*(k for k in keys if k != "bar_idx"), "security_id"]
    return cs.with_present(signal.repartition(-(-signal.count() // cs.TASK), *entity), "_present", x, keys)


def bar_turnover(signal: DataFrame, alpha: str = "alpha", overnight: bool = True) -> DataFrame:
    """Sum of changes over sum of sizes, against the previous bar of the grid; a missing side adds nothing. Without overnight, a
    day's first bar has no changes and bars without any alpha are left out before changes are taken."""
    entity = Window.partitionBy("security_id").orderBy("bar_idx")
    if not overnight:
        signal = _with_present(signal, F.col(alpha), ["bar_idx"]).filter("_present").drop("_present")
    change = F.abs(F.col(alpha) - F.lag(alpha).over(entity))
    if not overnight:
        change = F.when(F.lag("date").over(entity) == F.col("date"), change)
    moved = signal.withColumn("_change", change)
    gross = F.coalesce(F.sum(F.abs(F.col(alpha))), F.lit(0.0))
    return moved.groupBy("date", "bar_idx").agg(ratio(F.coalesce(F.sum("_change"), F.lit(0.0)), gross).alias("tvr"))


def daily_turnover(per_bar: DataFrame) -> DataFrame:
    return per_bar.groupBy("date").agg(F.coalesce(F.sum("tvr"), F.lit(0.0)).alias("tvr"))


def book(signal: DataFrame, alpha: str = "alpha", units: float = 1e4) -> DataFrame:
    """Largest and smallest weight, overall and as the mean over days."""
    weights = signal.withColumn("_w", cs.share(F.col(alpha)) * units)
    days = weights.groupBy("date").agg(F.max("_w").alias("hi"), F.min("_w").alias("lo"))
    return days.agg(F.max("hi").alias("max_weight"), F.min("lo").alias("min_weight"), F.avg("hi").alias("avg_daily_max"), F.avg("lo").alias("avg_daily_min"))


def positions(signal: DataFrame, alpha: str = "alpha", units: float = 5000.0) -> DataFrame:
    """Mean long and short books, mean counts of longs, shorts and holdings per bar, and days."""
    a = F.col(alpha)
    bars = signal.groupBy("date", "bar_idx").agg(
        (F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0.0)) / units).alias("bl"), (F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0.0)) / units).alias("bs"),
        F.count(F.when(a > 0, 1)).alias("nl"), F.count(F.when(a < 0, 1)).alias("ns"), F.count(a).alias("nt"),
    )
    return bars.agg(*(F.avg(c).alias(c) for c in ("bl", "bs", "nl", "ns", "nt")), F.countDistinct("date").alias("nd"))


def by_month(per_day: DataFrame, value: str) -> DataFrame:
    return per_day.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.avg(value).alias(value), ir(value).alias("ir"), F.count(value).alias("n"))


def by_year(per_day: DataFrame, value: str) -> DataFrame:
    return per_day.groupBy(F.year("date").alias("year")).agg(F.avg(value).alias(value), ir(value).alias("ir"))


def rolling(per_day: DataFrame, value: str, n: int = 20, least: int = 10) -> DataFrame:
    """Mean over the last n days, once `least` are there. Days are few: one task orders them."""
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    return per_day.withColumn(f"{value}_mean", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


#: Largest weight, and mean over days of the day's largest, in ten-thousandths of a bar's book, that a signal must stay under (fixed values).
MOST_WEIGHT, MOST_DAILY = 50.0, 20.0


def unconcentrated() -> Column:
    """Of a row of book(): whether no weight, long or short, is too large."""
    c = F.col
    inside = (c("max_weight") < MOST_WEIGHT) & (F.abs("min_weight") < MOST_WEIGHT) & (c("avg_daily_max") < MOST_DAILY) & (F.abs("avg_daily_min") < MOST_DAILY)
    return F.coalesce(inside, F.lit(False))


def score(ic: Column, ir_: Column, tvr: Column, spread: Column, mode: str = "submission") -> tuple[Column, Column]:
    """(passes the gates, score): max(0, ic - 0.0005 tvr) * sqrt(ir) * 100, or 0. spread: whether the book is unconcentrated."""
    g = MODES[mode]
    passes = F.coalesce((ic > g["ic"]) & (ir_ > g["ir"]) & (tvr < g["tvr"]) & spread, F.lit(False))
    value = F.greatest(ic - TVR_WEIGHT * tvr, F.lit(0.0)) * F.sqrt(F.greatest(ir_, F.lit(0.0))) * 100.0
    return passes, F.when(passes, value).otherwise(0.0)


def at_stamps(signal: DataFrame, stamps: list[str]) -> DataFrame:
    """The bars at these times of day ("HH:mm:ss")."""
    return signal.filter(F.date_format("datetime", "HH:mm:ss").isin(*stamps))


def evaluate(signal: DataFrame, alpha: str = "alpha", mode: str = "submission", stamps: list[str] | None = None, by: list[str] | None = None, resp: str = "resp", units: float = 1e4, stored: bool = False) -> DataFrame:
    """One row (for each value of `by`, if given): ic, ir, tvr, unconcentrated, passes, score. official takes ic of the restricted alpha, turnover and
    book of the raw one; submission takes all of the restricted alpha, ic and turnover times 100, leaves overnight changes out, and looks at the
    bars at `stamps` only, if given: before anything else, so that changes are from stamp to stamp.

    The panel is shuffled once for the changes and once, as sums, by bar; days and the result follow from those. stored: whether signal comes from a table, so that it may be read twice."""
    by, scale = by or [], MODES[mode]["scale"]
    if stamps:
        signal = at_stamps(signal, stamps)
    ok = signal.withColumn("_ok", restricted(F.col(alpha), F.col("trading_restriction")))
    held, entity = F.col("_ok" if mode == "submission" else alpha), Window.partitionBy(*by, "security_id").orderBy("bar_idx")
    if mode == "submission":  # bars without any alpha are left out before changes are taken
        ok = _with_present(ok.select(*by, "date", "bar_idx", "security_id", resp, "_ok"), F.col("_ok"), [*by, "bar_idx"], stored)
        ok = ok.withColumn("_before", F.when(F.col("_present"), F.struct("date", "_ok"))).withColumn("_last", F.last("_before", ignorenulls=True).over(entity.rowsBetween(Window.unboundedPreceding, -1)))
        change = F.when(F.col("_present") & (F.col("_last.date") == F.col("date")), F.abs(held - F.col("_last._ok")))
    else:
        change = F.abs(held - F.lag(held).over(entity))
    gross = F.sum(F.abs(held))
    bars = ok.withColumn("_change", change).groupBy(*by, "date", "bar_idx").agg(
        correlation("_ok", resp).alias("ic"), ratio(F.coalesce(F.sum("_change"), F.lit(0.0)), gross).alias("tvr"), (ratio(F.max(held), gross) * units).alias("hi"), (ratio(F.min(held), gross) * units).alias("lo"),
    )
    days = bars.groupBy(*by, "date").agg(F.avg("ic").alias("ic"), F.coalesce(F.sum("tvr"), F.lit(0.0)).alias("tvr"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    most = (F.max("hi").alias("max_weight"), F.min("lo").alias("min_weight"), F.avg("hi").alias("avg_daily_max"), F.avg("lo").alias("avg_daily_min"))
    one = days.groupBy(*by).agg((F.avg("ic") * scale).alias("ic"), ir("ic").alias("ir"), (F.avg("tvr") * scale).alias("tvr"), *most).withColumn("unconcentrated", unconcentrated())
    passes, value = score(F.col("ic"), F.col("ir"), F.col("tvr"), F.col("unconcentrated"), mode)
    return one.select(*by, "ic", "ir", "tvr", "unconcentrated", passes.alias("passes"), value.alias("score"))


def guarded_ic(signal: DataFrame, alpha: str = "alpha", resp: str = "resp", least: int = 20) -> DataFrame:
    """Per day: the mean of 100 times the IC of the restricted alpha over the bars with `least` pairs or more."""
    ok = signal.withColumn("_ok", restricted(F.col(alpha), F.col("trading_restriction")))
    bars = bar_ic(ok, "_ok", resp).filter((F.col("n") >= least) & F.col("ic").isNotNull())
    return bars.groupBy("date").agg((F.avg("ic") * 100.0).alias("ic"))


def monthly_state(signal: DataFrame, alpha: str = "alpha", resp: str = "resp") -> DataFrame:
    """Per month: mean daily IC, the market's mean return and mean size of it, in per cent, and its volatility over the 0.9 quantile of all
    months' volatilities. Months are few: one task has their quantile."""
    bars = signal.groupBy("date", "bar_idx").agg(correlation(alpha, resp).alias("ic"), F.avg(resp).alias("market"), F.stddev_samp(resp).alias("vol"))
    days = bars.groupBy("date").agg(F.avg("ic").alias("ic"), F.avg("market").alias("market"), F.avg("vol").alias("vol"))
    months = days.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.avg("ic").alias("ic"), (F.avg("market") * 100).alias("market_ret"), F.avg("vol").alias("vol"), (F.avg(F.abs("market")) * 100).alias("market_abs_move"))
    top = F.percentile("vol", F.lit(0.9)).over(Window.partitionBy())
    return months.select("month", "ic", "market_ret", (F.col("vol") / (top + 1e-9)).alias("market_vol"), "market_abs_move")
