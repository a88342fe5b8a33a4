"""Time-series operators: per entity, over the last n bars of the dense grid, the current one included.

Every builder takes columns that hold no window functions themselves. All share one partitioning and order, so Spark runs any
number of them after one exchange and sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio, safe_div

ENTITY, BAR = "security_id", "bar_idx"


def _entity() -> WindowSpec:
    return Window.partitionBy(ENTITY).orderBy(BAR)


def last(n: int) -> WindowSpec:
    return _entity().rowsBetween(-(n - 1), 0)


def _at_least(x: Column, n: int, least: int, value: Column) -> Column:
    return F.when(F.count(x).over(last(n)) >= least, value)


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(_entity())


def delta(x: Column, n: int = 1) -> Column:
    return x - lag(x, n)


def pct_change(x: Column, n: int = 1) -> Column:
    return safe_div(x, lag(x, n)) - 1.0


def mean(x: Column, n: int) -> Column:
    return F.avg(x).over(last(n))


def total(x: Column, n: int) -> Column:
    return F.sum(x).over(last(n))


def maximum(x: Column, n: int) -> Column:
    return F.max(x).over(last(n))


def minimum(x: Column, n: int) -> Column:
    return F.min(x).over(last(n))


def std(x: Column, n: int) -> Column:
    return _at_least(x, n, 2, F.stddev_samp(x).over(last(n)))


def quantile(x: Column, n: int, q: float) -> Column:
    return F.percentile(x, F.lit(q)).over(last(n))


def median(x: Column, n: int) -> Column:
    return quantile(x, n, 0.5)


def skew(x: Column, n: int) -> Column:
    """Bias-corrected; 0 for a constant window."""
    k = F.count(x).over(last(n)).cast("double")
    flat = F.var_pop(x).over(last(n)) == 0
    value = F.skewness(x).over(last(n)) * F.sqrt(k * (k - 1.0)) / F.when(k > 2, k - 2.0)
    return F.when(k >= 3, F.when(flat, F.lit(0.0)).otherwise(value))


def kurt(x: Column, n: int) -> Column:
    """Bias-corrected excess; -3 for a constant window."""
    k = F.count(x).over(last(n)).cast("double")
    flat = F.var_pop(x).over(last(n)) == 0
    value = (k - 1.0) / F.when(k > 3, (k - 2.0) * (k - 3.0)) * ((k + 1.0) * F.kurtosis(x).over(last(n)) + 6.0)
    return F.when(k >= 4, F.when(flat, F.lit(-3.0)).otherwise(value))


def minmax_norm(x: Column, n: int) -> Column:
    lo = minimum(x, n)
    return safe_div(x - lo, maximum(x, n) - lo)


def zscore(x: Column, n: int) -> Column:
    return safe_div(x - mean(x, n), std(x, n))


def _pairs(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def cov(x: Column, y: Column, n: int) -> Column:
    x, y = _pairs(x, y)
    return _at_least(x, n, 2, F.covar_samp(x, y).over(last(n)))


def corr(x: Column, y: Column, n: int) -> Column:
    """Pearson over pairs that both have; NULL where either is constant (Spark's own corr raises there)."""
    x, y = _pairs(x, y)
    sx, sy = F.stddev_pop(x).over(last(n)), F.stddev_pop(y).over(last(n))
    return _at_least(x, n, 2, ratio(F.covar_pop(x, y).over(last(n)), F.when((sx > 1e-12) & (sy > 1e-12), sx * sy)))


def _slots(x: Column, n: int) -> Column:
    """The window's values, oldest first, missing ones included."""
    return F.collect_list(F.struct(x.alias("v"))).over(last(n))


def rank(x: Column, n: int) -> Column:
    """(lower + (equal + 1) / 2) / present, in (0, 1]; NULL for a missing value or fewer than n // 2 present."""
    seen = F.filter(F.transform(_slots(x, n), lambda s: s["v"]), lambda v: v.isNotNull())
    size = lambda a: F.size(a).cast("double")
    placed = size(F.filter(seen, lambda v: v < x)) + (size(F.filter(seen, lambda v: v == x)) + 1.0) / 2.0
    return F.when(x.isNotNull() & (F.size(seen) >= max(1, n // 2)), placed / size(seen))


def decay_linear(x: Column, n: int) -> Column:
    """Weights 1..n, the newest heaviest; needs n values."""
    slots = _slots(x, n)
    weighted = F.aggregate(F.transform(slots, lambda s, i: s["v"] * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return _at_least(x, n, n, weighted / (n * (n + 1) / 2.0))


def _place(x: Column, n: int, best) -> Column:
    """1-based, from the oldest slot of the window; the first of equals."""
    values = F.transform(_slots(x, n), lambda s: s["v"])
    return F.when(best(values).isNotNull(), F.array_position(values, best(values)).cast("double"))


def argmax(x: Column, n: int) -> Column:
    return _place(x, n, F.array_max)


def argmin(x: Column, n: int) -> Column:
    return _place(x, n, F.array_min)


def ema_reach(span: float, tiny: float = 1e-13) -> int:
    """Bars after which an observation's weight is below `tiny`, whatever the gaps."""
    a = 2.0 / (span + 1.0)
    rate = max(((1 - a) ** g / ((1 - a) ** g + a)) ** (1.0 / g) for g in range(1, 200))
    return max(2, math.ceil(math.log(tiny) / math.log(rate))) if 0 < rate < 1 else 2


def place(x: Column) -> Column:
    """The row's number within its entity."""
    return F.row_number().over(_entity()).cast("double")


def _present(x: Column, at: Column, n: int) -> Column:
    """The window's values that are there with their places, oldest first."""
    return F.collect_list(F.when(x.isNotNull(), F.struct(at.alias("p"), x.alias("v")))).over(last(n))


def ema_at(x: Column, at: Column, span: float) -> Column:
    """Exponentially weighted mean with alpha = 2 / (span + 1) where there is a value: the older mean decays with every bar, gaps included, and the two weights are
    scaled to one at each value. at: place(). Values beyond ema_reach() can't be seen in a double."""
    alpha = 2.0 / (span + 1.0)
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("p"))

    def step(s: Column, slot: Column) -> Column:
        w = F.pow(F.lit(1.0 - alpha), slot["p"] - s["p"])
        return F.struct(F.coalesce((w * s["y"] + alpha * slot["v"]) / (w + alpha), slot["v"]).alias("y"), slot["p"].alias("p"))

    return F.when(x.isNotNull(), F.aggregate(_present(x, at, ema_reach(span)), start, step)["y"])


def ewm_reach(span: float, tiny: float = 1e-13) -> int:
    """Bars after which a weight is below `tiny`."""
    return max(2, math.ceil(math.log(tiny) / math.log(1.0 - 2.0 / (span + 1.0)))) if span > 1 else 2


def ewm_at(x: Column, at: Column, span: float) -> Column:
    """Adjusted exponentially weighted mean where there is a value: the values' sum over the weights' sum, each weight (1 - alpha) to the bars since, alpha = 2 /
    (span + 1). Weights are of the values that are there. at: place()."""
    keep = 1.0 - 2.0 / (span + 1.0)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"), F.lit(0.0).alias("p"))

    def fold(s: Column, slot: Column) -> Column:
        w = F.pow(F.lit(keep), slot["p"] - s["p"])
        return F.struct((s["n"] * w + slot["v"]).alias("n"), (s["d"] * w + 1.0).alias("d"), slot["p"].alias("p"))

    return F.when(x.isNotNull(), F.aggregate(_present(x, at, ewm_reach(span)), start, fold, lambda s: ratio(s["n"], s["d"])))


def carry(x: Column) -> Column:
    """The last value that is there, however long ago."""
    return F.last(x, ignorenulls=True).over(_entity().rowsBetween(Window.unboundedPreceding, 0))


def mean_of_two(x: Column, n: int) -> Column:
    """Mean of the window once it has two values."""
    return _at_least(x, n, 2, F.avg(x).over(last(n)))


def zscore_of_two(x: Column, n: int) -> Column:
    """Distance to that mean over the sample deviation, which is at least a little."""
    return (x - mean_of_two(x, n)) / (std(x, n) + 1e-8)
