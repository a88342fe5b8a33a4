"""Element-wise functions over double columns. NULL is the only missing value; it propagates unless a function says otherwise.

Division never raises: safe_div puts EPS for a zero denominator, ratio gives NULL. Comparisons and logic give 0.0 or 1.0, and a
missing operand counts as false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def clean(x: Column) -> Column:
    """NaN and infinities as NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def safe_div(a: Column, b: Column) -> Column:
    return a / F.when(b == 0, F.lit(EPS)).otherwise(b)


def fill_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def twelve(x: Column) -> Column:
    """Rounded to twelve places: what differs by the order of summation only becomes equal."""
    return F.round(x, 12)


def signed_power(x: Column, p: float) -> Column:
    powered = F.signum(x) * F.pow(F.abs(x), F.lit(float(p)))
    return F.when(x == 0, F.when(x.isNotNull(), F.lit(0.0 if p >= 0 else None))).otherwise(powered)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def log(x: Column) -> Column:
    return F.log1p(F.abs(x))


def sqrt(x: Column) -> Column:
    return F.sqrt(F.abs(x))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -50.0, 50.0)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def min_of(a: Column, b: Column) -> Column:
    return _both(a, b, F.least(a, b))


def max_of(a: Column, b: Column) -> Column:
    return _both(a, b, F.greatest(a, b))


def truth(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def gt(a: Column, b: Column) -> Column:
    return truth(a > b)


def ge(a: Column, b: Column) -> Column:
    return truth(a >= b)


def lt(a: Column, b: Column) -> Column:
    return truth(a < b)


def le(a: Column, b: Column) -> Column:
    return truth(a <= b)


def eq(a: Column, b: Column) -> Column:
    return truth(F.abs(a - b) <= EPS)


def holds(x: Column) -> Column:
    return F.coalesce(x > 0, F.lit(False))


def and_op(a: Column, b: Column) -> Column:
    return truth(holds(a) & holds(b))


def or_op(a: Column, b: Column) -> Column:
    return truth(holds(a) | holds(b))


def not_op(a: Column) -> Column:
    return truth(a <= 0)


def ifelse(condition: Column, a: Column, b: Column) -> Column:
    return F.when(holds(condition), a).otherwise(b)


def mean_of(*xs: Column) -> Column:
    return reduce(lambda a, b: a + b, xs) / F.lit(float(len(xs)))


def weighted_sum(weights: list[float], xs: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * x for w, x in zip(weights, xs, strict=True)])
    return total / F.lit(sum(abs(w) for w in weights) + EPS)
