"""Checks of formulas before they run: what they may not name, as a report on one formula and as columns over a table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.dsl import formula

#: Pieces that a hand-written expression may not contain (fixed values).
FORBIDDEN = ("resp", "trading_restriction", "lead(", "future_")


def compliance(text: str) -> dict[str, tuple[bool, str]]:
    """Three checks of a formula, each with what it found: syntax, no_leakage, operators_allowed."""
    report = formula.check(text)
    found = lambda part: [e for e in report.errors if part in e]
    leaks, unknown = found("holds the future"), found("unknown function")
    return {"syntax": (report.valid, "; ".join(report.errors) or "OK"), "no_leakage": (not leaks, "; ".join(leaks) or "OK"), "operators_allowed": (not unknown, "; ".join(unknown) or "OK")}


def audit(expression: Column) -> Column:
    """An array of what an expression may not have: forbidden pieces, and delays into the future; empty if it is fine, as is a null one."""
    plain = F.lower(F.regexp_replace(F.coalesce(expression, F.lit("")), " ", ""))
    found = [F.when(F.contains(plain, F.lit(x)), F.lit(f"forbidden: {x}")) for x in FORBIDDEN]
    return F.array_compact(F.array(*found, F.when(plain.rlike(r"delay\([^)]*,-\d+"), F.lit("negative delay"))))


def parameters(params: Column) -> Column:
    """An array of the names in a map of numbers that aren't above zero."""
    return F.transform(F.array_sort(F.map_keys(F.map_filter(params, lambda _, v: v <= 0))), lambda k: F.concat(F.lit("not above zero: "), k))


def assert_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if its rows have all the key columns, none of them null, and no two the same; else raises ValueError. One aggregation by key."""
    lacks = [k for k in keys if k not in df.columns]
    if lacks:
        raise ValueError(f"no column {', '.join(lacks)}")
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    bad = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.count(F.when(null, 1)).alias("nulls"), F.count(F.when(F.col("_n") > 1, 1)).alias("repeats")).first()
    if bad.nulls or bad.repeats:
        raise ValueError(f"{bad.nulls} keys with nulls, {bad.repeats} repeated keys of {', '.join(keys)}")
    return df
