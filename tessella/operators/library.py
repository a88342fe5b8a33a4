"""Queries of a signal library: summaries, attributions, leaderboards, paging, top-k and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group is dealt into before its running lengths are taken.
SHARES = 64


def summary(rows: DataFrame, score: str, passed: Column) -> DataFrame:
    s = F.col(score)
    return rows.agg(F.count("*").alias("tested"), F.sum(passed.cast("long")).alias("passing"), F.max(s).alias("best"), F.avg(F.when(s > 0, s)).alias("avg_positive"), F.avg(passed.cast("double")).alias("pass_rate"))


def breakdown(rows: DataFrame, by: str, passed: Column) -> DataFrame:
    """Tested, passing, pass rate and share of all, per group."""
    groups = rows.groupBy(by).agg(F.count("*").alias("tested"), F.sum(passed.cast("long")).alias("passing"))
    total = groups.agg(F.sum("tested").alias("_all"))
    return groups.join(F.broadcast(total)).select(by, "tested", "passing", (F.col("passing") / F.col("tested")).alias("pass_rate"), (F.col("tested") / F.col("_all")).alias("share"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page of that number, from 0; order must end in a unique key."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def best_per_group(rows: DataFrame, group: str, order: list[Column], k: int = 1) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def diversified(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The best row of each group first, then the rest by order, up to k; order must end in a unique key.

    No group is sorted whole: the best rows come by a limit in each group, the rest from the first 2k rows of all, which hold k others unless k groups
    fill the list. A group's place within those 2k is its place in the whole table."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    others = rows.orderBy(*order).limit(2 * k).withColumn("place", place).filter("place > 1")
    listed = best_per_group(rows, group, order).unionByName(others).withColumn("_first", F.col("place") == 1)
    return listed.orderBy(F.col("_first").desc(), *order).limit(k).drop("_first", "place")


def balanced(rows: DataFrame, group: str, order: list[Column], k: int, groups: list[str]) -> DataFrame:
    """k rows with their place: of each of the groups in turn the best k // len(groups) + 1 (two at least), until k are listed; if the groups
    have too few rows, it is filled up with the best 2k rows of all groups that aren't listed yet. order must end in a unique key; groups
    without rows, null groups and an empty table are no error. As in diversified, no group is sorted whole."""
    share = max(1, k // max(1, len(groups))) + 1
    of_listed = F.col(group).isin(groups)
    turn = F.array_position(F.array(*map(F.lit, groups)).cast("array<string>"), F.col(group).cast("string"))
    first = best_per_group(rows.filter(of_listed), group, order, share).withColumns({"_fill": F.lit(0), "_turn": turn})
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    rest = rows.orderBy(*order).limit(2 * k).withColumn("place", place).filter(~F.coalesce(of_listed, F.lit(False)) | (F.col("place") > share))
    listed = first.unionByName(rest.withColumns({"place": F.lit(0), "_fill": F.lit(1), "_turn": F.lit(0).cast("long")}))
    turns = ["_fill", "_turn", "place"]
    chosen = listed.orderBy(*turns, *order).limit(k)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(*turns, *order))).drop("_fill", "_turn")  # k rows


def running_best(rows: DataFrame, bucket: Column, score: str) -> DataFrame:
    """Per step, the rows so far and the best score so far. Steps are few: one task orders them."""
    steps = rows.groupBy(bucket.alias("step")).agg(F.count("*").alias("_n"), F.max(score).alias("_best"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("step", F.sum("_n").over(w).alias("tested"), F.max("_best").over(w).alias("best"))


def downsample(curve: DataFrame, order: str, points: int) -> DataFrame:
    """At most `points` rows, evenly spaced, both ends kept; halves round to even."""
    w = Window.orderBy(order)
    placed = curve.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy())})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(float(points - 1))).cast("int"))
    return placed.filter((F.col("_n") <= points) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def insert_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with those rows of new whose key it lacks; of new rows of equal key one."""
    return table.unionByName(new.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(table.columns))


def bump(table: DataFrame, keys: DataFrame, key: str, counter: str) -> DataFrame:
    """table with counter raised by how often each key occurs in keys."""
    times = keys.groupBy(key).agg(F.count("*").alias("_by"))
    return table.join(times, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_by", F.lit(0))).drop("_by").select(table.columns)


def prune(table: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """The first `keep` rows by order."""
    return table.orderBy(*order).limit(keep)


def capped_context(rows: DataFrame, text: str, order: list[Column], most: int, by: str) -> DataFrame:
    """Per group, the rows before the first at which the running length exceeds most, with that running length; order must be total.

    A group's rows are first dealt into SHARES by a hash of the row: what comes after a row that exceeds most within its own share exceeds it in the whole group, too, and goes before
    the group meets in one task. The row that exceeds stays until then, so that the running length of later rows is not understated. Texts of no length don't add up, so they aren't cut early. Null texts have no length."""
    before = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.coalesce(F.length(text), F.lit(0)).cast("long")
    dealt = rows.withColumns({"_length": length, "_share": F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t)), F.lit(SHARES))})
    early = dealt.withColumn("_before", F.coalesce(F.sum("_length").over(before(by, "_share")), F.lit(0))).filter(F.col("_before") <= most)
    running = early.withColumn("running", F.coalesce(F.sum("_length").over(before(by)), F.lit(0)) + F.col("_length"))
    return running.filter(F.col("running") <= most).drop("_length", "_share", "_before")
