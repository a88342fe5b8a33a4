"""Cross-sectional operators: per bar, over entities. Builders take columns without window functions; one exchange serves all.

Ranks of large tables are added by with_ranks(), which cuts a bar into ranges of values, so that no task holds a bar, and takes some bars after the other, so that
what is shuffled at a time does not follow the table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.functions.scalar import EPS, ratio
from tessella.llm.scratch import discard, folder_of, written, written_by, written_parts

BAR = "bar_idx"
#: Values of a bar in a range, rows of a task, and rows of the files read up to which bars are ranked whole.
RANGE, TASK, SMALL = 1 << 17, 1 << 19, 1 << 19
#: Rows read for a slice of bars that is ranked at a time, and steps that may be broadcast.
SLICE, MOST_STEPS = 1 << 23, 1 << 20
#: Steps of the scale in a doubling of a value, what lifts all of them above zero, and parts over which rows that need no order are dealt.
STEPS, LIFT, DEALT = 256, 300_000, 1024


def bar(key: str = BAR) -> WindowSpec:
    return Window.partitionBy(key)


def _sorted(x: Column, key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(x.asc_nulls_last())


def average_rank(x: Column, key: str = BAR) -> Column:
    """1-based ranks, ties averaged; NULL stays unranked (nulls are put last, so they don't move the others). Rows below and rows up to x are counted by one window."""
    upto = F.count(x).over(_sorted(x, key))  # ties included
    return F.when(x.isNotNull(), (F.rank().over(_sorted(x, key)) + upto) / 2.0)


def present(x: Column, key: str = BAR) -> Column:
    """Values in the bar, counted by the window of average_rank()."""
    return F.count(x).over(_sorted(x, key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def rank(x: Column, key: str = BAR) -> Column:
    """(average rank - 1) / (n - 1), in [0, 1]; NULL where only one value is present."""
    n = present(x, key)
    return (average_rank(x, key) - 1.0) / F.when(n > 1, n - 1)


def pct_rank_centred(x: Column, key: str = BAR) -> Column:
    return average_rank(x, key) / present(x, key) - 0.5


#: What a rank makes of the average rank and the number of values present.
RANKS: dict[Callable, Callable[[Column, Column], Column]] = {rank: lambda r, n: (r - 1.0) / F.when(n > 1, n - 1), pct_rank_centred: lambda r, n: r / n - 0.5, average_rank: lambda r, n: r}


def with_ranks(df: DataFrame, given: dict[str, tuple[Callable, Column]], key: str = BAR, only: Column | None = None, used: list[DataFrame] | None = None) -> DataFrame:
    """df with a column for each (rank, pct_rank_centred or average_rank, x). Bars are ranked whole if few rows were read for them: entities are never more than these.
    only: the rows wanted back, among all of their bar; the others are ranked along, but nothing else of them is kept. A large result is a table, which is added to used."""
    rows = rows_read(df)
    if rows <= SMALL:
        out = df.withColumns({name: how(x, key) for name, (how, x) in given.items()})
        return out if only is None else out.filter(only)
    out = ranked_in_slices(df, given, key, only, rows)
    if used is not None:
        used.append(out)
    return out


def rows_read(df: DataFrame) -> int:
    """Rows of the files that df reads, from their footers, or of df if it reads none."""
    files = df.inputFiles()
    return (df.sparkSession.read.parquet(*files) if files else df).count()


def small(df: DataFrame) -> bool:
    """Whether so few rows are read for df that a task may hold a bar of it."""
    return rows_read(df) <= SMALL


def entity(df: DataFrame) -> Column:
    """What tells entities apart, whatever their span."""
    return F.col("security_id.id") if dict(df.dtypes).get("security_id", "").startswith("struct") else F.col("security_id") if "security_id" in df.columns else F.lit(0)


def with_present(df: DataFrame, name: str, x: Column, keys: list[str]) -> DataFrame:
    """df with whether x has a value in the row's bar. Values are counted by aggregation, and the bars without any are broadcast: no task holds a bar, but df is read twice."""
    absent = df.groupBy(*keys).agg(F.count(x).alias("_n")).filter("_n = 0").select(*(F.col(k).alias(f"_absent_{k}") for k in keys), F.lit(True).alias("_absent"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_absent_{k}")) for k in keys])
    return df.join(F.broadcast(absent), same, "left").withColumn(name, F.col("_absent").isNull()).drop("_absent", *(f"_absent_{k}" for k in keys))


def _scale(x: Column) -> Column:
    """A whole number that never falls as x grows."""
    size = lambda v: F.floor(F.log2(v) * STEPS) + LIFT
    endless = F.abs(x) == float("inf")
    return F.when(F.isnan(x), F.lit(1 << 30)).when(endless, F.when(x > 0, 1 << 29).otherwise(-(1 << 29))).when(x > 0, size(x)).when(x < 0, -size(-x)).when(x == 0, F.lit(0)).cast("long")


def _with_values(df: DataFrame, given: dict[str, tuple[Callable, Column]]) -> DataFrame:
    return df.withColumns({f"_x{k}": x.cast("double") for k, (_, x) in enumerate(given.values())})


def ranked(df: DataFrame, given: dict[str, tuple[Callable, Column]], key: str = BAR, most: int = RANGE, task: int = TASK) -> DataFrame:
    """As with_ranks(), by ranges of values. The table is written once, as it is read to count and to rank."""
    return _ranked(written(_with_values(df, given), "rank-values"), given, key, most, task)[0]


def ranked_in_slices(df: DataFrame, given: dict[str, tuple[Callable, Column]], key: str, only: Column | None, rows: int) -> DataFrame:
    """As with_ranks(), by ranges of values, a slice of bars after the other; rows are those read for df. The rows with what is ranked are written once, by slices, which go once they are ranked."""
    slices = max(1, math.ceil(rows / SLICE))
    valued = _with_values(df, given).withColumn("_only", F.lit(True) if only is None else F.coalesce(only, F.lit(False)))
    if only is not None:
        xs = [f"_x{k}" for k in range(len(given))]
        bare = {c: F.when(F.col("_only"), F.col(f"`{c}`")).alias(c) for c in df.columns if c not in (key, "security_id")}
        valued = valued.filter(F.col("_only") | F.coalesce(*xs).isNotNull()).select(*(bare.get(c, F.col(f"`{c}`")) for c in valued.columns))
    held = written_by(valued.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")), "rank-values", entity(df), rows, "_slice")

    def parts() -> Iterator[DataFrame]:
        for k in range(slices):
            part = folder_of(held, "_slice", k)
            if part is not None:
                out, used = _ranked(part, given, key, RANGE, TASK, True)
                yield out.filter("_only").drop("_only")
                discard(part, *used)

    schema = StructType([*(f for f in df.schema if f.name not in given), *(StructField(name, DoubleType()) for name in given)])
    out = written_parts(df.sparkSession, "ranked", schema, parts())
    discard(held)
    return out


def _ranked(df: DataFrame, given: dict[str, tuple[Callable, Column]], key: str, most: int, task: int, look_up: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """(df, which has the values of given as _x0, _x1, ..., with their ranks in place of them; the tables that it reads).

    The values of each bar are counted by steps of a scale, and neighbouring steps make ranges of about `most` values. A rank is the number of values below the
    range and the rank within it. A step of many equal values is a range of its own that needs no order: its rows are dealt out, and so are those without a value.
    Each rank has its own exchange, so a task sorts once, about `task` rows. Different values of one step (within 1 / STEPS of a doubling) stay together.
    look_up: where all steps have one value each, and are few, a rank is looked up by bar and step, without an exchange."""
    columns = [c for c in df.columns if c not in {f"_x{k}" for k in range(len(given))}]
    values = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_x{k}").alias("x")) for k in range(len(given))))
    tall = df.select(F.col(key).alias("_bar"), F.inline(values)).withColumn("s", _scale(F.col("x")))
    counted = written(tall.groupBy("k", "_bar", "s").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "rank-counts")
    rows = counted.filter("k = 0").agg(F.sum("n")).first()[0] or 0
    along = Window.partitionBy("k", "_bar").orderBy("s")
    steps = counted.filter("s is not null").withColumns({
        "below": F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("k", "_bar")), "equal": (F.col("lo") == F.col("hi")) & (F.col("n") * 4 > most),
    })
    at = F.floor(F.col("below") / most)
    begins = F.col("equal") | F.coalesce(F.lag("equal").over(along), F.lit(True)) | (at != F.lag(at).over(along))
    ranges = steps.withColumn("_begins", begins).withColumn("part", F.sum(F.col("_begins").cast("long")).over(along))
    plain = counted.filter("s is not null").groupBy("k").agg(F.count("*").alias("steps"), F.min((F.col("lo") == F.col("hi")).cast("int")).alias("one")) if look_up else None
    single = [r.k for r in plain.collect() if r.one and r.steps <= MOST_STEPS] if look_up else []  # a row a rank
    ranges = ranges.filter(~F.col("k").isin(single)).groupBy("k", "_bar", "part", "total").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.min("below").alias("below"), F.sum("n").alias("size"), F.max("equal").alias("equal"))
    used = [ranges := written(ranges, "rank-ranges")]
    if single:
        used.append(looked := written(steps.filter(F.col("k").isin(single)).select("k", "_bar", "s", (F.col("below") + (F.col("n") + 1) / 2.0).alias("place"), "total"), "rank-steps"))
    discard(counted)
    tasks = max(1, math.ceil(rows / task), min(df.sparkSession.sparkContext.defaultParallelism, 8 * rows // task))  # of few rows, as many as there are cores
    who = ["security_id"] if "security_id" in columns else columns
    for k, (name, (how, _)) in enumerate(given.items()):
        x = F.col(f"_x{k}")
        table = looked if k in single else ranges
        own = F.broadcast(table.filter(F.col("k") == k).select(*(F.col(c).alias(f"_of_{c}") for c in table.columns)))  # names that df won't have
        of, same = lambda c: F.col(f"_of_{c}"), F.col(key).eqNullSafe(F.col("_of__bar"))
        if k in single:
            done = df.join(own, same & (_scale(x) == of("s")), "left").withColumn(name, RANKS[how](of("place"), of("total")))
            df = done.select(*(F.col(f"`{c}`") for c in df.columns if c not in (name, f"_x{k}")), name)
            continue
        met = df.withColumn("_s", _scale(x)).join(own, same & F.col("_s").between(of("first"), of("last")), "left")
        ordered = of("part").isNotNull() & ~of("equal")
        dealt = met.withColumn("_dealt", F.when(ordered, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in who)), F.lit(DEALT))).cast("int"))
        window = Window.partitionBy(key, "_of_part", "_dealt").orderBy(x)
        within = (F.rank().over(window) + F.count(x).over(window)) / 2.0
        place = F.when(of("equal"), of("below") + (of("size") + 1) / 2.0).when(ordered, of("below") + within)
        done = dealt.repartition(tasks, key, "_of_part", "_dealt").withColumn("_place", place).withColumn(name, RANKS[how](F.col("_place"), of("total")))
        df = done.select(*(F.col(f"`{c}`") for c in df.columns if c not in (name, f"_x{k}")), name)
    return df, used


def demean(x: Column, key: str = BAR) -> Column:
    return x - F.avg(x).over(bar(key))


def zscore(x: Column, key: str = BAR) -> Column:
    return demean(x, key) / (F.stddev_pop(x).over(bar(key)) + EPS)


def zclip(x: Column, key: str = BAR) -> Column:
    """Sample z-score, clipped to three and divided by it."""
    z = ratio(demean(x, key), F.stddev_samp(x).over(bar(key)))
    return F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(3.0)), F.lit(-3.0)) / 3.0)


def percentile(x: Column, q: float, key: str = BAR) -> Column:
    return F.percentile(x, F.lit(q)).over(bar(key))


def winsorize(x: Column, p: float = 0.01, key: str = BAR) -> Column:
    lo, hi = percentile(x, p, key), percentile(x, 1.0 - p, key)
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def quantile(x: Column, q: float = 0.5, key: str = BAR) -> Column:
    return x - percentile(x, q, key)


def share(x: Column, key: str = BAR) -> Column:
    """x over the bar's sum of absolute values; NULL if that is zero."""
    return ratio(x, F.sum(F.abs(x)).over(bar(key)))


def weight_cap(x: Column, most: float, key: str = BAR) -> Column:
    w = share(x, key)
    return F.when(w < -most, F.lit(-most)).when(w > most, F.lit(most)).otherwise(w)


def extremes(x: Column, q: float, key: str = BAR) -> Column:
    """x in the bottom and top q of the bar, else zero."""
    return F.when((x <= percentile(x, q, key)) | (x >= percentile(x, 1.0 - q, key)), x).when(x.isNotNull(), F.lit(0.0))
