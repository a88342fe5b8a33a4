"""Panels: bars of entities on a dense grid, with labels, restrictions and universe.

A panel has security_id, datetime, date, bar_idx (the bar's place among all bars) and double fields. Bars are aggregates, so the
raw rows shuffle once, after partial aggregation; the grid is bars x entities, and bar_idx comes from the small table of distinct
bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import clean, ratio

#: Raw fields (fixed values).
FIELDS = ("open_mid_px", "high_mid_px", "low_mid_px", "close_mid_px", "open_trade_px", "high_trade_px", "low_trade_px", "close_trade_px", "trade_count", "volume", "dvolume", "vwap")
#: Distinct bars that may be ordered in one task and broadcast: 40 years of one-minute bars.
MOST_BARS = 10_000_000
#: Rows of a task of a large grid, and rows of the files read up to which a grid is not large.
TASK, SMALL = 1 << 19, 1 << 19


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(events: DataFrame, entities: int | None = None) -> DataFrame:
    """Events as ticks: price = value + 1, size = the number k of props; entities, if given, folds the users into so many."""
    who = F.pmod("user_id", F.lit(entities)) if entities else F.col("user_id")
    size = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return events.select(who.cast("long").alias("security_id"), F.col("ts"), "event_id", (clean(F.col("value")) + 1.0).alias("price"), size.alias("size"))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def ceil_minutes(ts: Column, minutes: int) -> Column:
    """The end of ts's bar; a stamp on the boundary is its own end."""
    step = minutes * 60 * 1_000_000
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(F.ceil(micros / step).cast("long") * step).cast("timestamp_ntz")


def floor_minutes(ts: Column, minutes: int) -> Column:
    step = minutes * 60 * 1_000_000
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) - F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(step))).cast("timestamp_ntz")


def bars(ticks: DataFrame, stamp: Column) -> DataFrame:
    """OHLCV bars of ticks(security_id, ts, event_id, price, size): first and last skip missing prices; vwap is NULL without volume."""
    at = F.struct("ts", "event_id")
    priced = F.col("price").isNotNull()
    volume, dvolume = F.sum("size"), F.sum(F.col("price") * F.col("size"))
    out = ticks.withColumn("datetime", stamp).groupBy("security_id", "datetime").agg(
        F.min_by("price", F.when(priced, at)).alias("open_trade_px"), F.max("price").alias("high_trade_px"), F.min("price").alias("low_trade_px"), F.max_by("price", F.when(priced, at)).alias("close_trade_px"),
        F.count("*").cast("double").alias("trade_count"), volume.alias("volume"), dvolume.alias("dvolume"), F.when(volume > 0, ratio(dvolume, volume)).alias("vwap"),
    )
    return out.withColumn("date", F.to_date("datetime"))


def with_mid(panel: DataFrame) -> DataFrame:
    """Mid prices where the source has trades only."""
    return panel.withColumns({f"{k}_mid_px": F.col(f"{k}_trade_px") for k in ("open", "high", "low", "close")})


def bar_index(panel: DataFrame, key: str = "datetime") -> DataFrame:
    """(datetime, bar_idx) of the distinct bars; they are few, so one task orders them."""
    return panel.select(key).distinct().withColumn("bar_idx", F.row_number().over(Window.orderBy(key)).cast("long"))


def densify(panel: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Every bar for every entity, fields NULL where absent, with date and bar_idx.

    The bars are broadcast (at most MOST_BARS times 20 bytes); the grid is the size of the result, not of a product of large tables. A large grid is dealt out by
    entity in tasks of about TASK rows: entities are few bytes before they meet the bars, so by their bytes they would all be given to one task. So are both sides
    of the join, which else would have as many tasks as the session's setting says, however large the grid. source: rows that have the panel's entities and bars and
    are cheaper to read than the panel's."""
    source = panel if source is None else source
    entities, dealt = source.select("security_id").distinct(), lambda df, *keys: df
    if _rows_read(panel) > SMALL:
        tasks = max(1, -(-entities.count() * source.select("datetime").distinct().count() // TASK))
        dealt = lambda df, *keys: df.repartition(tasks, *keys)
    grid, cell = dealt(entities, "security_id").join(F.broadcast(bar_index(source))), ("security_id", "datetime")
    return dealt(dealt(grid, *cell).join(dealt(panel.drop("date"), *cell), list(cell), "left"), "security_id").withColumn("date", F.to_date("datetime"))


def _rows_read(df: DataFrame) -> int:
    """Rows of the files that df reads, from their footers."""
    files = df.inputFiles()
    return df.sparkSession.read.parquet(*files).count() if files else 0


def event_panel(spark: SparkSession, sf_dir: str, entities: int | None = None) -> DataFrame:
    """The hourly panel of events, dense."""
    ticks = event_ticks(read(spark, sf_dir, "events"), entities)
    return densify(with_mid(bars(ticks, hour_of(F.col("ts")))))


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel of line items by supplier, dense; only order-free aggregates."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    month = F.date_trunc("month", F.col("l_shipdate")).cast("timestamp_ntz")
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("security_id"), month.alias("datetime")).agg(
        F.sum("l_quantity").cast("double").alias("volume"), F.sum("l_extendedprice").cast("double").alias("dvolume"), F.max(price).cast("double").alias("high_trade_px"), F.min(price).cast("double").alias("low_trade_px"), F.count("*").cast("double").alias("trade_count")
    )
    return densify(rows.withColumn("date", F.to_date("datetime")))


def part_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel of line items by part, dense: as many entities as parts. Sums of whole numbers, counts and extremes only, so no value hangs on
    the order of its rows. resp: the change of the mean volume over three bars, three bars ahead."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    month = F.date_trunc("month", F.col("l_shipdate")).cast("timestamp_ntz")
    items = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("security_id"), month.alias("datetime"), "l_quantity", "l_extendedprice")
    source = items.select("security_id", "datetime")
    if (n := _rows_read(items)) > SMALL:  # a part has about one line item a month, so there are as many groups as rows
        items = items.repartition(-(-n // TASK), "security_id", "datetime")
    rows = items.groupBy("security_id", "datetime").agg(
        F.sum("l_quantity").cast("double").alias("volume"), F.max(price).cast("double").alias("high_trade_px"), F.min(price).cast("double").alias("low_trade_px"), F.count("*").cast("double").alias("trade_count")
    )
    dense = densify(rows.withColumn("date", F.to_date("datetime")), source)
    bars_of = Window.partitionBy("security_id").orderBy("bar_idx")
    later = F.avg("volume").over(bars_of.rowsBetween(1, 3))
    return dense.withColumn("resp", ratio(later, F.avg("volume").over(bars_of.rowsBetween(-2, 0))) - 1.0)


def with_label(panel: DataFrame, ahead: int = 24, field: str = "close_trade_px") -> DataFrame:
    """resp: the field's change over the next `ahead` bars."""
    later = F.lead(field, ahead).over(Window.partitionBy("security_id").orderBy("bar_idx"))
    return panel.withColumn("resp", ratio(later, F.col(field)) - 1.0)


def with_restriction(panel: DataFrame) -> DataFrame:
    """trading_restriction: 1 no shorts, 2 no longs, 3 neither, 0 free, dealt by a fixed rule."""
    code = F.pmod(F.col("security_id") * 7 + F.hour("datetime") * 3 + F.dayofmonth("datetime"), F.lit(11))
    return panel.withColumn("trading_restriction", F.when(code.isin(1, 2, 3), code).otherwise(0).cast("int"))


def universe(panel: DataFrame) -> DataFrame:
    """(date, security_id, eq_univ), dealt by a fixed rule."""
    return panel.select("date", "security_id").distinct().withColumn("eq_univ", F.pmod(F.col("security_id") + F.dayofmonth("date"), F.lit(10)) != 0)


def research_panel(spark: SparkSession, sf_dir: str, entities: int | None = None) -> DataFrame:
    return with_restriction(with_label(event_panel(spark, sf_dir, entities)))
