"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.sources import panel as P
from tessella.sources import tables
from tessella.streaming.bars import streaming_bars, upsert_batches


def test_cache_is_computed_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(calls) == 1


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.sql("select date'2024-01-01' + cast(id as int) as date, id, id * 2 as other from range(5)").write.parquet(str(tmp_path / "d"))
    out = tables.read_days(spark, str(tmp_path / "d"), ["2024-01-02"], ["id"])
    assert [r.id for r in out.collect()] == [1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "other" not in plan


def test_leaderboard_keeps_the_newer(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, s double")
    new = spark.createDataFrame([("a", 3.0)], "k string, s double")
    assert [tuple(r) for r in tables.merge_leaderboard(old, new, "k", "s").collect()] == [("a", 3.0), ("b", 2.0)]


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    ticks = P.event_ticks(P.read(spark, "/root/testdata/sf0.001", "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = P.bars(P.event_ticks(P.read(spark, "/root/testdata/sf0.001", "events")), P.floor_minutes(F.col("ts"), 15))
    pick = lambda df: sorted((r[0], str(r[1]), round(r[2], 6), round(r[3], 6)) for r in df.select("security_id", F.col("datetime").cast("timestamp_ntz"), "open_trade_px", "dvolume").collect())
    assert pick(spark.table("bars")) == pick(batch)


def test_upsert_is_repeatable(spark, tmp_path):
    write = upsert_batches(str(tmp_path / "t"), ["k"])
    row = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    write(row((1, 1), (2, 2)), 0)
    write(row((2, 9)), 1)
    write(row((2, 9)), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()) == [(1, 1), (2, 9)]


def test_upsert_settles_keys_within_a_batch(spark, tmp_path):
    """The greatest by order counts; the last two versions stay."""
    write = upsert_batches(str(tmp_path / "t"), ["k"], ["at"])
    row = lambda *r: spark.createDataFrame(list(r), "k long, at long, v string")
    write(row((1, 1, "a"), (1, 2, "b"), (2, 1, "c")), 0)
    write(row((1, 3, "d"), (1, 1, "e")), 1)
    write(row((3, 1, "f"), (3, 1, "f")), 2)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v2")).collect()) == [(1, 3, "d"), (2, 1, "c"), (3, 1, "f")]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v1", "v2"]


def test_missing_prices_open_no_bar(spark):
    ticks = spark.sql("select 1L security_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) ts, id event_id, if(id in (0, 3), null, cast(id as double)) price, 1.0D size from range(4)")
    r = streaming_bars(ticks).first()
    assert (r.open_trade_px, r.close_trade_px, r.trade_count) == (1.0, 2.0, 4)


def test_sinks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02", "2024-01-02 01:00:00", 2, 0.5), ("2024-01-01", "2024-01-01 01:00:00", 1, -0.5)], "date string, datetime string, security_id long, alpha double")
    tables.write_submission(rows, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("day=*")) == ["day=2024-01-01", "day=2024-01-02"]
    assert spark.read.parquet(str(tmp_path / "s")).drop("day").exceptAll(rows).count() == 0
    assert tables.file_statistics(spark, str(tmp_path / "s")).first().files == 2
    tables.write_diagnostics(rows.limit(1), {"days": rows.select("date")}, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/report")).count() == 1 and tables.read_csv(spark, str(tmp_path / "d/days"), "date string").count() == 2
    for v, n in (("a", 1), ("b", 2)):
        tables.write_documents(spark.range(n), str(tmp_path / "j"), v)
    assert tables.read_documents(spark, str(tmp_path / "j"), "id long").count() == 2 and tables.read_documents(spark, str(tmp_path / "j"), "id long", "a").count() == 1
    tables.append_json(spark.range(3), str(tmp_path / "log"))
    tables.append_json(spark.range(3, 5), str(tmp_path / "log"))
    assert [r.id for r in tables.recent_json(spark, str(tmp_path / "log"), "id long", [F.col("id").desc()], 2).collect()] == [4, 3]
