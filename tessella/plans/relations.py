"""Resampling, grids, joins and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import metrics
from tessella.plans.catalogue import PANEL, RESEARCH, add, round_sql, signal, six
from tessella.sources import panel as P

_BAR_FIELDS = ("open_trade_px", "high_trade_px", "low_trade_px", "close_trade_px", "trade_count", "volume", "dvolume", "vwap")


def _resample(right: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ticks = P.event_ticks(P.read(spark, sf_dir, "events"))
        stamp = P.ceil_minutes(F.col("ts"), 15) if right else P.floor_minutes(F.col("ts"), 15)
        return six(P.bars(ticks, stamp).select("security_id", "datetime", *_BAR_FIELDS))

    return query


def _resample_sql(stamp: str) -> str:
    return f"""WITH t AS (SELECT user_id AS security_id, ts, value + 1 AS price, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS size, {stamp} AS datetime FROM events)
SELECT security_id, datetime, {round_sql({'open_trade_px': 'arg_min(price, ts)', 'high_trade_px': 'max(price)', 'low_trade_px': 'min(price)', 'close_trade_px': 'arg_max(price, ts)', 'trade_count': 'CAST(count(*) AS DOUBLE)', 'volume': 'sum(size)', 'dvolume': 'sum(price * size)', 'vwap': 'CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) END'})} FROM t GROUP BY 1, 2"""


_FLOOR = "time_bucket(INTERVAL '15 minutes', ts)"
add("resample_left", _resample(False), _resample_sql(_FLOOR))
add("resample_right", _resample(True), _resample_sql(f"CASE WHEN {_FLOOR} = ts THEN ts ELSE {_FLOOR} + INTERVAL '15 minutes' END"))
add("densify_grid", lambda spark, d: six(P.event_panel(spark, d).select("security_id", "datetime", "date", "bar_idx", *_BAR_FIELDS)), f"WITH {PANEL} SELECT security_id, datetime, date, bar_idx, {round_sql({f: f for f in _BAR_FIELDS})} FROM p")
add("trading_days", lambda spark, d: P.read(spark, d, "events").filter((F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-21")).select(F.to_date("ts").alias("date")).distinct(), "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
add("latest_days", lambda spark, d: P.read(spark, d, "events").select(F.to_date("ts").alias("date")).distinct().orderBy(F.desc("date")).limit(10), "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events ORDER BY 1 DESC LIMIT 10")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.event_panel(spark, sf_dir).filter("trade_count is not null").agg(F.count("*").alias("rows"), F.countDistinct("security_id").alias("entities"), F.countDistinct("date").alias("days"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.round(F.count("*") / F.countDistinct("date"), 6).alias("rows_a_day"))


add("panel_summary", _summary, f"WITH {PANEL} SELECT count(*) AS rows, count(DISTINCT security_id) AS entities, count(DISTINCT date) AS days, min(datetime) AS first, max(datetime) AS last, round(count(*) / count(DISTINCT date), 6) AS rows_a_day FROM p WHERE trade_count IS NOT NULL")
_LI = """m AS (SELECT CAST(l_suppkey AS BIGINT) AS security_id, date_trunc('month', l_shipdate) AS datetime, CAST(sum(l_quantity) AS DOUBLE) AS volume, CAST(sum(l_extendedprice) AS DOUBLE) AS dvolume, CAST(max(l_extendedprice / l_quantity) AS DOUBLE) AS high_trade_px, CAST(count(*) AS DOUBLE) AS trade_count FROM lineitem GROUP BY 1, 2),
p AS (SELECT s.security_id, d.bar_idx, volume, dvolume, high_trade_px, trade_count FROM (SELECT DISTINCT security_id FROM m) s CROSS JOIN (SELECT datetime, row_number() OVER (ORDER BY datetime) AS bar_idx FROM (SELECT DISTINCT datetime FROM m)) d LEFT JOIN m USING (security_id, datetime))"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.dsl import formula

    out = formula.evaluate(P.lineitem_panel(spark, sf_dir), {"m": "ts_mean(volume, 6)", "r": "cs_rank(ts_sum(dvolume, 3))", "n": "trade_count"})
    return six(out.select("security_id", "bar_idx", "m", "r", "n"))


add("monthly_panel", _monthly, f"""WITH {_LI}, q AS (SELECT *, sum(dvolume) OVER (PARTITION BY security_id ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, avg(volume) OVER (PARTITION BY security_id ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m FROM p)
SELECT security_id, bar_idx, {round_sql({'m': 'm', 'r': '(CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY bar_idx ORDER BY s NULLS LAST) + (count(s) OVER (PARTITION BY bar_idx, s) - 1) / 2.0 END - 1) / nullif(count(s) OVER (PARTITION BY bar_idx) - 1, 0)', 'n': 'trade_count'})} FROM q""")

_UNI = "u AS (SELECT DISTINCT date, security_id, (security_id + day(date)) % 10 <> 0 AS eq_univ FROM r)"


def _universe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    inside = P.universe(s).filter("eq_univ").drop("eq_univ")
    return six(s.join(inside, ["date", "security_id"]).filter("alpha is not null").select("date", "bar_idx", "security_id", "alpha"))


add("universe_inner_join", _universe_join, f"WITH {RESEARCH}, {_UNI} SELECT r.date, bar_idx, r.security_id, round(alpha, 6) + 0.0 AS alpha FROM r JOIN u ON u.date = r.date AND u.security_id = r.security_id AND eq_univ WHERE alpha IS NOT NULL")


def _label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    label = s.groupBy("date", "security_id").agg(F.avg("resp").alias("day_resp"))
    return six(s.filter("alpha is not null").select("date", "bar_idx", "security_id", "alpha").join(label, ["date", "security_id"]))


add("label_join", _label_join, f"WITH {RESEARCH} SELECT r.date, bar_idx, r.security_id, round(alpha, 6) + 0.0 AS alpha, round(l.day_resp, 6) + 0.0 AS day_resp FROM r JOIN (SELECT date, security_id, avg(resp) AS day_resp FROM r GROUP BY 1, 2) l ON l.date = r.date AND l.security_id = r.security_id WHERE alpha IS NOT NULL")


def _restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    codes = s.filter("trading_restriction > 0").select("security_id", "bar_idx", F.col("trading_restriction").alias("code"))
    out = s.drop("trading_restriction").join(codes, ["security_id", "bar_idx"], "left")
    return six(out.select("security_id", "bar_idx", metrics.restricted(F.col("alpha"), F.col("code")).alias("alpha")).filter("alpha is not null"))


OK_SQL = "CASE WHEN NOT (trading_restriction = 3 OR (trading_restriction = 1 AND alpha < 0) OR (trading_restriction = 2 AND alpha > 0)) THEN alpha END"
add("restriction_left_join", _restricted, f"WITH {RESEARCH} SELECT security_id, bar_idx, round({OK_SQL}, 6) + 0.0 AS alpha FROM r WHERE ({OK_SQL}) IS NOT NULL")


def _outer_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    a = s.filter("alpha > 0.1").select("security_id", "bar_idx", F.col("alpha").alias("a"))
    b = s.filter("volume > 20").select("security_id", "bar_idx", (F.col("volume") / 100.0).alias("b"))
    blend = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return six(a.join(b, ["security_id", "bar_idx"], "full").withColumn("blend", blend / (F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int"))))


add("signal_outer_blend", _outer_blend, f"WITH {RESEARCH}, a AS (SELECT security_id, bar_idx, alpha AS a FROM r WHERE alpha > 0.1), bb AS (SELECT security_id, bar_idx, volume / 100.0 AS b FROM r WHERE volume > 20) SELECT security_id, bar_idx, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round((coalesce(a, 0) + coalesce(b, 0)) / (CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT)), 6) + 0.0 AS blend FROM a FULL JOIN bb USING (security_id, bar_idx)")
add("missing_days_anti", lambda spark, d: P.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().join(P.read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct(), "date", "left_anti"), "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_shipdate IS NOT NULL)")
add("duplicate_semi", lambda spark, d: P.read(spark, d, "customer").join(P.read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n")), "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas name their parents in an array; an idea's generation is one more than the latest of those that are known, or 0."""
    docs = P.read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.col("doc_id") - 7, F.col("doc_id") - 20)).when(F.col("doc_id") % 3 == 1, F.array(F.col("doc_id") + 1)).alias("parents"), F.floor(F.col("n_chars") / 1000).alias("generation"))
    born = docs.select("doc_id", F.explode("parents").alias("parent")).join(docs.select(F.col("doc_id").alias("parent"), "generation"), "parent").groupBy("doc_id").agg(F.max("generation").alias("latest"), F.count("*").alias("known"))
    return docs.select("doc_id").join(born, "doc_id", "left").select("doc_id", F.coalesce(F.col("latest") + 1, F.lit(0)).alias("generation"), F.coalesce("known", F.lit(0)).alias("known"))


add("parent_generation", _generations, """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [doc_id - 7, doc_id - 20] WHEN 1 THEN [doc_id + 1] END AS parents, n_chars // 1000 AS generation FROM documents),
b AS (SELECT x.doc_id, max(d.generation) AS latest, count(*) AS known FROM (SELECT doc_id, unnest(parents) AS parent FROM d) x JOIN d ON d.doc_id = x.parent GROUP BY 1) SELECT d.doc_id, coalesce(latest + 1, 0) AS generation, coalesce(known, 0) AS known FROM d LEFT JOIN b USING (doc_id)""")
