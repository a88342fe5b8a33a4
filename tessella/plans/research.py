"""Candidate search, market states, windows of days, and the memory of what was tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.operators import candidates as CA
from tessella.operators import metrics as M
from tessella.plans.catalogue import PANEL, RANK, RESEARCH, add, round_sql, signal, six
from tessella.plans.evaluation import IR, corr_sql
from tessella.sources import panel as P
from tessella.sources.panel import read

add("family_search", lambda spark, d: six(CA.search(P.research_panel(spark, d), CA.members())))
_TWO = {"reversal": ("0 - ts_pct_change(close_trade_px, {n})", (1,)), "volume": ("ts_mean(volume, {n})", (3,))}
_X = {"reversal__1": "-(close_trade_px / nullif(lag(close_trade_px, 1) OVER e, 0) - 1)", "volume__3": "avg(volume) OVER (PARTITION BY security_id ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"}


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(CA.search(P.research_panel(spark, sf_dir), CA.members(_TWO)))


_FAM = f"""{PANEL}, fx AS (SELECT *, lead(close_trade_px, 24) OVER e / nullif(close_trade_px, 0) - 1 AS resp, {', '.join(f'{x} AS {n}' for n, x in _X.items())} FROM p WINDOW e AS (PARTITION BY security_id ORDER BY bar_idx)),
fr AS (SELECT date, bar_idx, resp, {', '.join(f"({RANK.format(x=n, k='bar_idx')}) / count({n}) OVER (PARTITION BY bar_idx) - 0.5 AS {n}" for n in _X)} FROM fx),
fb AS (SELECT date, bar_idx, {', '.join(f"{corr_sql(n, 'resp')} AS {n}" for n in _X)} FROM fr GROUP BY 1, 2), fd AS (SELECT date, {', '.join(f'avg({n}) AS {n}' for n in _X)} FROM fb GROUP BY 1)"""
add("family_candidates", _families, f"WITH {_FAM} " + " UNION ALL ".join(f"SELECT '{n}' AS candidate, CAST({sign} AS INT) AS sign, {round_sql({'ic': f'{sign} * avg({n})', 'ir': f'{sign} * ' + IR(n)})}, count({n}) AS days, '{n.split('__')[0]}' AS family FROM fd" for n in _X for sign in (1, -1)))


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per week: mean IC beside the market's mean return and its deviation over the 0.9 quantile of all weeks' deviations."""
    s = signal(spark, sf_dir)
    bars = s.groupBy("date", "bar_idx").agg(M.correlation("alpha", "resp").alias("ic"), F.avg("resp").alias("market"))
    weeks = bars.groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(F.avg("ic").alias("ic"), F.avg("market").alias("market"), F.stddev_samp("market").alias("vol"))
    top = weeks.agg(F.percentile("vol", F.lit(0.9)).alias("top"))
    return six(weeks.join(F.broadcast(top)).select("week", "ic", "market", ratio(F.col("vol"), F.col("top")).alias("vol")))


add("weekly_ic_market", _market, f"WITH {RESEARCH}, x AS (SELECT date, bar_idx, {corr_sql('alpha', 'resp')} AS ic, avg(resp) AS market FROM r GROUP BY 1, 2), w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, avg(ic) AS ic, avg(market) AS market, stddev_samp(market) AS vol FROM x GROUP BY 1) SELECT week, {round_sql({'ic': 'ic', 'market': 'market', 'vol': 'vol / (SELECT quantile_cont(vol, 0.9) FROM w)'})} FROM w")


def _windows(spark: SparkSession, sf_dir: str, train: int = 10, test: int = 5) -> DataFrame:
    """Rolling windows: every `test` days, train on the `train` days before."""
    days = read(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    numbered = days.withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)
    last = numbered.agg(F.max("k").alias("last"))
    starts = last.select(F.explode(F.expr(f"sequence({train}, last, {test})")).alias("start"))
    spans = numbered.join(F.broadcast(starts), (F.col("k") >= F.col("start") - train) & (F.col("k") < F.col("start") + test))
    part = F.when(F.col("k") < F.col("start"), "train").otherwise("test")
    return spans.groupBy("start", part.alias("part")).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"))


add("rolling_windows", _windows, "WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)), s AS (SELECT CAST(unnest(range(10, (SELECT max(k) FROM d) + 1, 5)) AS INT) AS start) SELECT start, CASE WHEN k < start THEN 'train' ELSE 'test' END AS part, min(date) AS first, max(date) AS last, count(*) AS days FROM d JOIN s ON k >= start - 10 AND k < start + 5 GROUP BY 1, 2")


def _recent(spark: SparkSession, sf_dir: str, n: int = 200) -> DataFrame:
    """Of the last n tests: how many fail for which reason."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").orderBy(F.desc("doc_id")).limit(n)
    count = lambda c: F.count(F.when(c, 1))
    bad = F.col("quality") == 0
    return docs.agg(count(bad).alias("failed"), count(bad & (F.col("n_chars") < 1000)).alias("short"), count(bad & (F.col("toxic") == 1)).alias("toxic"), count(bad & (F.col("lang") != "en")).alias("foreign"))


add("recent_failures", _recent, "WITH l AS (SELECT * FROM documents JOIN labels USING (doc_id) ORDER BY doc_id DESC LIMIT 200) SELECT count(CASE WHEN quality = 0 THEN 1 END) AS failed, count(CASE WHEN quality = 0 AND n_chars < 1000 THEN 1 END) AS short, count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS toxic, count(CASE WHEN quality = 0 AND lang <> 'en' THEN 1 END) AS \"foreign\" FROM l")


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and source: attempts, wins, their ratio, the best example; exhausted where three attempts had no win."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    win = F.col("quality") == 1
    best = F.max_by("doc_id", F.when(win, F.struct("n_chars", -F.col("doc_id"))))
    out = docs.groupBy("lang", "source").agg(F.count("*").alias("attempts"), F.count(F.when(win, 1)).alias("wins"), best.alias("example"))
    return six(out.withColumns({"win_rate": F.col("wins") / F.col("attempts"), "exhausted": (F.col("attempts") >= 3) & (F.col("wins") == 0)}))


add("skill_memory", _memory, "SELECT lang, source, count(*) AS attempts, count(CASE WHEN quality = 1 THEN 1 END) AS wins, arg_max(doc_id, CASE WHEN quality = 1 THEN n_chars * 1000000000 - doc_id END) AS example, round(count(CASE WHEN quality = 1 THEN 1 END) / count(*), 6) + 0.0 AS win_rate, count(*) >= 3 AND count(CASE WHEN quality = 1 THEN 1 END) = 0 AS exhausted FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families numbered in the order in which they first appear, and each order's number within its family."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    firsts = orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("first")).withColumn("cluster", F.row_number().over(Window.orderBy("first")))
    numbered = orders.withColumn("seq", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")))
    return numbered.join(F.broadcast(firsts.drop("first")), "o_orderpriority")


add("cluster_and_sequence", _clusters, "SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY f) AS INT) AS cluster, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INT) AS seq FROM (SELECT o_orderkey, o_orderpriority, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS f FROM orders)")


def _union_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping runs of predictions, averaged where both have one."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("double").alias("v"))
    a, b = li.filter("k % 3 <> 0").groupBy("k").agg(F.avg("v").alias("v")), li.filter("k % 5 <> 0").groupBy("k").agg(F.max("v").alias("v"))
    return six(a.unionByName(b).groupBy("k").agg(F.avg("v").alias("v"), F.count("*").alias("runs")))


add("union_then_mean", _union_mean, "SELECT k, round(avg(v), 6) + 0.0 AS v, count(*) AS runs FROM (SELECT l_orderkey AS k, avg(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1 UNION ALL SELECT l_orderkey, max(CAST(l_quantity AS DOUBLE)) FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) GROUP BY 1")
add("set_difference", lambda spark, d: read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct().exceptAll(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()), "SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
add("set_intersection", lambda spark, d: read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
