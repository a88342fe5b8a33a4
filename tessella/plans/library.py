"""Signal-library queries over orders, suppliers, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import library as L
from tessella.plans.catalogue import add, round_sql, six
from tessella.sources.panel import read


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tested ideas: quality says whether one passed."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("score"))
    return docs.join(read(spark, sf_dir, "labels"), "doc_id")


_LAB = "lab AS (SELECT doc_id, source, lang, CAST(n_chars AS DOUBLE) AS score, quality, toxic FROM documents JOIN labels USING (doc_id))"
_ok = lambda: F.col("quality") == 1  # noqa: E731  columns need a running session
add("library_summary", lambda spark, d: six(L.summary(labelled(spark, d), "score", _ok())), f"WITH {_LAB} SELECT count(*) AS tested, CAST(sum(CAST(quality = 1 AS INT)) AS BIGINT) AS passing, {round_sql({'best': 'max(score)', 'avg_positive': 'avg(CASE WHEN score > 0 THEN score END)', 'pass_rate': 'avg(CAST(quality = 1 AS DOUBLE))'})} FROM lab")
add("status_breakdown", lambda spark, d: labelled(spark, d).groupBy(F.when(_ok() & (F.col("toxic") == 0), "pass").when(F.col("toxic") == 1, "toxic").otherwise("fail").alias("status")).agg(F.count("*").alias("n")), f"WITH {_LAB} SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN toxic = 1 THEN 'toxic' ELSE 'fail' END AS status, count(*) AS n FROM lab GROUP BY 1")
add("source_attribution", lambda spark, d: six(L.breakdown(labelled(spark, d), "source", _ok())), f"WITH {_LAB} SELECT source, count(*) AS tested, CAST(sum(CAST(quality = 1 AS INT)) AS BIGINT) AS passing, {round_sql({'pass_rate': 'avg(CAST(quality = 1 AS DOUBLE))', 'share': 'count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lab)'})} FROM lab GROUP BY 1")
add("generation_progress", lambda spark, d: six(labelled(spark, d).groupBy(F.floor(F.col("doc_id") / 100).alias("generation")).agg(F.count("*").alias("tested"), F.sum(_ok().cast("long")).alias("passing"), F.max("score").alias("best"))), f"WITH {_LAB} SELECT doc_id // 100 AS generation, count(*) AS tested, CAST(sum(CAST(quality = 1 AS INT)) AS BIGINT) AS passing, max(score) AS best FROM lab GROUP BY 1")
add("family_leaderboard", lambda spark, d: six(read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("size"), F.max("p_retailprice").cast("double").alias("best"), F.avg("p_retailprice").cast("double").alias("mean"))), "SELECT p_brand, count(*) AS size, round(CAST(max(p_retailprice) AS DOUBLE), 6) + 0.0 AS best, round(CAST(avg(p_retailprice) AS DOUBLE), 6) + 0.0 AS mean FROM part GROUP BY 1")
_by = lambda: [F.col("o_totalprice").desc(), F.col("o_orderkey")]
_orders = lambda spark, d: read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
_O = "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders"
add("paged_sorted_list", lambda spark, d: L.page(_orders(spark, d), _by(), 2, 25), f"{_O} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
add("best_per_family_topk", lambda spark, d: L.diversified(_orders(spark, d), "o_orderpriority", _by(), 20), f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1 AS f FROM ({_O})) ORDER BY f DESC, o_totalprice DESC, o_orderkey LIMIT 20")
add("balanced_source_topk", lambda spark, d: L.best_per_group(_orders(spark, d), "o_orderpriority", _by(), 5), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM ({_O})) WHERE place <= 5")
_SOURCES = ["1-URGENT", "3-MEDIUM", "9-NONE"]
add("balanced_fill_topk", lambda spark, d: L.balanced(_orders(spark, d), "o_orderpriority", _by(), 20, _SOURCES), f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS p, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM ({_O})),
c AS (SELECT *, CASE WHEN p <= 7 AND o_orderpriority = '1-URGENT' THEN 1 WHEN p <= 7 AND o_orderpriority = '3-MEDIUM' THEN 2 ELSE 3 END AS s FROM g)
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(row_number() OVER (ORDER BY s, r) AS INT) AS place FROM c QUALIFY place <= 20""")
_month = lambda: F.date_format("o_orderdate", "yyyy-MM")
_price = lambda spark, d: read(spark, d, "orders").withColumn("p", F.col("o_totalprice").cast("double"))
_RUN = "SELECT step, CAST(sum(n) OVER (ORDER BY step) AS BIGINT) AS tested, max(b) OVER (ORDER BY step) AS best FROM (SELECT strftime(o_orderdate, '%Y-%m') AS step, count(*) AS n, max(CAST(o_totalprice AS DOUBLE)) AS b FROM orders GROUP BY 1)"
add("running_best_curve", lambda spark, d: L.running_best(_price(spark, d), _month(), "p"), _RUN)
add("downsample_curve", lambda spark, d: L.downsample(L.running_best(_price(spark, d), _month(), "p"), "step", 12), f"WITH c AS ({_RUN}), k AS (SELECT *, row_number() OVER (ORDER BY step) - 1 AS i, count(*) OVER () AS n FROM c) SELECT step, tested, best FROM k WHERE n <= 12 OR i IN (SELECT CAST(round_even(j * (n2 - 1) / 11.0, 0) AS BIGINT) FROM range(12) r(j), (SELECT count(*) AS n2 FROM c))")
add("turnover_bucket", lambda spark, d: read(spark, d, "lineitem").groupBy(F.when(F.col("l_quantity") <= 2, "very low").when(F.col("l_quantity") <= 6, "low").when(F.col("l_quantity") <= 10, "medium").otherwise("high").alias("tier")).agg(F.count("*").alias("n")), "SELECT CASE WHEN l_quantity <= 2 THEN 'very low' WHEN l_quantity <= 6 THEN 'low' WHEN l_quantity <= 10 THEN 'medium' ELSE 'high' END AS tier, count(*) AS n FROM lineitem GROUP BY 1")
add("failure_reasons", lambda spark, d: labelled(spark, d).select(F.explode(F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("score") < 500, "short")))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")), f"WITH {_LAB} SELECT reason, count(*) AS n FROM (SELECT 'low_quality' AS reason FROM lab WHERE quality = 0 UNION ALL SELECT 'toxic' FROM lab WHERE toxic = 1 UNION ALL SELECT 'short' FROM lab WHERE score < 500) GROUP BY 1")


def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.lit(0).cast("long").alias("uses"))
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") + 50).cast("long").alias("k"), F.lit(1).cast("long").alias("uses"))
    return L.insert_absent(c, o, "k")


add("insert_if_absent", _insert, "SELECT CAST(c_custkey AS BIGINT) AS k, CAST(0 AS BIGINT) AS uses FROM customer UNION ALL SELECT DISTINCT CAST(o_custkey + 50 AS BIGINT), CAST(1 AS BIGINT) FROM orders WHERE o_custkey + 50 NOT IN (SELECT c_custkey FROM customer)")
add("increment_counters", lambda spark, d: L.bump(read(spark, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("uses")), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "uses"), "SELECT c_custkey, count(o_orderkey) AS uses FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
add("prune_to_last", lambda spark, d: L.prune(_orders(spark, d), [F.col("o_orderkey").desc()], 100), f"{_O} ORDER BY o_orderkey DESC LIMIT 100")
add("capped_context", lambda spark, d: L.capped_context(read(spark, d, "documents").select("doc_id", "source", "text"), "text", [F.col("doc_id")], 20000, "source").select("doc_id", "source", "running"), "SELECT doc_id, source, running FROM (SELECT doc_id, source, CAST(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) WHERE running <= 20000")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags that occur in one order, as unordered pairs, by how often they do."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").distinct()
    per = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("m")).filter("size(m) > 1")
    both = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per.select(F.explode(both).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("attempts"))


add("pair_attempts", _pairs, "WITH i AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) SELECT x.l_returnflag AS a, y.l_returnflag AS b, count(*) AS attempts FROM i x JOIN i y USING (l_orderkey) WHERE x.l_returnflag < y.l_returnflag GROUP BY 1, 2")
add("expected_days", lambda spark, d: read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().groupBy(F.year("day").alias("year")).agg(F.count("*").alias("days")), "SELECT CAST(year(day) AS INT) AS year, count(*) AS days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) GROUP BY 1")
