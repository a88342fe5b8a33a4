"""Retrieval, lessons, outcomes and changes of tables of ideas, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import memory as Y
from tessella.operators.library import best_per_group
from tessella.plans.catalogue import PANEL, RESEARCH, add, round_sql, signal, six
from tessella.plans.evaluation import DAYS
from tessella.sources import panel as P
from tessella.sources.panel import read


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as ideas: balance as quality, orders as uses, finished orders as passes."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("used"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("passed"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal").cast("double") / 1000).alias("quality")).join(orders, "c_custkey", "left")


_CU = "cu AS (SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DOUBLE) / 1000 AS quality, used, passed FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS used, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS passed FROM orders GROUP BY 1) ON o_custkey = c_custkey)"
_EFF = "coalesce(quality, 0) * 0.5 + coalesce(passed, 0) / greatest(coalesce(used, 0), 1) * 0.5 + CASE WHEN coalesce(used, 0) = 0 THEN 0.08 ELSE 0 END"
add("effective_score", lambda spark, d: six(_customers(spark, d).select("c_custkey", Y.effective_score(F.col("quality"), F.col("used"), F.col("passed")).alias("score"))), f"WITH {_CU} SELECT c_custkey, round({_EFF}, 6) + 0.0 AS score FROM cu")
add("recent_outcomes", lambda spark, d: Y.recent_outcomes(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus", F.col("o_orderkey").desc(), 80), "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 80) GROUP BY 1, 2")
_ASKED = "license token the and research of model"


def _experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four documents that teach most for a query, one of each text."""
    from pyspark.sql import Window

    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "quality", "toxic", F.col("n_chars").cast("double").alias("score"))
    recent = docs.orderBy(F.desc("doc_id")).limit(300).withColumn("age", F.row_number().over(Window.orderBy(F.desc("doc_id"))))  # 300 rows
    shared = F.size(F.array_intersect(Y.tokens(F.col("text")), Y.tokens(F.lit(_ASKED))))
    points = Y.experience_score(shared, F.col("quality") == 1, F.col("toxic") == 0, F.col("score") / 1000, F.col("age"), F.col("toxic") == 1)
    scored = recent.select("doc_id", F.md5("text").alias("same"), F.round(points, 6).alias("points"))
    return Y.best_distinct(scored, "same", [F.col("points").desc(), F.col("doc_id")], 4)


add("experience_retrieval", _experience, f"""WITH d AS (SELECT doc_id, text, quality, toxic, CAST(n_chars AS DOUBLE) / 1000 AS score, row_number() OVER (ORDER BY doc_id DESC) AS age FROM documents JOIN labels USING (doc_id)),
s AS (SELECT doc_id, md5(text) AS same, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), string_split('{_ASKED}', ' '))) * 4.0 + CASE WHEN quality = 1 THEN 3.0 WHEN toxic = 0 THEN 1.0 ELSE 0 END + greatest(least(score, 10.0), 0) * 0.2 + greatest(0.2, 2.5 / age) + CASE WHEN toxic = 1 THEN 0.4 ELSE 0 END, 6) AS points FROM d WHERE age <= 300)
SELECT doc_id, same, points FROM (SELECT *, row_number() OVER (PARTITION BY same ORDER BY points DESC, doc_id) AS k FROM s) WHERE k = 1 ORDER BY points DESC, doc_id LIMIT 4""")


def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of advice for each tested document, by which gates it failed, and how often each is given."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    failed = F.array_compact(F.array(F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxicity"), F.when(F.col("n_chars") < 500, "length")))
    lesson = F.when(F.size("failed") == 0, "keep the structure").when(F.size("failed") > 1, F.concat(F.lit("change more than one thing: "), F.array_join("failed", ", "))).otherwise(F.concat(F.lit("work on "), F.col("failed")[0]))
    return rows.select(failed.alias("failed")).select(lesson.alias("lesson"), F.size("failed").alias("gates")).groupBy("lesson", "gates").agg(F.count("*").alias("n"))


add("lesson_text", _lessons, """WITH f AS (SELECT list_filter([CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxicity' END, CASE WHEN n_chars < 500 THEN 'length' END], lambda x: x IS NOT NULL) AS failed FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN len(failed) = 0 THEN 'keep the structure' WHEN len(failed) > 1 THEN 'change more than one thing: ' || array_to_string(failed, ', ') ELSE 'work on ' || failed[1] END AS lesson, CAST(len(failed) AS INT) AS gates, count(*) AS n FROM f GROUP BY 1, 2""")
_THEMES = {"legal": ["license", "copyright"], "secret": ["token", "password"], "prose": ["the ", "and "]}
_has = lambda found: " OR ".join(f"contains(lower(text), '{w}')" for w in found)
add("theme_tags", lambda spark, d: read(spark, d, "documents").select(F.explode(Y.tags(F.col("text"), _THEMES)).alias("theme")).groupBy("theme").agg(F.count("*").alias("n")), "SELECT theme, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS theme FROM documents WHERE {_has(v)}" for k, v in _THEMES.items()) + ") GROUP BY 1")
_KEYS = "o_orderkey, o_custkey, o_orderpriority"
_case = lambda c: F.when(c == "1-URGENT", 0).when(c == "2-HIGH", 1).otherwise(2)
_CASE = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END"
add("page_with_totals", lambda spark, d: Y.with_page(read(spark, d, "orders").select(*_KEYS.split(", ")), [F.col("o_orderkey")], 3, 40), f"SELECT {_KEYS}, (SELECT count(*) FROM orders) AS total, (SELECT CAST(greatest(ceil(count(*) / 40.0), 1) AS BIGINT) FROM orders) AS pages FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 80")
add("case_priority_order", lambda spark, d: read(spark, d, "orders").select(*_KEYS.split(", "), _case(F.col("o_orderpriority")).alias("rank")).orderBy("rank", F.desc("o_orderkey")).limit(50), f"SELECT {_KEYS}, CAST({_CASE} AS INT) AS rank FROM orders ORDER BY rank, o_orderkey DESC LIMIT 50")
add("oldest_unconsumed", lambda spark, d: Y.oldest(read(spark, d, "orders").select(*_KEYS.split(", "), "o_orderstatus"), F.col("o_orderstatus") == "O", [F.col("o_orderkey")], 30), f"SELECT {_KEYS}, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 30")


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(True).alias("active"))
    return Y.changed(table, table.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("MOVED").alias("c_mktsegment"), F.lit(False).alias("active")), "c_custkey").filter("c_custkey % 5 <> 0")


add("update_toggle_delete", _updated, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 3 <> 0 AS active FROM customer WHERE c_custkey % 5 <> 0")
add("sync_actions", lambda spark, d: Y.synced(read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("long").alias("h")), read(spark, d, "orders").groupBy((F.col("o_custkey") + 20).cast("long").alias("k")).agg((F.count("*") % 25).alias("h")), "k", "h").groupBy("action").agg(F.count("*").alias("n")), """WITH o AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS BIGINT) AS h FROM customer), s AS (SELECT CAST(o_custkey + 20 AS BIGINT) AS k, count(*) % 25 AS h FROM orders GROUP BY 1)
SELECT CASE WHEN o.k IS NULL THEN 'insert' WHEN s.k IS NULL THEN 'delete' WHEN o.h <> s.h THEN 'update' ELSE 'keep' END AS action, count(*) AS n FROM o FULL JOIN s ON o.k = s.k GROUP BY 1""")
add("importance_by_feature", lambda spark, d: six(Y.importance(read(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.sum("l_quantity").cast("double").alias("v")), "l_linenumber", "v", "l_returnflag")), """WITH m AS (SELECT l_linenumber, l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT *, abs(v) / sum(abs(v)) OVER (PARTITION BY l_returnflag) AS share FROM m),
a AS (SELECT l_linenumber, round(avg(share), 9) AS share, count(DISTINCT l_returnflag) AS models FROM s GROUP BY 1) SELECT l_linenumber, round(share, 6) + 0.0 AS share, models, CAST(row_number() OVER (ORDER BY a.share DESC, l_linenumber) AS INT) AS place FROM a""")


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    days = s.groupBy("date", "security_id").agg(F.avg("alpha").alias("alpha"))
    return six(Y.onto_stamps(days, s.select("date", "datetime", "security_id")))


add("daily_onto_stamps", _stamped, f"WITH {RESEARCH}, d AS (SELECT date, security_id, avg(alpha) AS alpha FROM r GROUP BY 1, 2) SELECT date, security_id, datetime, round(coalesce(d.alpha, 0), 6) + 0.0 AS alpha FROM r LEFT JOIN d USING (date, security_id)")
add("source_timeline", lambda spark, d: read(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.max(F.col("o_totalprice").cast("double")).alias("b")).select("o_orderpriority", "month", F.expr("max(b) over (partition by o_orderpriority order by month)").alias("best")), "SELECT o_orderpriority, month, max(b) OVER (PARTITION BY o_orderpriority ORDER BY month) AS best FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, max(CAST(o_totalprice AS DOUBLE)) AS b FROM orders GROUP BY 1, 2)")
add("deterministic_sample", lambda spark, d: Y.sample(read(spark, d, "customer").select("c_custkey"), "c_custkey", 40), "SELECT c_custkey FROM customer ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 40")
add("next_generation", lambda spark, d: read(spark, d, "lineitem").groupBy("l_orderkey").agg((F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).alias("generation")).groupBy("generation").agg(F.count("*").alias("n")), "SELECT generation, count(*) AS n FROM (SELECT l_orderkey, coalesce(max(l_linenumber), 0) + 1 AS generation FROM lineitem GROUP BY 1) GROUP BY 1")


def _char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a stated set of benchmark items (ids divisible by 100) the three most alike by TF-IDF of character 3- to 5-grams."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.explode(Y.char_grams(F.col("text"))).alias("g"))
    tf = items.groupBy("item_id", "g").agg(F.count("*").cast("double").alias("tf"))
    n = items.agg(F.countDistinct("item_id").alias("n"))
    df = tf.groupBy("g").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("g", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    x = tf.join(df, "g").select("item_id", "g", (F.col("tf") * F.col("idf")).alias("x"))
    unit = x.join(x.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")), "item_id").select("item_id", "g", (F.col("x") / F.col("norm")).alias("x"))
    met = unit.filter(F.col("item_id") % 100 == 0).alias("q").join(unit.alias("d"), (F.col("q.g") == F.col("d.g")) & (F.col("q.item_id") != F.col("d.item_id")))
    sims = met.groupBy(F.col("q.item_id").alias("query"), F.col("d.item_id").alias("item")).agg(F.round(F.sum(F.col("q.x") * F.col("d.x")), 6).alias("cosine"))
    return best_per_group(sims, "query", [F.col("cosine").desc(), F.col("item")], 3)


add("char_tfidf_topk", _char_tfidf, "WITH w AS (SELECT item_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) || ' ' AS t FROM benchmark), g AS (" + " UNION ALL ".join(f"SELECT item_id, substring(t, i, {n}) AS g FROM w, unnest(range(1, length(t) - {n - 2})) AS u(i)" for n in (3, 4, 5)) + """), tf AS (SELECT item_id, g, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT g, ln(((SELECT count(DISTINCT item_id) FROM g) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM tf GROUP BY 1),
x AS (SELECT item_id, g, tf * idf AS x FROM tf JOIN df USING (g)), u AS (SELECT item_id, g, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM x), s AS (SELECT q.item_id AS query, d.item_id AS item, round(sum(q.x * d.x), 6) AS cosine FROM u q JOIN u d USING (g) WHERE q.item_id % 100 = 0 AND q.item_id <> d.item_id GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, item) AS place FROM s) WHERE place <= 3""")
_CALLS = "(SELECT event_type, count(*) AS calls, sum(CAST(length(props) AS BIGINT)) AS n FROM events GROUP BY 1)"
add("usage_audit", lambda spark, d: read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.length("props").cast("long")).alias("n")), f"SELECT event_type, calls, CAST(n AS BIGINT) AS n FROM {_CALLS}")
