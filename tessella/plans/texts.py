"""Texts, JSON and vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.library import best_per_group
from tessella.plans.catalogue import add, six
from tessella.sources.panel import read

_DROP = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
_PLAIN = f"trim(regexp_replace(regexp_replace(regexp_replace(html, '{_DROP}', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
add("html_to_text", lambda spark, d: read(spark, d, "pages").select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("digest"), X.title(F.col("html")).alias("title")), f"SELECT page_id, md5({_PLAIN}) AS digest, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
add("text_search_like", lambda spark, d: read(spark, d, "documents").filter(F.lower("text").contains("license") | F.lower("source").contains("src1")).select("doc_id", "source"), "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src1')")


def _hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


add("content_hash_dedupe", _hash_dedupe, "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
add("token_sets", lambda spark, d: read(spark, d, "benchmark").select("item_id", F.array_sort(X.tokens(F.col("text"))).alias("tokens")), "SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS tokens FROM benchmark")


def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of benchmark items that share a token, by the likeness of their token sets; items meet on tokens, not each with each."""
    b = read(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("t"))
    sizes = b.select("item_id", F.size("t").alias("n"))
    long = b.select("item_id", F.explode("t").alias("w"))
    met = long.alias("a").join(long.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.item_id") < F.col("b.item_id")))
    common = met.groupBy(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).agg(F.count("*").alias("c"))
    out = common.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return six(out.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard")))


_TOK = "k AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS w FROM benchmark), z AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1)"
add("token_jaccard", _jaccard, f"WITH {_TOK}, c AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS c FROM k x JOIN k y USING (w) WHERE x.item_id < y.item_id GROUP BY 1, 2) SELECT a, b, round(c / (za.n + zb.n - c), 6) + 0.0 AS jaccard FROM c JOIN z za ON za.item_id = a JOIN z zb ON zb.item_id = b")
_F = "'cs_rank( ts_mean(Close_trade_px, ' || CAST(p_size AS VARCHAR) || ') / vwap - 1 )'"


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.concat(F.lit("cs_rank( ts_mean(Close_trade_px, "), F.col("p_size").cast("string"), F.lit(") / vwap - 1 )"))
    return read(spark, sf_dir, "part").groupBy(X.canonical(f).alias("formula"), X.fingerprint(f).alias("shape")).agg(F.count("*").alias("n"))


_CAN = f"lower(regexp_replace({_F}, '\\s+', '', 'g'))"
add("structural_fingerprint", _fingerprints, f"SELECT {_CAN} AS formula, regexp_replace(replace(replace({_CAN}, 'close_trade_px', '_price'), 'vwap', '_price'), '\\b\\d+\\b', '_n', 'g') AS shape, count(*) AS n FROM part GROUP BY 1, 2")
add("regex_extract_host", lambda spark, d: read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/([a-z]{2})/(\d+)", 1).alias("host"), F.regexp_extract("url", r"^https?://([^/]+)/([a-z]{2})/(\d+)", 3).alias("number")), r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\d+)', 1) AS host, regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\d+)', 3) AS number FROM pages")
add("json_meta_extract", lambda spark, d: read(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").agg(F.count("*").alias("n")), "SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("slugs", lambda spark, d: read(spark, d, "benchmark").select("item_id", X.slug(F.col("text")).alias("slug")), "SELECT item_id, substring(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) || '-' || substring(sha1(text), 1, 8) AS slug FROM benchmark")


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For benchmark items divisible by 10, the three nearest others by cosine of tf-idf over words. Query and corpus meet on words."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]+)"), 1)).alias("w"))
    tf = words.groupBy("item_id", "w").agg(F.count("*").alias("tf"))
    n = words.agg(F.countDistinct("item_id").alias("n"))
    df = tf.groupBy("w").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("w", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    weighed = tf.join(df, "w").select("item_id", "w", (F.col("tf") * F.col("idf")).alias("x"))
    norms = weighed.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = weighed.join(norms, "item_id").select("item_id", "w", (F.col("x") / F.col("norm")).alias("x"))
    met = unit.filter(F.col("item_id") % 100 == 0).alias("q").join(unit.alias("d"), (F.col("q.w") == F.col("d.w")) & (F.col("q.item_id") != F.col("d.item_id")))
    sims = met.groupBy(F.col("q.item_id").alias("query"), F.col("d.item_id").alias("item")).agg(F.round(F.sum(F.col("q.x") * F.col("d.x")), 6).alias("cosine"))
    return best_per_group(sims, "query", [F.col("cosine").desc(), F.col("item")], 3)


add("tfidf_topk", _tfidf, """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark), tf AS (SELECT item_id, w, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT w, ln(((SELECT count(DISTINCT item_id) FROM w) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM tf GROUP BY 1),
x AS (SELECT item_id, w, tf * idf AS x FROM tf JOIN df USING (w)), u AS (SELECT item_id, w, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM x), s AS (SELECT q.item_id AS query, d.item_id AS item, round(sum(q.x * d.x), 6) AS cosine FROM u q JOIN u d USING (w) WHERE q.item_id % 100 = 0 AND q.item_id <> d.item_id GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, item) AS place FROM s) WHERE place <= 3""")


def nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int = 5, at_once: int = 64) -> list[tuple[int, int, float | None]]:
    """(query, vec_id, cosine): of each query(query, u) the k rows(vec_id, v) of another id and the largest dot product to six places, the smaller id first of equals. NaN is
    the largest; a vector that is missing or of another length has a cosine of NULL, which comes last."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids, size = rows["vec_id"].to_numpy(np.int64), lambda vectors: np.array([-1 if v is None else len(v) for v in vectors], np.int64)
    long, asked = size(rows["v"]), size(queries["u"])
    out: list[tuple[int, int, float | None]] = []
    for n in np.unique(asked):
        whose = queries[asked == n]
        same = (long == n) & (n >= 0)
        near, far = ids[same], ids[~same]
        vectors = np.array(rows["v"].to_numpy()[same].tolist(), np.float64).reshape(len(near), max(n, 0)).T
        for begin in range(0, len(whose), at_once):
            part = whose.iloc[begin : begin + at_once]
            likes = np.array(part["u"].tolist(), np.float64) @ vectors if len(near) else np.empty((len(part), 0))
            likes[np.isnan(likes)] = np.inf
            for query, row in zip(part["query"], likes, strict=True):
                row[near == query] = -np.inf
                kth = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                found = np.flatnonzero((row >= kth - 2e-6) & (row > -np.inf))  # what may round to the same
                cosine = np.sign(row[found]) * np.floor(np.abs(row[found]) * 1e6 + 0.5) / 1e6 + 0.0
                best = np.lexsort((found, -cosine))[:k]
                out += [(int(query), int(near[found[i]]), math.nan if cosine[i] == np.inf else float(cosine[i])) for i in best]
                out += [(int(query), int(i), None) for i in far[far != query][: k - len(best)]]
    return out


def _vectors(spark: SparkSession, sf_dir: str, block: int = 20_000, asked: int = 2_000) -> DataFrame:
    """For a stated set of query vectors (ids divisible by 100), the five most alike by cosine: the queries, 1 % of the rows, in blocks of about `asked`, meet
    the rows in blocks of about `block`, each pair of blocks keeps its best by a product of matrices, and the best of those remain. Vectors are normalised once."""
    import pyarrow as pa

    e = read(spark, sf_dir, "embeddings").select("vec_id", X.unit(F.col("embedding")).alias("v")).filter("vec_id is not null")
    count = read(spark, sf_dir, "embeddings").count()
    n, m = max(8, -(-count // block)), max(1, -(-count // (100 * asked)))
    own = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), F.col("v").alias("u"), own(m).alias("asked"), every(n).alias("block"))
    blocks = e.select("vec_id", "v", own(n).alias("block"), every(m).alias("asked"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        found = nearest(a.to_pandas(), b.to_pandas())
        return pa.table([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query", "vec_id", "cosine"])  # NaN is no NULL

    pairs = q.repartition(n * m, "block", "asked").groupBy("block", "asked").cogroup(blocks.repartition(n * m, "block", "asked").groupBy("block", "asked"))
    local = pairs.applyInArrow(best, "query long, vec_id long, cosine double")
    return best_per_group(local, "query", [F.col("cosine").desc(), F.col("vec_id")], 5).select("query", "vec_id", "cosine", "place")


_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * {b}[i]))"
add("vector_topk", _vectors, f"WITH s AS (SELECT q.vec_id AS query, d.vec_id, round({_DOT('q.embedding', 'd.embedding')} / (sqrt({_DOT('q.embedding', 'q.embedding')}) * sqrt({_DOT('d.embedding', 'd.embedding')})), 6) AS cosine FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id) SELECT query, vec_id, cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM s) WHERE place <= 5")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals of relevance scaled and blended - likeness of vectors to the first one, shared terms, language; the best two of
    each language. The query's vector is one row."""
    terms = ["license", "token", "the"]
    e = read(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id = 0").select(F.col("embedding").alias("asked"))
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.lower("text").alias("t")).join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left").join(F.broadcast(asked))
    hits = sum(F.when(F.col("t").contains(w), 1.0).otherwise(0.0) for w in terms)
    scored = d.select("doc_id", "lang", hits.alias("lex"), F.coalesce(F.round(X.cosine(F.col("embedding"), F.col("asked")), 9), F.lit(0.0)).alias("sem"))
    span = scored.agg(F.min("sem").alias("lo"), F.max("sem").alias("hi"))
    score = 0.72 * (F.col("sem") - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.22 * F.col("lex") / len(terms) + 0.06 * (F.col("lang") == "en").cast("double")
    out = scored.join(F.broadcast(span)).select("doc_id", "lang", F.round(score, 6).alias("score"))
    return best_per_group(out, "lang", [F.col("score").desc(), F.col("doc_id")], 2)


add("hybrid_retrieval", _hybrid, """WITH s AS (SELECT doc_id, lang, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT) + CAST(contains(lower(text), 'the') AS INT) AS lex, coalesce(round(""" + f"{_DOT('embedding', 'asked')} / (sqrt({_DOT('embedding', 'embedding')}) * sqrt({_DOT('asked', 'asked')}))" + """, 9), 0) AS sem FROM documents LEFT JOIN embeddings ON vec_id = doc_id, (SELECT embedding AS asked FROM embeddings WHERE vec_id = 0)),
x AS (SELECT doc_id, lang, round(0.72 * (sem - (SELECT min(sem) FROM s)) / ((SELECT max(sem) FROM s) - (SELECT min(sem) FROM s)) + 0.22 * lex / 3 + 0.06 * CAST(lang = 'en' AS DOUBLE), 6) AS score FROM s) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS place FROM x) WHERE place <= 2""")
add("turn_counts", lambda spark, d: read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations")), "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")


def _tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event's props as they are, a quarter as a Python literal with a flag, and a quarter cut short."""
    events = read(spark, sf_dir, "events").select("event_id", "props")
    literal = F.concat(F.lit("{'flag': True, 'k': "), F.get_json_object("props", "$.k"), F.lit("}"))
    text = F.when(F.col("event_id") % 4 == 1, literal).when(F.col("event_id") % 4 == 3, F.substring("props", 1, 4)).otherwise(F.col("props"))
    got = events.withColumn("r", X.tolerant_json(text))
    return got.select("event_id", "r.how", F.get_json_object("r.json", "$.k").cast("double").alias("k"), F.get_json_object("r.json", "$.flag").alias("flag"), "r.corrupt")


add("tolerant_parse", _tolerant, "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'literal' WHEN 3 THEN 'corrupt' ELSE 'json' END AS how, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, CASE WHEN event_id % 4 = 1 THEN 'true' END AS flag, CASE WHEN event_id % 4 = 3 THEN substr(props, 1, 4) END AS corrupt FROM events")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions made of the parts' names and sizes, a few of which look ahead."""
    from tessella.dsl import audit as A

    part = read(spark, sf_dir, "part")
    size = F.col("p_partkey") % 13 - 3
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("DELAY(close_trade_px, "), size.cast("string"), F.lit(")"))).when(F.col("p_partkey") % 7 == 0, F.lit("ts_mean(Lead (volume, 1), 3) - resp")).otherwise(F.lit("ts_mean(volume, 5)"))
    return part.select("p_partkey", A.audit(text).alias("errors"), A.parameters(F.create_map(F.lit("n"), size, F.lit("m"), F.lit(1).cast("long"))).alias("sizes"))


add("token_audit", _audit, """WITH t AS (SELECT p_partkey, p_partkey % 13 - 3 AS n, lower(replace(CASE WHEN p_partkey % 5 = 0 THEN 'DELAY(close_trade_px, ' || (p_partkey % 13 - 3) || ')' WHEN p_partkey % 7 = 0 THEN 'ts_mean(Lead (volume, 1), 3) - resp' ELSE 'ts_mean(volume, 5)' END, ' ', '')) AS x FROM part)
SELECT p_partkey, list_filter([CASE WHEN contains(x, 'resp') THEN 'forbidden: resp' END, CASE WHEN contains(x, 'trading_restriction') THEN 'forbidden: trading_restriction' END, CASE WHEN contains(x, 'lead(') THEN 'forbidden: lead(' END, CASE WHEN contains(x, 'future_') THEN 'forbidden: future_' END, CASE WHEN regexp_matches(x, 'delay\\([^)]*,-\\d+') THEN 'negative delay' END], lambda e: e IS NOT NULL) AS errors,
CASE WHEN n <= 0 THEN ['not above zero: n'] ELSE [] END AS sizes FROM t""")
