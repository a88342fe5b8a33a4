"""Parents, guidance and experience of tried ideas, which are the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import ideas as I
from tessella.operators.memory import tags
from tessella.plans.catalogue import add, round_sql, six
from tessella.sources.panel import read

_WORDS = {"the": ["the "], "and": ["and "], "der": ["der "], "licence": ["license", "licence"], "token": ["token"], "question": ["?"], "colon": [":"], "que": ["que "]}


def ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    status = F.when(F.col("doc_id") % 17 == 0, "duplicate").when(F.col("toxic") == 1, "screened_out").when(n < 60, "compute_error").otherwise("ok")
    key = X.canonical(F.col("text"))
    return docs.select(
        F.col("doc_id").alias("idea"), F.floor(F.col("doc_id") / 100).alias("generation"), F.md5(key).alias("formula"), F.concat_ws("-", "lang", F.substring(key, 1, 2)).alias("family"), "source", status.alias("status"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passes"), (n / 100.0).alias("score"), (n % 97 / 48.0).alias("ic"), (n % 53 / 10.0).alias("ir"), (n % 500).cast("double").alias("tvr"), tags(F.col("text"), _WORDS).alias("tokens"),
    )


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in v)} THEN '{k}' END" for k, v in _WORDS.items()) + "], lambda x: x IS NOT NULL)"
_IDEAS = f"""ii AS (SELECT *, regexp_replace(lower(text), '[\\s\\x0b]+', '', 'g') AS key FROM documents JOIN labels USING (doc_id)),
i AS (SELECT doc_id AS idea, doc_id // 100 AS generation, md5(key) AS formula, lang || '-' || substr(key, 1, 2) AS family, source, CASE WHEN doc_id % 17 = 0 THEN 'duplicate' WHEN toxic = 1 THEN 'screened_out' WHEN n_chars < 60 THEN 'compute_error' ELSE 'ok' END AS status,
  quality = 1 AND toxic = 0 AS passes, n_chars / 100.0::DOUBLE AS score, n_chars % 97 / 48.0::DOUBLE AS ic, n_chars % 53 / 10.0::DOUBLE AS ir, CAST(n_chars % 500 AS DOUBLE) AS tvr, {_TAGS} AS tokens FROM ii)"""
_REASON = "CASE WHEN passes THEN 'passed' WHEN status = 'compute_error' THEN 'compute_error' WHEN status = 'duplicate' THEN 'duplicate_formula' WHEN status = 'screened_out' THEN 'screened_out' WHEN tvr >= 330 THEN 'high_tvr' WHEN ir <= 2.5 THEN 'low_ir' WHEN ic <= 0.6 THEN 'low_ic' WHEN score <= 0 THEN 'zero_score' ELSE 'failed_gate' END"
add("diversified_parents", lambda spark, d: I.parents(ideas(spark, d)), f"""WITH {_IDEAS}, al AS (SELECT * FROM i WHERE status IN ('ok', 'screened_out')), pa AS (SELECT *, row_number() OVER (ORDER BY score DESC, ic DESC, idea) AS k FROM al WHERE passes AND ic >= 0.2),
a1 AS (SELECT * FROM pa WHERE k = 1), an AS (SELECT * FROM a1 UNION ALL SELECT * FROM pa WHERE k = 2 AND formula <> (SELECT formula FROM a1)),
dk AS (SELECT *, row_number() OVER (ORDER BY family IN (SELECT family FROM an), source IN (SELECT source FROM an), score DESC, ic DESC, idea) AS pos FROM pa),
df AS (SELECT * FROM dk WHERE family NOT IN (SELECT family FROM an) QUALIFY row_number() OVER (PARTITION BY family ORDER BY pos) = 1), d1 AS (SELECT *, row_number() OVER (ORDER BY pos) AS q FROM df), p1 AS (SELECT * FROM d1 WHERE q <= 3 - (SELECT count(*) FROM an)),
s3 AS (SELECT formula FROM an UNION ALL SELECT formula FROM p1), p2 AS (SELECT * FROM dk WHERE (SELECT count(*) FROM s3) = 3 AND pos > (SELECT max(pos) FROM p1) AND formula NOT IN (SELECT formula FROM s3) ORDER BY pos LIMIT 1),
s4 AS (SELECT formula FROM s3 UNION ALL SELECT formula FROM p2), e0 AS (SELECT * FROM al WHERE NOT passes AND ic >= 0.2 AND tvr < 400 AND formula NOT IN (SELECT formula FROM s4) QUALIFY row_number() OVER (PARTITION BY formula ORDER BY ic DESC, tvr, idea) = 1),
e1 AS (SELECT *, row_number() OVER (ORDER BY ic DESC, tvr, idea) AS q FROM e0), al4 AS (SELECT 1 AS g, k AS o, idea, 'anchor' AS kind FROM an UNION ALL SELECT 2, pos, idea, 'diverse' FROM p1 UNION ALL SELECT 3, pos, idea, 'diverse' FROM p2 UNION ALL SELECT 4, q, idea, 'exploratory' FROM e1 WHERE q <= 4 - (SELECT count(*) FROM s4))
SELECT CAST(row_number() OVER (ORDER BY g, o) AS INT) AS place, idea, kind FROM al4""")
_RECENT, _CROWDED = 200, 5
add("generation_guidance", lambda spark, d: I.guidance(ideas(spark, d), _RECENT, _CROWDED), f"""WITH {_IDEAS}, kn AS (SELECT *, {_REASON} AS reason FROM i), la AS (SELECT * FROM kn ORDER BY idea DESC LIMIT {_RECENT}), fa AS (SELECT * FROM la WHERE status = 'ok' AND NOT passes), un AS (SELECT * FROM la WHERE status IN ('ok', 'screened_out') AND NOT passes),
ct AS (SELECT t, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM fa) GROUP BY 1 HAVING count(*) >= {_CROWDED}), st AS (SELECT list_sort(tokens) AS tk, passes FROM kn),
pr AS (SELECT a || ' + ' || b AS pair, count(*) AS n, count(CASE WHEN passes THEN 1 END) AS w FROM (SELECT a, unnest(tk) AS b, passes FROM (SELECT unnest(tk) AS a, tk, passes FROM st)) WHERE a < b GROUP BY 1),
fm AS (SELECT family, count(*) AS n FROM kn GROUP BY 1 HAVING count(*) >= 3 AND count(CASE WHEN passes THEN 1 END) = 0), rs AS (SELECT reason, count(*) AS n FROM un GROUP BY 1),
tv AS (SELECT count(*) AS u, count(CASE WHEN tvr >= 330 THEN 1 END) AS h, avg(CASE WHEN tvr >= 330 THEN tvr END) AS m FROM un), du AS (SELECT count(CASE WHEN status = 'duplicate' THEN 1 END) AS d, count(*) AS n_recent FROM la)
SELECT n_recent, CASE WHEN u > 0 AND h / u >= 0.4 THEN h || '/' || u || ' of the latest that don''t pass turn over too much (mean ' || CAST(round(m) AS BIGINT) || '): lengthen the outer smoother' || CASE WHEN d >= 3 THEN '; ' || d || '/' || n_recent || ' of the latest repeat earlier ones' ELSE '' END ELSE '' END AS alert,
coalesce((SELECT list(t ORDER BY n DESC, t) FROM ct), []) AS crowded_tokens, coalesce((SELECT list(idea ORDER BY score, ic, idea) FROM (SELECT * FROM fa ORDER BY score, ic, idea LIMIT 4)), []) AS weak_examples,
coalesce((SELECT list(idea ORDER BY score DESC, ic DESC, idea) FROM (SELECT * FROM kn WHERE passes ORDER BY score DESC, ic DESC, idea LIMIT 4)), []) AS strong_examples,
coalesce((SELECT list(pair || ' (' || w || '/' || n || ')' ORDER BY w / n DESC, n DESC, pair) FROM (SELECT * FROM pr WHERE n >= 3 AND w / n >= 0.4 ORDER BY w / n DESC, n DESC, pair LIMIT 5)), []) AS productive_pairs,
coalesce((SELECT list(family ORDER BY n DESC, family) FROM (SELECT * FROM fm ORDER BY n DESC, family LIMIT 6)), []) AS exhausted_families, coalesce((SELECT reason FROM rs ORDER BY n DESC, reason LIMIT 1), '') AS dominant_failure FROM tv, du""")
add("generation_experience", lambda spark, d: six(I.experience(ideas(spark, d))), f"""WITH {_IDEAS}, kn AS (SELECT *, {_REASON} AS reason FROM i), ct AS (SELECT generation, reason, count(*) AS n FROM kn GROUP BY 1, 2), fl AS (SELECT generation, list(reason || '=' || n ORDER BY reason) AS failures FROM ct GROUP BY 1),
tp AS (SELECT generation, list(idea ORDER BY score DESC, ic DESC, idea) AS top_examples FROM (SELECT * FROM kn QUALIFY row_number() OVER (PARTITION BY generation ORDER BY score DESC, ic DESC, idea) <= 6) GROUP BY 1),
wk AS (SELECT generation, list(idea ORDER BY passes, score, ic, idea) AS weak_examples FROM (SELECT * FROM kn QUALIFY row_number() OVER (PARTITION BY generation ORDER BY passes, score, ic, idea) <= 8) GROUP BY 1),
al AS (SELECT generation, count(*) AS total, count(CASE WHEN passes THEN 1 END) AS passing, round(max(score), 6) AS best_score FROM kn GROUP BY 1) SELECT * FROM al JOIN fl USING (generation) JOIN tp USING (generation) JOIN wk USING (generation)""")
_KEY = {"wanted": ["the", "and", "of", "license", "token", "que", "der", "une", "password", "public"], "unwanted": ["admin", "###", "&&&"], "outcome": ["tion", "cion", "ung"], "market": ["th", "qu", "ch"]}
_n = lambda words: " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words)


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(read(spark, sf_dir, "documents").select("doc_id", I.relevance(F.col("text"), **_KEY).alias("r")).select("doc_id", "r.*"))


add("keyword_relevance", _relevance, f"WITH k AS (SELECT doc_id, {_n(_KEY['wanted'])} AS hits, least(0.98, 0.25 + 0.07 * ({_n(_KEY['wanted'])}) - 0.12 * ({_n(_KEY['unwanted'])}))::DOUBLE AS p, ({_n(_KEY['outcome'])}) > 0 AND ({_n(_KEY['market'])}) > 0 AS b2 FROM documents) SELECT doc_id, round(greatest(0.0, least(1.0, p)), 6) + 0.0 AS score, b2 AND hits >= 3 AND round(p, 9) >= 0.62 AS keep, CAST(hits AS INT) AS hits FROM k")
_outcome = lambda: F.when(F.col("passes"), "passing").otherwise(F.col("status"))
add("archetype_weights", lambda spark, d: six(I.archetype_weights(ideas(spark, d).withColumn("outcome", _outcome()), "family")), f"""WITH {_IDEAS}, o AS (SELECT family, count(*) AS tried, count(CASE WHEN NOT passes AND status = 'compute_error' THEN 1 END) AS e, count(CASE WHEN NOT passes AND status = 'screened_out' THEN 1 END) AS s, count(CASE WHEN passes THEN 1 END) AS p FROM i GROUP BY 1)
SELECT family, tried, round(greatest(0.15, least(greatest(0.2, 1 - 0.8 * (e / tried)) * greatest(0.4, 1 - 0.35 * (s / tried)) * (1 + least(0.35, 0.12 * p)), 1.5)), 6) + 0.0 AS weight FROM o""")
_ALIASES = {"high_tvr": ["tvr", "turnover", "smooth"], "compute_error": ["syntax", "compute", "error"], "screened_out": ["screen", "gate", "failed"]}
add("alias_expansion", lambda spark, d: ideas(spark, d).select("idea", I.expanded(F.concat_ws(" ", "source", "status", I.failure_reason()), _ALIASES).alias("words")), f"""WITH {_IDEAS}, t AS (SELECT idea, lower(source || ' ' || status || ' ' || {_REASON}) AS t FROM i)
SELECT idea, list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(t, '[^a-z0-9_]+'), lambda w: length(w) >= 3), {"list_concat(" + ", ".join(f"CASE WHEN contains(t, '{k}') OR contains(t, '{k.replace('_', ' ')}') THEN {v} ELSE [] END" for k, v in _ALIASES.items()) + ")"}))) AS words FROM t""")


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older generation whose failures have most to do with turnover and errors."""
    records = I.experience(ideas(spark, sf_dir)).select("generation", "total", "passing", F.concat_ws(" ", "failures").alias("text"))
    return I.relevant_experience(records, I.expanded(F.lit("high tvr and compute_error"), _ALIASES))


add("relevant_experience", _relevant, f"""WITH {_IDEAS}, kn AS (SELECT *, {_REASON} AS reason FROM i), ct AS (SELECT generation, reason, count(*) AS n FROM kn GROUP BY 1, 2), rc AS (SELECT generation, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN reason = 'passed' THEN n ELSE 0 END) AS BIGINT) AS passing, string_agg(reason || '=' || n, ' ' ORDER BY reason) AS text FROM ct GROUP BY 1),
sc AS (SELECT *, CAST(len(list_filter(['and', 'compute', 'compute_error', 'error', 'high', 'smooth', 'syntax', 'turnover', 'tvr'], lambda w: contains(text, w))) AS INT) AS hits FROM rc WHERE generation NOT IN (SELECT generation FROM rc ORDER BY 1 DESC LIMIT 2)) SELECT * FROM sc WHERE hits > 0 ORDER BY hits DESC, generation DESC LIMIT 1""")
add("gate_notes", lambda spark, d: ideas(spark, d).select("idea", I.gate_notes({"IC predictive power": F.col("ic") > 0.6, "IR consistency": F.col("ir") > 2.5, "TVR turnover": F.col("tvr") < 400}).alias("notes")), f"WITH {_IDEAS} SELECT idea, [" + ", ".join(f"'{k}: ' || CASE WHEN {c} THEN 'pass' ELSE 'fail' END" for k, c in (("IC predictive power", "ic > 0.6"), ("IR consistency", "ir > 2.5"), ("TVR turnover", "tvr < 400"))) + "] AS notes FROM i")
