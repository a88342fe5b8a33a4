"""Combination of three daily signals, and models over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.dsl import formula
from tessella.operators import combine as K
from tessella.operators import research as R
from tessella.operators.metrics import correlation
from tessella.plans.catalogue import add, round_sql, six
from tessella.plans.evaluation import _THREE, _THREE_SQL, corr_sql
from tessella.sources import panel as P

NAMES = list(_THREE)
_DAY = f"""{_THREE_SQL}, lb AS (SELECT security_id, bar_idx, lead(close_trade_px, 24) OVER (PARTITION BY security_id ORDER BY bar_idx) / nullif(close_trade_px, 0) - 1 AS resp FROM p),
dd AS (SELECT date, security_id, avg(rev) AS rev, avg(mom) AS mom, avg(vol) AS vol, avg(resp) AS ret FROM s3 JOIN lb USING (security_id, bar_idx) GROUP BY 1, 2)"""
_STATS = "si AS (" + " UNION ALL ".join(f"SELECT '{n}' AS factor, date, {corr_sql(n, 'ret')} AS ic FROM dd GROUP BY date" for n in NAMES) + "), st AS (SELECT factor, avg(ic) AS ic, stddev_samp(ic) AS std FROM si GROUP BY 1)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, security_id, rev, mom, vol, ret): means over each day's bars."""
    bars = formula.evaluate(P.research_panel(spark, sf_dir), _THREE, ("date", "security_id", "resp"))
    return bars.groupBy("date", "security_id").agg(*(F.avg(n).alias(n) for n in NAMES), F.avg("resp").alias("ret"))


add("daily_feature_frame", lambda spark, d: six(daily(spark, d).na.fill(0.0, NAMES)), f"WITH {_DAY} SELECT date, security_id, {round_sql({n: f'coalesce({n}, 0)' for n in NAMES} | {'ret': 'ret'})} FROM dd")
add("factor_ic_stats", lambda spark, d: six(R.factor_stats(daily(spark, d), NAMES)), f"WITH {_DAY}, {_STATS} SELECT factor, {round_sql({'ic': 'ic', 'std': 'std', 'icir': 'ic / nullif(std, 0)', 'sign': 'CAST(sign(ic) AS DOUBLE)', 'abs_ic': 'abs(ic)'})} FROM st")


def _stats(days: DataFrame) -> dict[str, dict[str, float]]:
    rows = {r.factor: r.asDict() for r in R.factor_stats(days, NAMES).collect()}  # one row a signal
    return {n: rows[n] for n in NAMES}


def _combo(scheme: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        days = daily(spark, sf_dir)
        corr = K.pooled_correlations(days, NAMES) if scheme in ("diversified", "inverse_corr", "corr_pruned", "cluster_neutral") else None
        return six(K.blend(days, K.weights(scheme, _stats(days), corr)).select("date", "security_id", "combo"))

    return query


_W = {
    "equal": "sign(ic)", "ic": "ic", "icir": "ic / nullif(std, 0)", "power": "sign(ic) * ic * ic", "inverse_vol": "sign(ic) / std",
    "topk": "CASE WHEN row_number() OVER (ORDER BY abs(ic) DESC, factor) <= 2 THEN sign(ic) ELSE 0 END", "softmax": "sign(ic) * exp((abs(ic) - max(abs(ic)) OVER ()) / 0.05)",
}
_W |= {
    "ridge_shrink": "ic / (std * std + greatest((SELECT quantile_cont(std * std, 0.5) FROM st WHERE std > 0), 1e-4))", "vol_balanced": "sign(ic) / greatest(std, 1e-4)",
    "inverse_corr": "sign(ic) / (1e-6 + (1 + (SELECT sum(abs(c)) FROM pc WHERE a = factor)) / 3)",
    "diversified": "CASE factor WHEN 'rev' THEN x1 WHEN 'mom' THEN x2 ELSE x3 END", "corr_pruned": "CASE WHEN kept THEN sign(ic) ELSE 0 END", "cluster_neutral": "ic / sum(abs(ic)) OVER (PARTITION BY home) / (SELECT count(DISTINCT home) FROM cl)",
}
_CORR = "pc AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, coalesce({corr_sql(a, b)}, 0) AS c FROM dd" for a in NAMES for b in NAMES if a != b) + ")"
_C = lambda a, b: f"(SELECT c FROM pc WHERE a = '{a}' AND b = '{b}')"
_I = lambda a: f"(SELECT ic FROM st WHERE factor = '{a}')"
#: Cramer's rule for a symmetric 3 x 3 matrix of diagonal d and p, q, r beside it.
_CRAMER = f"""k0 AS (SELECT 1.25 AS d, {_C('rev', 'mom')} AS p, {_C('rev', 'vol')} AS q, {_C('mom', 'vol')} AS r, {_I('rev')} AS u, {_I('mom')} AS v, {_I('vol')} AS w), k1 AS (SELECT *, d * (d * d - r * r) - p * (p * d - r * q) + q * (p * r - d * q) AS det FROM k0),
k2 AS (SELECT (u * (d * d - r * r) - p * (v * d - r * w) + q * (v * r - d * w)) / det AS x1, (d * (v * d - r * w) - u * (p * d - r * q) + q * (p * w - v * q)) / det AS x2, (d * (d * w - v * r) - p * (p * w - v * q) + u * (p * r - d * q)) / det AS x3 FROM k1)"""
_BY = "b0 AS (SELECT factor, row_number() OVER (ORDER BY abs(ic) DESC, factor) AS k FROM st), b1 AS (SELECT max(CASE WHEN k = 1 THEN factor END) AS f1, max(CASE WHEN k = 2 THEN factor END) AS f2, max(CASE WHEN k = 3 THEN factor END) AS f3 FROM b0), b2 AS (SELECT *, (SELECT abs(c) FROM pc WHERE a = f1 AND b = f2) AS c12, (SELECT abs(c) FROM pc WHERE a = f1 AND b = f3) AS c13, (SELECT abs(c) FROM pc WHERE a = f2 AND b = f3) AS c23 FROM b1)"
_FROM = {
    "inverse_corr": (_CORR, "st"), "diversified": (f"{_CORR}, {_CRAMER}", "st, k2"),
    "corr_pruned": (f"{_CORR}, {_BY}, cl AS (SELECT st.factor, ic, CASE WHEN st.factor = f1 THEN true WHEN st.factor = f2 THEN c12 <= 0.7 ELSE c13 <= 0.7 AND (c12 > 0.7 OR c23 <= 0.7) END AS kept FROM st, b2)", "cl"),
    "cluster_neutral": (f"{_CORR}, {_BY}, cl AS (SELECT st.factor, ic, CASE WHEN st.factor = f1 THEN 1 WHEN st.factor = f2 THEN CASE WHEN c12 >= 0.7 THEN 1 ELSE 2 END WHEN c13 >= 0.7 OR c12 >= 0.7 AND c23 >= 0.7 THEN 1 WHEN c12 < 0.7 AND c23 >= 0.7 THEN 2 ELSE 3 END AS home FROM st, b2)", "cl"),
}
for _s in _W:
    _more, _from = _FROM.get(_s, ("", "st"))
    _top = " + ".join(f"coalesce({n}, 0) * (SELECT w FROM wn WHERE factor = '{n}')" for n in NAMES)
    _low = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN abs((SELECT w FROM wn WHERE factor = '{n}')) ELSE 0 END" for n in NAMES)
    _sql = f"WITH {_DAY}, {_STATS}, {_more + ',' if _more else ''} w0 AS (SELECT factor, {_W[_s]} AS w FROM {_from}), wn AS (SELECT factor, w / (SELECT sum(abs(w)) FROM w0) AS w FROM w0) SELECT date, security_id, round(({_top}) / nullif({_low}, 0), 6) + 0.0 AS combo FROM dd"
    add(f"combo_{_s}", _combo(_s), _sql)

add("lag_tensor", lambda spark, d: six(K.lag_tensor(daily(spark, d), ["rev", "vol"], 3).select("date", "security_id", *(F.col("tensor")[k][j].alias(f"t{k}_{n}") for k in range(3) for j, n in enumerate(("rev", "vol"))))), f"WITH {_DAY} SELECT date, security_id, {round_sql({f't{k}_{n}': f'coalesce(lag({n}, {2 - k}) OVER w, 0)' for k in range(3) for n in ('rev', 'vol')})} FROM dd WINDOW w AS (PARTITION BY security_id ORDER BY date)")
add("target_standardize", lambda spark, d: six(daily(spark, d).withColumn("target", K.standard_target(F.col("ret"))).select("date", "security_id", "target")), f"WITH {_DAY} SELECT date, security_id, round(coalesce(greatest(least((ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0), 5), -5), 0), 6) + 0.0 AS target FROM dd WINDOW w AS (PARTITION BY date)")
add("recency_weights", lambda spark, d: six(K.recency(daily(spark, d))), f"WITH {_DAY} SELECT date, round(0.75 + 0.5 * percent_rank() OVER (ORDER BY date), 6) + 0.0 AS weight FROM (SELECT DISTINCT date FROM dd)")
_TARGET = "coalesce(greatest(least((ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0), 5), -5), 0)"
add("training_weights", lambda spark, d: six(K.training_weights(daily(spark, d).withColumn("target", K.standard_target(F.col("ret"))), "target").select("date", "security_id", "train_weight")), f"""WITH {_DAY}, tg AS (SELECT date, security_id, {_TARGET} AS y FROM dd WINDOW w AS (PARTITION BY date)),
rc AS (SELECT date, 0.75 + 0.5 * percent_rank() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM dd))
SELECT date, security_id, round((1 + 0.25 * least(abs(y), 3)) * CASE WHEN n > 1 THEN r ELSE 1 END, 6) + 0.0 AS train_weight FROM tg JOIN rc USING (date)""")
add("lag_features", lambda spark, d: six(K.lag_features(daily(spark, d).select("date", "security_id", "rev"), ["rev"], 2)), f"WITH {_DAY} SELECT date, security_id, {round_sql({'rev': 'rev', 'rev__lag1': 'coalesce(lag(rev, 1) OVER w, 0)', 'rev__lag2': 'coalesce(lag(rev, 2) OVER w, 0)', 'rev__diff1': 'coalesce(rev - lag(rev, 1) OVER w, 0)', 'rev__mom2': 'coalesce(rev - lag(rev, 2) OVER w, 0)'})} FROM dd WINDOW w AS (PARTITION BY security_id ORDER BY date)")
add("combo_turnover", lambda spark, d: six(_combo_turnover(daily(spark, d))), f"WITH {_DAY}, x AS (SELECT date, rev, abs(rev - lag(rev) OVER (PARTITION BY security_id ORDER BY date)) AS ch FROM dd) SELECT date, round(coalesce(sum(ch), 0) / nullif(sum(abs(rev)), 0) * 100, 6) + 0.0 AS tvr FROM x GROUP BY 1")


def _combo_turnover(days: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    from tessella.functions.scalar import ratio

    change = F.abs(F.col("rev") - F.lag("rev").over(Window.partitionBy("security_id").orderBy("date")))
    return days.withColumn("_c", change).groupBy("date").agg((ratio(F.coalesce(F.sum("_c"), F.lit(0.0)), F.sum(F.abs("rev"))) * 100.0).alias("tvr"))


add("model_input_correlation", lambda spark, d: six(daily(spark, d).agg(*(correlation(n, "ret").alias(n) for n in NAMES))), f"WITH {_DAY} SELECT {round_sql({n: corr_sql(n, 'ret') for n in NAMES})} FROM dd")


def _ranked_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the blend by IC over its deviation goes with each of its inputs."""
    days = daily(spark, sf_dir)
    stats = _stats(days)
    scores = spark.createDataFrame([(n, s["abs_ic"]) for n, s in stats.items()], "factor string, score double")
    return six(K.input_correlations(K.blend(days, K.weights("icir", stats, None)), "combo", NAMES, scores))


_BLEND = " + ".join(f"coalesce({n}, 0) * (SELECT w FROM wn WHERE factor = '{n}')" for n in NAMES), " + ".join(f"CASE WHEN {n} IS NOT NULL THEN abs((SELECT w FROM wn WHERE factor = '{n}')) ELSE 0 END" for n in NAMES)
add("model_inputs_ranked", _ranked_inputs, f"""WITH {_DAY}, {_STATS}, w0 AS (SELECT factor, {_W['icir']} AS w FROM st), wn AS (SELECT factor, w / (SELECT sum(abs(w)) FROM w0) AS w FROM w0), cb AS (SELECT *, ({_BLEND[0]}) / nullif({_BLEND[1]}, 0) AS combo FROM dd),
pc AS ({" UNION ALL ".join(f"SELECT '{n}' AS factor, {corr_sql('combo', n)} AS corr, count(CASE WHEN combo IS NOT NULL AND {n} IS NOT NULL THEN 1 END) AS pairs FROM cb" for n in NAMES)})
SELECT factor, {round_sql({'corr': 'corr', 'abs_corr': 'abs(corr)', 'score': 'abs(ic)'})}, pairs, CAST(row_number() OVER (ORDER BY round(abs(corr), 10) DESC, abs(ic) DESC, factor DESC) AS INT) AS place FROM pc JOIN st USING (factor) WHERE pairs >= 200 AND corr IS NOT NULL""")


def _oos(model: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        feats = [f"{n}{s}" for n in NAMES for s in ("", "__lag1", "__diff1")]
        days = K.lag_features(daily(spark, sf_dir), NAMES).withColumn("target", K.standard_target(F.col("ret")))
        cut = F.lit("2024-01-20").cast("date")
        out = K.fit_predict(days.filter(F.col("date") <= cut), days.filter(F.col("date") > cut), feats, "target", model)
        return six(out.select("date", "security_id", "pred", "ret"))

    return query


for _m in ("ridge", "forest", "boosted"):
    add(f"{_m}_oos", _oos(_m))
