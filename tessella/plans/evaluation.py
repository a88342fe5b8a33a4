"""Metrics, portfolios, research and submissions of the flagship signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.dsl import formula
from tessella.operators import metrics as M
from tessella.operators import portfolio as PF
from tessella.operators import research as R
from tessella.operators import submit
from tessella.plans.catalogue import ALPHA, PANEL, RANK, RESEARCH, C, W, add, round_sql, signal, six
from tessella.plans.relations import OK_SQL
from tessella.sources import panel as P


def corr_sql(x: str, y: str, over: str = "") -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    X, Y = f"(CASE WHEN {both} THEN {x} END)", f"(CASE WHEN {both} THEN {y} END)"
    return f"CASE WHEN stddev_pop({X}) {over} > 1e-12 AND stddev_pop({Y}) {over} > 1e-12 THEN covar_pop({X}, {Y}) {over} / (stddev_pop({X}) {over} * stddev_pop({Y}) {over}) END"


IR = lambda x: f"coalesce(CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) * sqrt(252) END, 0)"
IC = f"ic AS (SELECT date, bar_idx, count(CASE WHEN alpha IS NOT NULL AND resp IS NOT NULL THEN 1 END) AS n, {corr_sql('alpha', 'resp')} AS ic FROM r GROUP BY 1, 2), di AS (SELECT date, avg(ic) AS ic FROM ic GROUP BY 1)"


def q(build):
    return lambda spark, sf_dir: six(build(signal(spark, sf_dir)))


add("bar_ic", q(M.bar_ic), f"WITH {RESEARCH}, {IC} SELECT date, bar_idx, n, round(ic, 6) + 0.0 AS ic FROM ic")
_RANKED = f"k AS (SELECT date, bar_idx, {RANK.format(x='alpha', k='bar_idx')} AS ra, {RANK.format(x='resp', k='bar_idx')} AS rr FROM r WHERE alpha IS NOT NULL AND resp IS NOT NULL)"
add("rank_ic", q(M.bar_rank_ic), f"WITH {RESEARCH}, {_RANKED} SELECT date, bar_idx, round({corr_sql('ra', 'rr')}, 6) + 0.0 AS rank_ic FROM k GROUP BY 1, 2")
add("daily_ic_ir", q(lambda s: M.daily(M.bar_ic(s), "ic").agg(F.avg("ic").alias("ic"), M.ir("ic").alias("ir"), F.count("ic").alias("days"))), f"WITH {RESEARCH}, {IC} SELECT round(avg(ic), 6) + 0.0 AS ic, round({IR('ic')}, 6) + 0.0 AS ir, count(ic) AS days FROM di")
_TURN = "tt AS (SELECT date, bar_idx, abs(alpha - lag(alpha) OVER (PARTITION BY security_id ORDER BY bar_idx)) AS ch, alpha FROM r), tb AS (SELECT date, bar_idx, coalesce(sum(ch), 0) / nullif(sum(abs(alpha)), 0) AS tvr FROM tt GROUP BY 1, 2), td AS (SELECT date, coalesce(sum(tvr), 0) AS tvr FROM tb GROUP BY 1)"


def _turn_in(col: str) -> str:
    return f"rp AS (SELECT * FROM (SELECT *, {col} AS ok, count({col}) OVER (PARTITION BY bar_idx) AS present FROM r) WHERE present > 0), tt AS (SELECT date, bar_idx, CASE WHEN lag(date) OVER (PARTITION BY security_id ORDER BY bar_idx) = date THEN abs(ok - lag(ok) OVER (PARTITION BY security_id ORDER BY bar_idx)) END AS ch, ok FROM rp), tb AS (SELECT date, bar_idx, coalesce(sum(ch), 0) / nullif(sum(abs(ok)), 0) AS tvr FROM tt GROUP BY 1, 2), td AS (SELECT date, coalesce(sum(tvr), 0) AS tvr FROM tb GROUP BY 1)"


add("turnover_overnight", q(lambda s: M.daily_turnover(M.bar_turnover(s))), f"WITH {RESEARCH}, {_TURN} SELECT date, round(tvr, 6) + 0.0 AS tvr FROM td")
add("turnover_intraday", q(lambda s: M.daily_turnover(M.bar_turnover(s, overnight=False))), f"WITH {RESEARCH}, {_turn_in('alpha')} SELECT date, round(tvr, 6) + 0.0 AS tvr FROM td")
add("book_stats", q(M.book), f"WITH {RESEARCH}, w AS (SELECT date, alpha / nullif(sum(abs(alpha)) {C}, 0) * 1e4 AS w FROM r), d AS (SELECT date, max(w) AS hi, min(w) AS lo FROM w GROUP BY 1) SELECT {round_sql({'max_weight': 'max(hi)', 'min_weight': 'min(lo)', 'avg_daily_max': 'avg(hi)', 'avg_daily_min': 'avg(lo)'})} FROM d")
add("position_stats", q(M.positions), f"WITH {RESEARCH}, x AS (SELECT date, bar_idx, coalesce(sum(CASE WHEN alpha > 0 THEN alpha END), 0) / 5000 AS bl, coalesce(sum(CASE WHEN alpha < 0 THEN alpha END), 0) / 5000 AS bs, count(CASE WHEN alpha > 0 THEN 1 END) AS nl, count(CASE WHEN alpha < 0 THEN 1 END) AS ns, count(alpha) AS nt FROM r GROUP BY 1, 2) SELECT {round_sql({k: f'avg({k})' for k in ('bl', 'bs', 'nl', 'ns', 'nt')})}, count(DISTINCT date) AS nd FROM x")
add("monthly_ic", q(lambda s: M.by_month(M.daily(M.bar_ic(s), "ic"), "ic")), f"WITH {RESEARCH}, {IC} SELECT strftime(date, '%Y-%m') AS month, round(avg(ic), 6) + 0.0 AS ic, round({IR('ic')}, 6) + 0.0 AS ir, count(ic) AS n FROM di GROUP BY 1")
add("yearly_ic", q(lambda s: M.by_year(M.daily(M.bar_ic(s), "ic"), "ic")), f"WITH {RESEARCH}, {IC} SELECT CAST(year(date) AS INT) AS year, round(avg(ic), 6) + 0.0 AS ic, round({IR('ic')}, 6) + 0.0 AS ir FROM di GROUP BY 1")
add("rolling_ic", q(lambda s: M.rolling(M.daily(M.bar_ic(s), "ic"), "ic")), f"WITH {RESEARCH}, {IC} SELECT date, round(ic, 6) + 0.0 AS ic, round(CASE WHEN count(ic) OVER w >= 10 THEN avg(ic) OVER w END, 6) + 0.0 AS ic_mean FROM di WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
add("positive_ratio", q(lambda s: M.daily(M.bar_ic(s), "ic").agg(F.avg((F.round("ic", 12) > 0).cast("double")).alias("positive"))), f"WITH {RESEARCH}, {IC} SELECT round(avg(CAST(round(ic, 12) > 0 AS DOUBLE)), 6) + 0.0 AS positive FROM di")


#: Times of day of a submission on the hourly panel.
STAMPS = ["01:00:00", "02:00:00", "03:00:00", "05:00:00", "06:00:00", "07:00:00"]


def score_sql(mode: str, stage: str, held_sql: str = OK_SQL) -> str:
    """The mode's row over a stage r0 like r, in literal numbers."""
    inside = "strftime(datetime, '%H:%M:%S') IN ('01:00:00', '02:00:00', '03:00:00', '05:00:00', '06:00:00', '07:00:00')" if mode == "submission" else "true"
    turn, scale, least = (_turn_in(OK_SQL), 100, 0.6) if mode == "submission" else (_TURN, 1, 0.006)
    ic = f"ci AS (SELECT date, bar_idx, {corr_sql('ok', 'resp')} AS ic FROM (SELECT *, {OK_SQL} AS ok FROM r) GROUP BY 1, 2), cd AS (SELECT date, avg(ic) AS ic FROM ci GROUP BY 1)"
    one = f"o AS (SELECT (SELECT avg(ic) * {scale} FROM cd) AS ic, (SELECT {IR('ic')} FROM cd) AS ir, (SELECT avg(tvr) * {scale} FROM td) AS tvr)"
    held = held_sql if mode == "submission" else "alpha"
    book = f"bw AS (SELECT date, a / nullif(sum(abs(a)) {C}, 0) * 1e4 AS w FROM (SELECT *, {held} AS a FROM r)), bd AS (SELECT date, max(w) AS hi, min(w) AS lo FROM bw GROUP BY 1), bo AS (SELECT coalesce(max(hi) < 50 AND abs(min(lo)) < 50 AND avg(hi) < 20 AND abs(avg(lo)) < 20, false) AS unconcentrated FROM bd)"
    ok = f"coalesce(ic > {least} AND ir > 2.5 AND tvr < 400 AND unconcentrated, false)"
    return f"WITH {stage}, r AS (SELECT * FROM r0 WHERE {inside}), {ic}, {turn}, {one}, {book} SELECT {round_sql({'ic': 'ic', 'ir': 'ir', 'tvr': 'tvr'})}, unconcentrated, {ok} AS passes, round(CASE WHEN {ok} THEN greatest(ic - 0.0005 * tvr, 0) * sqrt(greatest(ir, 0)) * 100 ELSE 0 END, 6) + 0.0 AS score FROM o, bo"


_R0 = RESEARCH.replace("r AS (SELECT security_id, datetime", "r0 AS (SELECT security_id, datetime")
add("score_official", q(lambda s: M.evaluate(s, mode="official")), score_sql("official", _R0))
add("score_submission", q(lambda s: M.evaluate(s, stamps=STAMPS)), score_sql("submission", _R0))

DAYS = "dy AS (SELECT date, security_id, round(avg(alpha), 10) AS pred, avg(resp) AS ret FROM r GROUP BY 1, 2 HAVING avg(alpha) IS NOT NULL AND avg(resp) IS NOT NULL)"
BASK = "bk AS (SELECT *, least(greatest(1, floor(n * 0.2)), floor(n / 2)) AS size FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY pred, security_id) AS k FROM dy)), sd AS (SELECT *, CASE WHEN k <= size THEN -1 WHEN k > n - size THEN 1 ELSE 0 END AS side FROM bk)"
PNL = "mv AS (SELECT date, weight * ret AS g, abs(weight - coalesce(lag(weight) OVER (PARTITION BY security_id ORDER BY date), 0)) AS d FROM wt), pl AS (SELECT date, sum(g) - {fee} * (sum(d) / 2) AS pnl, sum(d) / 2 AS turnover FROM mv GROUP BY 1)"
LS = "wt AS (SELECT *, coalesce(side * 0.5 / nullif(size, 0), 0) AS weight FROM sd)"


def days(s: DataFrame) -> DataFrame:
    return PF.daily_frame(s)


_pnl_cols = round_sql({"pnl": "pnl", "turnover": "turnover"})
add("quintile_long_short_pnl", q(lambda s: PF.pnl(PF.weighted(days(s)), 0.0005)), f"WITH {RESEARCH}, {DAYS}, {BASK}, {LS}, {PNL.format(fee=0.0005)} SELECT date, {_pnl_cols} FROM pl")
add("long_only_pnl", q(lambda s: PF.pnl(PF.weighted(days(s), long_only=True))), f"WITH {RESEARCH}, {DAYS}, {BASK}, wt AS (SELECT *, coalesce(CASE WHEN side = 1 THEN 1.0 / nullif(size, 0) ELSE 0 END, 0) AS weight FROM sd), {PNL.format(fee=0)} SELECT date, {_pnl_cols} FROM pl")
_CURVE = "cv AS (SELECT *, cum - max(cum) OVER (ORDER BY date) AS drawdown FROM (SELECT *, sum(pnl) OVER (ORDER BY date) AS cum FROM pl))"
add("drawdown_curve", q(lambda s: PF.curve(PF.pnl(PF.weighted(days(s)))).select("date", "cum", "drawdown")), f"WITH {RESEARCH}, {DAYS}, {BASK}, {LS}, {PNL.format(fee=0)}, {_CURVE} SELECT date, {round_sql({'cum': 'cum', 'drawdown': 'drawdown'})} FROM cv")
_RW = "rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred, security_id) - 1.0 AS rr FROM dy), rc AS (SELECT *, rr - avg(rr) OVER (PARTITION BY date) AS cc FROM rk), wt AS (SELECT *, coalesce(cc / nullif(sum(abs(cc)) OVER (PARTITION BY date), 0), 0) AS weight FROM rc)"
add("rank_weight_backtest", q(lambda s: PF.summary(PF.pnl(PF.rank_weighted(days(s))))), f"WITH {RESEARCH}, {DAYS}, {_RW}, {PNL.format(fee=0)}, {_CURVE} SELECT {round_sql({'total': 'sum(pnl)', 'sharpe': IR('pnl'), 'max_drawdown': 'min(drawdown)', 'hit': 'avg(CAST(pnl > 0 AS DOUBLE))', 'turnover': 'avg(turnover)'})} FROM cv")
_CUTS = {"train": "2024-01-12", "validation": "2024-01-20"}
add("split_metrics", q(lambda s: PF.split_metrics(days(s), _CUTS)), f"""WITH {RESEARCH}, {DAYS}, rk AS (SELECT *, {RANK.format(x='pred', k='date')} AS rp, {RANK.format(x='ret', k='date')} AS rr FROM dy), pd AS (SELECT date, {corr_sql('pred', 'ret')} AS ic, {corr_sql('rp', 'rr')} AS rank_ic, sum((pred - ret) ** 2) AS se, count(*) AS n FROM rk GROUP BY 1)
SELECT CASE WHEN date <= DATE '2024-01-12' THEN 'train' WHEN date <= DATE '2024-01-20' THEN 'validation' ELSE 'test' END AS split, {round_sql({'ic': 'avg(ic)', 'rank_ic': 'avg(rank_ic)', 'mse': 'sum(se) / sum(n)'})} FROM pd GROUP BY 1""")
_GAP = lambda c: f"avg(CASE WHEN side = 1 THEN {c} END) - avg(CASE WHEN side = -1 THEN {c} END)"
_COMPARED = {
    "mean_prediction": "avg(pred)", "mean_return": "avg(ret)", "predicted_spread": _GAP("pred"), "realized_spread": _GAP("ret"), "ic": corr_sql("pred", "ret"), "rank_ic": corr_sql("pr", "rr"),
    "pnl": "sum(side * 1.0 / size * ret)",
}
_ALIGN = lambda x, y: f"CASE WHEN stddev_samp({x}) OVER () > 0 THEN ({x} - avg({x}) OVER ()) * coalesce(stddev_samp({y}) OVER (), 0) / stddev_samp({x}) OVER () ELSE 0 END + avg({y}) OVER ()"
add("prediction_comparison", q(lambda s: PF.comparison(days(s))), f"""WITH {RESEARCH}, {DAYS}, {BASK}, rk AS (SELECT *, {RANK.format(x="pred", k="date")} AS pr, {RANK.format(x="ret", k="date")} AS rr FROM sd),
dc AS (SELECT date, {', '.join(f'CASE WHEN count(*) >= 20 THEN coalesce({v}, 0) ELSE 0 END AS {c}' for c, v in _COMPARED.items())} FROM rk GROUP BY 1)
SELECT date, {round_sql({c: c for c in _COMPARED} | {'mean_prediction_aligned': _ALIGN('mean_prediction', 'mean_return'), 'predicted_spread_aligned': _ALIGN('predicted_spread', 'realized_spread')})} FROM dc""")
add("quintile_spread_curve", q(lambda s: PF.spread(days(s))), f"WITH {RESEARCH}, {DAYS}, {BASK} SELECT date, {round_sql({'pred': 'avg(pred)', 'ret': 'avg(ret)', 'top': 'avg(CASE WHEN side = 1 THEN ret END)', 'bottom': 'avg(CASE WHEN side = -1 THEN ret END)', 'spread': 'avg(CASE WHEN side = 1 THEN ret END) - avg(CASE WHEN side = -1 THEN ret END)'})} FROM sd GROUP BY 1")

_Q = {"mean": "avg(alpha)", "std": "stddev_samp(alpha)", "skew": "skewness(alpha)", "kurt": "kurtosis(alpha)", "min": "min(alpha)", "max": "max(alpha)"} | {f"p{round(x * 100)}": f"quantile_cont(alpha, {x})" for x in (0.01, 0.05, 0.5, 0.95, 0.99)}
add("alpha_distribution", q(R.distribution), f"WITH {RESEARCH} SELECT {round_sql(_Q | {'missing': 'avg(CAST(alpha IS NULL AS DOUBLE))', 'positive': 'avg(CAST(alpha > 0 AS DOUBLE))', 'inner': 'avg(CAST(abs(alpha) <= 0.5 AS DOUBLE))'})} FROM r".replace(" AS inner", ' AS "inner"'))
add("alpha_histogram", lambda spark, d: R.histogram(signal(spark, d), "volume"), f"WITH {RESEARCH}, s AS (SELECT min(volume) AS lo, max(volume) AS hi FROM r) SELECT CAST(least(floor((volume - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n FROM r, s WHERE volume IS NOT NULL GROUP BY 1")
add("temporal_coverage", q(R.coverage), f"WITH {RESEARCH}, x AS (SELECT date, bar_idx, avg(alpha) AS mean, stddev_samp(alpha) AS std, avg(CAST(alpha IS NOT NULL AS DOUBLE)) AS coverage FROM r GROUP BY 1, 2) SELECT date, {round_sql({k: f'avg({k})' for k in ('mean', 'std', 'coverage')})} FROM x GROUP BY 1")
_DAYS_SQL = f"x AS (SELECT date, bar_idx, {corr_sql('alpha', 'resp')} AS ic, avg(resp) AS market, stddev_samp(resp) AS vol FROM r GROUP BY 1, 2)"
add("regime_ic", q(R.regimes), f"""WITH {RESEARCH}, {_DAYS_SQL}, d AS (SELECT date, avg(ic) AS ic, round(avg(market), 10) AS market, round(avg(vol), 10) AS vol FROM x GROUP BY 1),
f AS (SELECT ic, CASE WHEN market >= 0 THEN 'up' ELSE 'down' END AS regime FROM d UNION ALL SELECT ic, CASE WHEN vol >= (SELECT quantile_cont(vol, 0.5) FROM d) THEN 'high_vol' ELSE 'low_vol' END FROM d
UNION ALL SELECT ic, CASE WHEN abs(market) >= (SELECT quantile_cont(abs(market), 0.5) FROM d) THEN 'trend' ELSE 'chop' END FROM d) SELECT regime, round(avg(ic), 6) + 0.0 AS ic, count(ic) AS days FROM f GROUP BY 1""")
add("monthly_market_state", q(M.monthly_state), f"""WITH {RESEARCH}, {_DAYS_SQL}, d AS (SELECT date, avg(ic) AS ic, avg(market) AS market, avg(vol) AS vol FROM x GROUP BY 1), m AS (SELECT strftime(date, '%Y-%m') AS month, avg(ic) AS ic, avg(market) * 100 AS market_ret, avg(vol) AS vol, avg(abs(market)) * 100 AS market_abs_move FROM d GROUP BY 1)
SELECT month, {round_sql({'ic': 'ic', 'market_ret': 'market_ret', 'market_vol': 'vol / ((SELECT quantile_cont(vol, 0.9) FROM m) + 1e-9)', 'market_abs_move': 'market_abs_move'})} FROM m""")
add("yearly_turnover", q(lambda s: M.daily_turnover(M.bar_turnover(s)).groupBy(F.year("date").alias("year")).agg(F.avg("tvr").alias("tvr"))), f"WITH {RESEARCH}, {_TURN} SELECT CAST(year(date) AS INT) AS year, round(avg(tvr), 6) + 0.0 AS tvr FROM td GROUP BY 1")
add("positive_month_ratio", q(lambda s: M.by_month(M.daily(M.bar_ic(s), "ic"), "ic").agg(F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count("*").alias("months"))), f"WITH {RESEARCH}, {IC}, m AS (SELECT strftime(date, '%Y-%m') AS month, avg(ic) AS ic FROM di GROUP BY 1) SELECT round(avg(CAST(ic > 0 AS DOUBLE)), 6) + 0.0 AS positive, count(*) AS months FROM m")
add("extreme_share", q(lambda s: s.agg(F.avg((F.abs("alpha") > 0.45).cast("double")).alias("extreme"), F.count("alpha").alias("n"))), f"WITH {RESEARCH} SELECT round(avg(CAST(abs(alpha) > 0.45 AS DOUBLE)), 6) + 0.0 AS extreme, count(alpha) AS n FROM r")
_THREE = {"rev": ALPHA, "mom": "pct_rank(delta(close_trade_px, 3))", "vol": "pct_rank(ts_mean(volume, 5))"}
_THREE_SQL = f"""{PANEL}, s0 AS (SELECT *, -(close_trade_px / vwap - 1) AS x1, close_trade_px - lag(close_trade_px, 3) OVER (PARTITION BY security_id ORDER BY bar_idx) AS x2, avg(volume) {W(5)} AS x3 FROM p),
s3 AS (SELECT security_id, bar_idx, date, {', '.join(f"({RANK.format(x=x, k='bar_idx')}) / count({x}) OVER (PARTITION BY bar_idx) - 0.5 AS {n}" for x, n in (('x1', 'rev'), ('x2', 'mom'), ('x3', 'vol')))} FROM s0)"""


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula.evaluate(P.event_panel(spark, sf_dir), _THREE)


_PAIRS = f"pb AS (SELECT bar_idx, {', '.join(f'CASE WHEN count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) >= 5 THEN {corr_sql(a, b)} END AS {a}_{b}' for a, b in (('rev', 'mom'), ('rev', 'vol'), ('mom', 'vol')))} FROM s3 GROUP BY 1), pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, avg({a}_{b}) AS corr, count({a}_{b}) AS bars FROM pb" for a, b in (("rev", "mom"), ("rev", "vol"), ("mom", "vol"))) + ")"
add("pairwise_bar_corr", lambda spark, d: six(R.pairwise(three(spark, d), list(_THREE), 5)), f"WITH {_THREE_SQL}, {_PAIRS} SELECT a, b, round(corr, 6) + 0.0 AS corr, bars FROM pr")
add("prior_corr_trend", lambda spark, d: six(R.prior_correlation(R.pairwise(three(spark, d), list(_THREE), 5), list(_THREE))), f"WITH {_THREE_SQL}, {_PAIRS} SELECT b AS signal, {round_sql({'avg_corr': 'avg(corr)', 'max_corr': 'max(corr)', 'min_corr': 'min(corr)'})} FROM pr GROUP BY 1")


def _low_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(r.a, r.b, r["corr"]) for r in R.pairwise(three(spark, sf_dir), list(_THREE), 5).collect()]  # k x k numbers
    chosen = R.low_correlation_set(pairs, {"rev": 3.0, "mom": 2.0, "vol": 1.0}, 0.3)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "place int, signal string")


add("low_corr_set", _low_corr, f"""WITH {_THREE_SQL}, {_PAIRS}, c AS (SELECT a, b, coalesce(abs(corr), 0) <= 0.3 AS ok FROM pr), o AS (SELECT bool_and(ok) AS all_ok, bool_or(ok) AS any_ok, bool_or(ok AND a = 'rev' AND b = 'mom') AS rm, bool_or(ok AND a = 'rev' AND b = 'vol') AS rv FROM c),
m AS (SELECT unnest(CASE WHEN all_ok THEN ['rev', 'mom', 'vol'] WHEN rm THEN ['rev', 'mom'] WHEN rv THEN ['rev', 'vol'] WHEN any_ok THEN ['mom', 'vol'] ELSE ['rev'] END) AS signal FROM o) SELECT CAST(row_number() OVER (ORDER BY CASE signal WHEN 'rev' THEN 1 WHEN 'mom' THEN 2 ELSE 3 END) AS INT) AS place, signal FROM m""")
_ZP = "zz AS (SELECT " + ", ".join(f"({n} - avg({n}) OVER (PARTITION BY bar_idx)) / nullif(stddev_samp({n}) OVER (PARTITION BY bar_idx), 0) AS {n}" for n in ("rev", "mom", "vol")) + " FROM s3), zp AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS corr, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM zz" for a, b in (("rev", "mom"), ("rev", "vol"), ("mom", "vol"))) + ")"
add("pooled_corr_matrix", lambda spark, d: six(R.pooled(three(spark, d), list(_THREE))), f"WITH {_THREE_SQL}, {_ZP} SELECT a, b, round(CASE WHEN n >= 200 THEN corr END, 6) + 0.0 AS corr, n FROM zp")
add("nearest_signals", lambda spark, d: six(R.neighbours(R.pooled(three(spark, d), list(_THREE)))), f"""WITH {_THREE_SQL}, {_ZP}, nb AS (SELECT a AS signal, b AS other, corr FROM zp WHERE n >= 200 UNION ALL SELECT b, a, corr FROM zp WHERE n >= 200)
SELECT signal, other, round(corr, 6) + 0.0 AS corr, CAST(row_number() OVER (PARTITION BY signal ORDER BY abs(corr) DESC, other) AS INT) AS place FROM nb WHERE corr IS NOT NULL""")
_SHADOW = f"""f0 AS MATERIALIZED (SELECT security_id, bar_idx, alpha AS x FROM r0),
ew(security_id, bar_idx, n, d, y, w) AS (SELECT security_id, bar_idx, coalesce(x, 0)::DOUBLE, CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, x, 1.0::DOUBLE FROM f0 WHERE bar_idx = 1 UNION ALL
  SELECT f.security_id, f.bar_idx, e.n * (9/11.0) + coalesce(f.x, 0), e.d * (9/11.0) + CASE WHEN f.x IS NULL THEN 0 ELSE 1 END,
  CASE WHEN e.y IS NULL THEN f.x WHEN f.x IS NULL THEN e.y ELSE (e.w * 0.8 * e.y + f.x * 0.2) / (e.w * 0.8 + 0.2) END, CASE WHEN f.x IS NULL AND e.y IS NOT NULL THEN e.w * 0.8 ELSE 1.0 END FROM ew e JOIN f0 f ON f.security_id = e.security_id AND f.bar_idx = e.bar_idx + 1),
s1 AS (SELECT r0.*, round(n / nullif(d, 0), 12) AS a1, round(y, 12) AS a2, CASE WHEN alpha <= quantile_cont(alpha, 0.2) {C} OR alpha >= quantile_cont(alpha, 0.8) {C} THEN alpha ELSE 0 END AS a3, round(avg(alpha) {W(15)}, 12) AS a4 FROM r0 JOIN ew USING (security_id, bar_idx))"""
_SMOOTH = {"ema_10": "a1", "persistence_02": "a2", "extremes_q20": "a3", "rolling_15": "a4"}
_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT '{n}' AS smoother, date, datetime, bar_idx, security_id, resp, trading_restriction, ({RANK.format(x=a, k='bar_idx')}) / count({a}) {C} - 0.5 AS alpha FROM s1" for n, a in _SMOOTH.items()) + ")"
_RESCUE_SQL = f"""WITH RECURSIVE {_R0}, {_SHADOW}, {_LONG}, eb AS (SELECT smoother, bar_idx, coalesce(sum(c), 0) / nullif(sum(abs(alpha)), 0) AS r FROM (SELECT *, abs(alpha - lag(alpha) OVER (PARTITION BY smoother, security_id ORDER BY bar_idx)) AS c FROM lg) GROUP BY 1, 2), es AS (SELECT smoother, round(avg(r) * 1e4, 6) AS estimate FROM eb GROUP BY 1),
sl AS (SELECT *, {OK_SQL} AS ok FROM lg WHERE strftime(datetime, '%H:%M:%S') IN {tuple(STAMPS)}), sp AS (SELECT * FROM (SELECT *, count(ok) OVER (PARTITION BY smoother, bar_idx) AS present FROM sl) WHERE present > 0),
sc AS (SELECT smoother, date, bar_idx, CASE WHEN lag(date) OVER e = date THEN abs(ok - lag(ok) OVER e) END AS ch, ok FROM sp WINDOW e AS (PARTITION BY smoother, security_id ORDER BY bar_idx)),
st AS (SELECT smoother, avg(tvr) * 100 AS tvr FROM (SELECT smoother, date, coalesce(sum(tvr), 0) AS tvr FROM (SELECT smoother, date, bar_idx, coalesce(sum(ch), 0) / nullif(sum(abs(ok)), 0) AS tvr FROM sc GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
si AS (SELECT smoother, avg(ic) * 100 AS ic, {IR('ic')} AS ir FROM (SELECT smoother, date, avg(ic) AS ic FROM (SELECT smoother, date, bar_idx, {corr_sql('ok', 'resp')} AS ic FROM sl GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
fo AS (SELECT smoother, estimate, ic, ir, tvr, coalesce(tvr <= 380 AND ic >= 0.10, false) AS fits, CAST(row_number() OVER (ORDER BY estimate, smoother) AS INT) AS place FROM es JOIN st USING (smoother) JOIN si USING (smoother)),
fc AS (SELECT *, fits AND sum(CAST(fits AS INT)) OVER (ORDER BY place) = 1 AS chosen FROM fo)"""


def _rounded(s: DataFrame) -> dict[str, str]:
    """The smoothers, with what is ranked rounded to twelve places, so that ties don't hang on the order of summation."""
    return {n: f.replace("pct_rank(", "pct_rank(twelve(", 1) + ")" for n, f in R.SMOOTHERS.items()}


def _rescue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = signal(spark, sf_dir)
    return R.rescue(s, STAMPS, _rounded(s))


def _rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal by the first smoother that keeps turnover and IC within the limits; no row if none does."""
    table, smooth = _rescue(spark, sf_dir)
    chosen = table.filter("chosen").select("smoother").first()
    out = smooth.select("security_id", "bar_idx", F.col(chosen.smoother if chosen else "alpha").alias("alpha"))
    return six(out if chosen else out.filter("false"))


add("tvr_rescue_rank", lambda spark, d: six(_rescue(spark, d)[0]), f"{_RESCUE_SQL} SELECT smoother, place, fits, chosen, {round_sql({k: k for k in ('estimate', 'ic', 'ir', 'tvr')})} FROM fc")
add("tvr_rescued_signal", _rescued, f"{_RESCUE_SQL} SELECT security_id, bar_idx, round(alpha, 6) + 0.0 AS alpha FROM lg JOIN fc USING (smoother) WHERE chosen")


def _submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    return submit.submission(s, P.universe(s), STAMPS)


_UNIVERSE = "(SELECT DISTINCT date, security_id FROM r WHERE (security_id + day(date)) % 10 <> 0)"
_GRID = f"sb AS (SELECT strftime(u.date, '%Y-%m-%d') AS date, strftime(u.date, '%Y-%m-%d') || ' ' || s.stamp AS datetime, u.security_id, CAST(coalesce(greatest(least(alpha, 1), -1), 0) AS FLOAT) AS alpha FROM {_UNIVERSE} u CROSS JOIN (SELECT unnest({STAMPS}) AS stamp) s LEFT JOIN r ON r.date = u.date AND r.security_id = u.security_id AND strftime(r.datetime, '%H:%M:%S') = s.stamp)"
add("submission_grid", lambda spark, d: six(_submission(spark, d)), f"WITH {RESEARCH}, {_GRID} SELECT date, datetime, security_id, round(alpha, 6) + 0.0 AS alpha FROM sb")
add("sanity_report", lambda spark, d: submit.sanity(_submission(spark, d), P.event_panel(spark, d), len(STAMPS), P.universe(signal(spark, d)), STAMPS), f"""WITH {RESEARCH}, {_GRID}, o AS (SELECT count(*) AS rows, count(CASE WHEN abs(alpha) > 1 THEN 1 END) AS out_of_bounds, count(*) - count(alpha) AS nulls, count(DISTINCT alpha) <= 1 AS constant FROM sb),
d AS (SELECT date, count(DISTINCT datetime) AS bars FROM sb GROUP BY 1), x AS (SELECT *, (SELECT count(*) FROM (SELECT 1 FROM sb GROUP BY date, datetime, security_id HAVING count(*) > 1)) AS duplicates, (SELECT min(bars) FROM d) AS min_bars, (SELECT max(bars) FROM d) AS max_bars, (SELECT count(DISTINCT date) FROM p WHERE strftime(date, '%Y-%m-%d') NOT IN (SELECT date FROM d)) AS missing_days,
  (SELECT count(*) FROM sb WHERE substr(datetime, 12) NOT IN {tuple(STAMPS)} OR (date, security_id) NOT IN (SELECT (strftime(date, '%Y-%m-%d'), security_id) FROM {_UNIVERSE})) AS outside FROM o)
SELECT *, duplicates + out_of_bounds + nulls + missing_days + outside = 0 AND NOT constant AND min_bars = {len(STAMPS)} AND max_bars = {len(STAMPS)} AS ready FROM x""")
add("data_compliance", q(submit.compliance), f"""WITH {RESEARCH}, o AS (SELECT count(*) AS rows, avg(CAST(alpha IS NULL AS DOUBLE)) AS missing, count(CASE WHEN abs(alpha) > 100 THEN 1 END) AS unbounded, count(DISTINCT alpha) AS distinct_values, max(abs(alpha)) / sum(abs(alpha)) AS largest_share, count(CASE WHEN minute(datetime) NOT IN (0, 15, 30, 45) THEN 1 END) AS off_grid, (SELECT avg(CAST(n > 0 AS DOUBLE)) FROM (SELECT date, count(alpha) AS n FROM r GROUP BY 1)) AS coverage FROM r)
SELECT rows, unbounded, distinct_values, off_grid, {round_sql({k: k for k in ('missing', 'largest_share', 'coverage')})}, rows > 0 AND off_grid = 0 AND unbounded = 0 AND distinct_values > 1 AND coverage > 0.95 AND missing < 0.5 AND largest_share < 0.1 AS compliant FROM o""")


# --- many stored submissions at once
def by_run_sql(src: str, key: str) -> str:
    """Stages st (turnover), si (ic, ir) and bo (book) of submissions in src, by key."""
    return f"""sl AS (SELECT *, {OK_SQL} AS ok FROM {src}), sp AS (SELECT * FROM (SELECT *, count(ok) OVER (PARTITION BY {key}, bar_idx) AS present FROM sl) WHERE present > 0),
sc AS (SELECT {key}, date, bar_idx, CASE WHEN lag(date) OVER e = date THEN abs(ok - lag(ok) OVER e) END AS ch, ok FROM sp WINDOW e AS (PARTITION BY {key}, security_id ORDER BY bar_idx)),
sb AS (SELECT {key}, date, bar_idx, coalesce(sum(ch), 0) / nullif(sum(abs(ok)), 0) AS tvr, max(ok) / nullif(sum(abs(ok)), 0) * 1e4 AS hi, min(ok) / nullif(sum(abs(ok)), 0) * 1e4 AS lo FROM sc GROUP BY 1, 2, 3),
sd AS (SELECT {key}, date, coalesce(sum(tvr), 0) AS tvr, max(hi) AS hi, min(lo) AS lo FROM sb GROUP BY 1, 2), st AS (SELECT {key}, avg(tvr) * 100 AS tvr, coalesce(max(hi) < 50 AND abs(min(lo)) < 50 AND avg(hi) < 20 AND abs(avg(lo)) < 20, false) AS unconcentrated FROM sd GROUP BY 1),
si AS (SELECT {key}, avg(ic) * 100 AS ic, {IR('ic')} AS ir FROM (SELECT {key}, date, avg(ic) AS ic FROM (SELECT {key}, date, bar_idx, {corr_sql('ok', 'resp')} AS ic FROM sl GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)"""


def _exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(submissions of three signals, the panel)."""
    panel = formula.evaluate(P.research_panel(spark, sf_dir).withColumnRenamed("resp", "ahead"), _THREE).withColumnRenamed("ahead", "resp")
    inside = P.universe(panel)
    runs = [submit.submission(panel.withColumn("alpha", F.col(n)), inside, STAMPS).withColumn("run_id", F.lit(n)) for n in _THREE]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]), panel


def _recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library of four runs after a recheck of the three whose submissions are there."""
    exports, panel = _exports(spark, sf_dir)
    library = spark.createDataFrame([("rev", 1, True, 9.0), ("mom", 1, False, 0.0), ("gone", 2, True, 5.0)], "run_id string, generation int, passes boolean, score double")
    return six(submit.updated(library, submit.recheck(exports, panel)))


_OK_RUN = "coalesce(ic > 0.6 AND ir > 2.5 AND tvr < 400 AND unconcentrated, false)"
add("reevaluate_exports", _recheck, f"""WITH {_THREE_SQL}, r0 AS (SELECT p.security_id, p.datetime, p.date, p.bar_idx, lead(close_trade_px, 24) OVER (PARTITION BY p.security_id ORDER BY p.bar_idx) / nullif(close_trade_px, 0) - 1 AS resp,
  CASE WHEN (p.security_id * 7 + hour(datetime) * 3 + day(datetime)) % 11 IN (1, 2, 3) THEN (p.security_id * 7 + hour(datetime) * 3 + day(datetime)) % 11 ELSE 0 END AS trading_restriction, rev, mom, vol FROM p JOIN s3 USING (security_id, bar_idx)),
u AS (SELECT DISTINCT date, security_id FROM p WHERE (security_id + day(date)) % 10 <> 0), sx AS (SELECT r0.* FROM r0 JOIN u ON u.date = r0.date AND u.security_id = r0.security_id WHERE strftime(datetime, '%H:%M:%S') IN {tuple(STAMPS)}),
lx AS ({' UNION ALL '.join(f"SELECT '{n}' AS run_id, date, datetime, bar_idx, security_id, resp, trading_restriction, CAST(CAST(coalesce(greatest(least({n}, 1), -1), 0) AS FLOAT) AS DOUBLE) AS alpha FROM sx" for n in _THREE)}), {by_run_sql('lx', 'run_id')},
fo AS (SELECT run_id, ic, ir, tvr, {_OK_RUN} AS passes, CASE WHEN {_OK_RUN} THEN greatest(ic - 0.0005 * tvr, 0) * sqrt(greatest(ir, 0)) * 100 ELSE 0 END AS score FROM si JOIN st USING (run_id)),
li AS (SELECT * FROM (VALUES ('rev', 1), ('mom', 1), ('gone', 2)) AS t(run_id, generation))
SELECT run_id, generation, coalesce(passes, false) AS passes, round(coalesce(score, 0), 6) + 0.0 AS score, CASE WHEN passes IS NULL THEN 'recompute_error' ELSE 'ok' END AS status, {round_sql({k: k for k in ('ic', 'ir', 'tvr')})} FROM li FULL JOIN fo USING (run_id)""")
