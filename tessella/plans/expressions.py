"""Scalar, time-series and cross-sectional formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.dsl import catalog, formula
from tessella.operators import postprocess
from tessella.plans.catalogue import DIV, PANEL, RANK, C, E, W, add, formulas, round_sql, six
from tessella.sources import panel as P

c, v, d = "close_trade_px", "volume", "(close_trade_px - open_trade_px)"
D = "close_trade_px - open_trade_px"

formulas("scalar_safe_div", {"a": (f"div({c}, {v})", DIV(c, v)), "b": (f"{c} / {v}", f"{c} / nullif({v}, 0)"), "n": (f"neg({c})", f"-{c}"), "s": (f"add({c}, mul({v}, sub({c}, 1)))", f"{c} + {v} * ({c} - 1)")})
formulas("scalar_signed_power", {"a": (f"pow({D}, 2)", f"sign({d}) * power(abs({d}), 2)"), "b": (f"signed_power({D}, 0.5)", f"sign({d}) * power(abs({d}), 0.5)")})
formulas("scalar_logs", {"a": (f"signed_log({D})", f"sign({d}) * ln(1 + abs({d}))"), "b": (f"log({D})", f"ln(1 + abs({d}))"), "r": (f"sqrt({D})", f"sqrt(abs({d}))"), "m": (f"abs({D})", f"abs({d})"), "s": (f"sign({D})", f"CAST(sign({d}) AS DOUBLE)")})
formulas("scalar_sigmoid_tanh", {"a": (f"sigmoid({D})", f"1 / (1 + exp(-CASE WHEN {d} < -50 THEN -50 WHEN {d} > 50 THEN 50 ELSE {d} END))"), "b": (f"tanh({D})", f"tanh({d})")})
formulas("scalar_clip_minmax", {"a": (f"clip({D}, -5, 5)", f"CASE WHEN {d} < -5 THEN -5 WHEN {d} > 5 THEN 5 ELSE {d} END"), "lo": (f"min_of({c}, vwap)", f"CASE WHEN {c} IS NOT NULL AND vwap IS NOT NULL THEN least({c}, vwap) END"), "hi": (f"max_of({c}, vwap)", f"CASE WHEN {c} IS NOT NULL AND vwap IS NOT NULL THEN greatest({c}, vwap) END")})
truth = lambda x: f"coalesce(CAST(({x}) AS DOUBLE), 0)"
formulas("cond_compare", {"g": (f"gt({c}, vwap)", truth(f"{c} > vwap")), "h": (f"ge({c}, vwap)", truth(f"{c} >= vwap")), "l": (f"{c} < vwap", truth(f"{c} < vwap")), "m": (f"le({c}, vwap)", truth(f"{c} <= vwap")), "q": (f"eq({c}, open_trade_px)", truth(f"abs({d}) <= 1e-8"))})
pos = lambda x: f"coalesce({x} > 0, false)"
formulas("cond_logic_ifelse", {"i": (f"ifelse({D}, {c}, vwap)", f"CASE WHEN {pos(d)} THEN {c} ELSE vwap END"), "a": (f"and_op({D}, {v})", f"CAST({pos(d)} AND {pos(v)} AS DOUBLE)"), "o": (f"or_op({D}, {v})", f"CAST({pos(d)} OR {pos(v)} AS DOUBLE)"), "n": (f"not_op({D})", truth(f"{d} <= 0"))})
formulas("blend_mean_weighted", {"m": (f"mean_of({c}, vwap, {v})", f"({c} + vwap + {v}) / 3"), "w": (f"weighted_sum(2, {c}, -1, vwap)", f"(2 * {c} - vwap) / (3 + 1e-8)")})

formulas("ts_lag_delta_pct", {"l": (f"lag({c}, 3)", f"lag({c}, 3) {E}"), "d": (f"delta({c}, 2)", f"{c} - lag({c}, 2) {E}"), "p": (f"ts_pct_change({c}, 1)", f"{DIV(c, f'lag({c}, 1) {E}')} - 1"), "y": (f"delay({v})", f"lag({v}, 1) {E}")})
formulas("ts_mean_sum_min_max", {"m": (f"ts_mean({c}, 5)", f"avg({c}) {W(5)}"), "s": (f"ts_sum({v}, 5)", f"sum({v}) {W(5)}"), "lo": (f"ts_min({c}, 8)", f"min({c}) {W(8)}"), "hi": (f"ts_max({c}, 8)", f"max({c}) {W(8)}")})
formulas("ts_std_zscore", {"s": (f"ts_std({c}, 10)", f"stddev_samp({c}) {W(10)}"), "z": (f"ts_zscore({c}, 10)", DIV(f"{c} - avg({c}) {W(10)}", f"stddev_samp({c}) {W(10)}"))})
formulas("ts_median_quantile", {"m": (f"ts_median({c}, 7)", f"quantile_cont({c}, 0.5) {W(7)}"), "q": (f"ts_quantile({c}, 9, 0.8)", f"quantile_cont({c}, 0.8) {W(9)}")})
flat = lambda x, n, least, f, k: f"CASE WHEN count({x}) {W(n)} >= {least} THEN CASE WHEN max({x}) {W(n)} = min({x}) {W(n)} THEN {k} ELSE {f}({x}) {W(n)} END END"
formulas("ts_skew_kurt", {"s": (f"ts_skew({c}, 12)", flat(c, 12, 3, "skewness", 0.0)), "k": (f"ts_kurt({c}, 12)", flat(c, 12, 4, "kurtosis", -3.0))})
formulas("ts_minmax_norm", {"n": (f"ts_minmax_norm({c}, 6)", DIV(f"{c} - min({c}) {W(6)}", f"max({c}) {W(6)} - min({c}) {W(6)}"))})
both = "(SELECT *, CASE WHEN close_trade_px IS NOT NULL AND vwap IS NOT NULL THEN close_trade_px END AS x, CASE WHEN close_trade_px IS NOT NULL AND vwap IS NOT NULL THEN vwap END AS y FROM p)"
formulas("ts_cov_corr", {"v": (f"ts_cov({c}, vwap, 10)", f"CASE WHEN count(x) {W(10)} >= 2 THEN covar_samp(x, y) {W(10)} END"), "r": (f"ts_corr({c}, vwap, 10)", f"CASE WHEN count(x) {W(10)} >= 2 AND stddev_pop(x) {W(10)} > 1e-12 AND stddev_pop(y) {W(10)} > 1e-12 THEN covar_pop(x, y) {W(10)} / (stddev_pop(x) {W(10)} * stddev_pop(y) {W(10)}) END")}, both)
slots = lambda n: f"(SELECT *, list(close_trade_px) {W(n)} AS w FROM p)"
seen = "list_filter(w, lambda z: z IS NOT NULL)"
formulas("ts_rank", {"r": (f"ts_rank({c}, 8)", f"CASE WHEN {c} IS NOT NULL AND len({seen}) >= 4 THEN (len(list_filter(w, lambda z: z < {c})) + (len(list_filter(w, lambda z: z = {c})) + 1) / 2.0) / len({seen}) END")}, slots(8))
formulas("ts_decay_linear", {"d": (f"ts_decay_linear({c}, 4)", f"({c} * 4 + lag({c}, 1) {E} * 3 + lag({c}, 2) {E} * 2 + lag({c}, 3) {E}) / 10.0"), "e": (f"decay_linear({c}, 2)", f"({c} * 2 + lag({c}, 1) {E}) / 3.0")})
formulas("ts_argmax_argmin", {"hi": (f"ts_argmax({c}, 6)", f"CASE WHEN len({seen}) > 0 THEN CAST(list_position(w, list_max({seen})) AS DOUBLE) END"), "lo": (f"ts_argmin({c}, 6)", f"CASE WHEN len({seen}) > 0 THEN CAST(list_position(w, list_min({seen})) AS DOUBLE) END")}, slots(6))

cr = lambda x: RANK.format(x=x, k="bar_idx")
unit = lambda x: f"(({cr(x)}) - 1.0) / nullif(count({x}) {C} - 1, 0)"
formulas("cs_rank", {"r": (f"cs_rank({c})", unit(c)), "s": (f"rank({v})", unit(v))})
formulas("cs_demean_zscore", {"d": (f"cs_demean({c})", f"{c} - avg({c}) {C}"), "z": (f"zscore({c})", f"({c} - avg({c}) {C}) / (stddev_pop({c}) {C} + 1e-8)")})
formulas("cs_scale", {"s": (f"cs_scale({c})", f"x / nullif(sum(abs(x)) {C}, 0)")}, f"(SELECT *, {c} - avg({c}) {C} AS x FROM p)")
clamp = lambda x, lo, hi: f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"
qc = lambda x, q: f"quantile_cont({x}, {q}) {C}"
formulas("cs_winsorize", {"w": (f"cs_winsorize({c}, 0.1)", clamp(c, qc(c, 0.1), qc(c, 0.9)))})
formulas("cs_quantile", {"q": (f"cs_quantile({c}, 0.25)", f"{c} - {qc(c, 0.25)}"), "m": (f"cs_quantile({c})", f"{c} - {qc(c, 0.5)}")})
formulas("cs_neutralize", {"n": (f"cs_neutralize({c}, {v})", f"x - sum(x * y) {C} / (sum(y * y) {C} + 1e-8) * y")}, f"(SELECT *, {c} - avg({c}) {C} AS x, {v} - avg({v}) {C} AS y FROM p)")
formulas("combine_rank", {"r": (f"combine_rank({c}, {v}, vwap)", f"({unit(c)} + {unit(v)} + {unit('vwap')}) / 3")})
formulas("pct_rank_centered", {"r": (f"pct_rank({c})", f"({cr(c)}) / count({c}) {C} - 0.5")})
formulas("mad_winsorize", {"w": (f"mad_winsorize({c}, 2)", clamp(c, f"m - 2 * (quantile_cont(abs({c} - m), 0.5) {C} + 1e-8)", f"m + 2 * (quantile_cont(abs({c} - m), 0.5) {C} + 1e-8)"))}, f"(SELECT *, {qc(c, 0.5)} AS m FROM p)")
z = f"(({c} - avg({c}) {C}) / nullif(stddev_samp({c}) {C}, 0))"
formulas("zscore_clip", {"z": (f"zclip({c})", f"CASE WHEN {z} IS NOT NULL THEN greatest(least({z}, 3.0), -3.0) / 3.0 END")})
formulas("weight_cap", {"w": (f"weight_cap({D}, 0.15)", clamp("x", "-0.15", "0.15"))}, f"(SELECT *, {d} / nullif(sum(abs({d})) {C}, 0) AS x FROM p)")
formulas("cs_extremes", {"x": (f"cs_extremes({D}, 0.2)", f"CASE WHEN {d} <= {qc(d, 0.2)} OR {d} >= {qc(d, 0.8)} THEN {d} WHEN {d} IS NOT NULL THEN 0 END")})

rev = f"(SELECT *, -({c} / vwap - 1) AS x FROM p)"
formulas("formula_vwap_reversal", {"alpha": ("cs_rank(-(close_trade_px / vwap - 1))", unit("x"))}, rev)
formulas("formula_decay_momentum", {"alpha": (f"cs_rank(ts_decay_linear(delta({c}, 1), 3))", unit("x"))}, f"(SELECT *, (y * 3 + lag(y, 1) {E} * 2 + lag(y, 2) {E}) / 6.0 AS x FROM (SELECT *, {c} - lag({c}, 1) {E} AS y FROM p))")
formulas("formula_conditional_volume", {"alpha": (f"ifelse({v} > ts_mean({v}, 10), cs_rank({D}), 0 - cs_rank({D}))", f"CASE WHEN coalesce({v} > m, false) THEN k ELSE 0 - k END")}, f"(SELECT *, avg({v}) {W(10)} AS m, {unit(d)} AS k FROM p)")
formulas("formula_multi_horizon", {"alpha": (f"0.5 * cs_rank(ts_mean({c}, 3)) + 0.3 * cs_rank(ts_mean({c}, 10)) - 0.2 * cs_zscore(ts_std({c}, 5))", f"0.5 * {unit('a')} + 0.3 * {unit('b')} - 0.2 * ((s - avg(s) {C}) / (stddev_pop(s) {C} + 1e-8))")}, f"(SELECT *, avg({c}) {W(3)} AS a, avg({c}) {W(10)} AS b, stddev_samp({c}) {W(5)} AS s FROM p)")
formulas("template_grid_batch", {k: (f, f"{sql} {W(int(k.split('_')[-1]))}") for (k, f), sql in zip(formula.grid("{op}({x}, {n})", op=["ts_mean", "ts_sum"], x=["close_trade_px", "volume"], n=[3, 6]).items(), [f"{a}({x})" for a in ("avg", "sum") for x in (c, v) for _ in (3, 6)], strict=True)})
formulas("derived_fields", {"r": ("range_pct", DIV("high_trade_px - low_trade_px", c)), "g": ("vwap_gap", f"{DIV(c, 'vwap')} - 1"), "m": ("mid_px", "(high_trade_px + low_trade_px) / 2"), "t": ("ts_mean(ret_1, 4)", f"avg(x) {W(4)}")}, f"(SELECT *, {DIV(c, f'lag({c}, 1) {E}')} - 1 AS x FROM p)")


def _ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(formula.evaluate(P.event_panel(spark, sf_dir), {"e": f"ts_ema({c}, 5)"}).select("security_id", "bar_idx", "e"))


add("ts_ema", _ema, f"""WITH RECURSIVE {PANEL}, f AS MATERIALIZED (SELECT security_id, bar_idx, {c} AS x FROM p),
e(security_id, bar_idx, y, w) AS (SELECT security_id, bar_idx, x, 1.0::DOUBLE FROM f WHERE bar_idx = 1 UNION ALL
SELECT f.security_id, f.bar_idx, CASE WHEN e.y IS NULL THEN f.x WHEN f.x IS NULL THEN e.y ELSE (e.w * (2/3.0) * e.y + f.x / 3.0) / (e.w * (2/3.0) + 1/3.0) END, CASE WHEN f.x IS NULL AND e.y IS NOT NULL THEN e.w * (2/3.0) ELSE 1.0 END
FROM e JOIN f ON f.security_id = e.security_id AND f.bar_idx = e.bar_idx + 1) SELECT security_id, bar_idx, round(y, 6) + 0.0 AS e FROM e""")  # fmt: skip


def _postprocess(template: str, given: str | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = formula.evaluate(P.event_panel(spark, sf_dir), {"alpha": given or D})
        return six(postprocess.postprocess(raw, template).select("security_id", "bar_idx", "alpha"))

    return query


add("postprocess_rank_clip", _postprocess("rank_clip"), f"WITH {PANEL} SELECT security_id, bar_idx, {round_sql({'alpha': f'({cr(d)}) / count({d}) {C} - 0.5'})} FROM p")
#: A signal that most entities have at most bars: deviations of few values would be noise, which the last step would scale to one.
_DAY = f"ts_mean({c}, 24)"
_MAD = f"(SELECT *, {clamp('rw', f'm - 5 * (quantile_cont(abs(rw - m), 0.5) {C} + 1e-8)', f'm + 5 * (quantile_cont(abs(rw - m), 0.5) {C} + 1e-8)')} AS x FROM (SELECT *, {qc('rw', 0.5)} AS m FROM (SELECT *, avg({c}) {W(24)} AS rw FROM p)))"


def _adjusted(given: str, span: int) -> str:
    """The adjusted exponential mean of y, a bar at a time."""
    keep = f"(1 - 2 / {span + 1}.0)"
    return f"""yy AS MATERIALIZED ({given}), ad(security_id, bar_idx, n, d) AS (SELECT security_id, bar_idx, coalesce(y, 0)::DOUBLE, CASE WHEN y IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM yy WHERE bar_idx = 1 UNION ALL
SELECT f.security_id, f.bar_idx, e.n * {keep} + coalesce(f.y, 0), e.d * {keep} + CASE WHEN f.y IS NULL THEN 0 ELSE 1 END FROM ad e JOIN yy f ON f.security_id = e.security_id AND f.bar_idx = e.bar_idx + 1), aw AS (SELECT security_id, bar_idx, n / nullif(d, 0) AS y FROM ad)"""


add("postprocess_aggressive", _postprocess("aggressive_high_ic", _DAY), f"""WITH RECURSIVE {PANEL}, {_adjusted(f"SELECT security_id, bar_idx, (x - avg(x) {C}) / (stddev_pop(x) {C} + 1e-8) AS y FROM {_MAD}", 2)}
SELECT security_id, bar_idx, {round_sql({'alpha': clamp('w', '-0.05', '0.05')})} FROM (SELECT *, y / nullif(sum(abs(y)) {C}, 0) AS w FROM aw)""")
add("postprocess_stable", _postprocess("stable_low_turnover", _DAY), f"""WITH RECURSIVE {PANEL}, {_adjusted(f"SELECT security_id, bar_idx, u - avg(u) {C} AS y FROM (SELECT *, {unit('x')} AS u FROM {_MAD})", 4)}
SELECT security_id, bar_idx, {round_sql({'alpha': clamp('w', '-0.01', '0.01')})} FROM (SELECT *, y / nullif(sum(abs(y)) {C}, 0) AS w FROM aw)""")
formulas("shadow_smoothers", {"m": (f"ts_mean2({c}, 4)", f"CASE WHEN count({c}) {W(4)} >= 2 THEN avg({c}) {W(4)} END"), "z": (f"ts_zscore2({c}, 4)", f"({c} - CASE WHEN count({c}) {W(4)} >= 2 THEN avg({c}) {W(4)} END) / (CASE WHEN count({c}) {W(4)} >= 2 THEN stddev_samp({c}) {W(4)} END + 1e-8)")})
add("ts_ewm", lambda spark, sf_dir: six(formula.evaluate(P.event_panel(spark, sf_dir), {"e": f"ts_ewm({c}, 5)"}).select("security_id", "bar_idx", "e")), f"WITH RECURSIVE {PANEL}, {_adjusted(f'SELECT security_id, bar_idx, {c} AS y FROM p', 5)} SELECT security_id, bar_idx, round(y, 6) + 0.0 AS e FROM aw")
add("function_catalog", lambda spark, sf_dir: catalog.frame(spark))
