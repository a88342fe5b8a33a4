"""Families of hand-written signals, searched in one pass: every member is a column, every metric an aggregate of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.dsl import formula
from tessella.functions.scalar import ratio
from tessella.operators.cs import average_rank
from tessella.operators.metrics import bar_turnover, correlation, daily_turnover, ir

#: family -> (template, windows). Each counts with either sign.
FAMILIES: dict[str, tuple[str, tuple[int, ...]]] = {
    "reversal": ("0 - ts_pct_change(close_trade_px, {n})", (1, 3, 6)),
    "momentum": ("ts_pct_change(close_trade_px, {n})", (12, 24)),
    "vwap_gap": ("0 - ts_mean(vwap_gap, {n})", (1, 4)),
    "range_place": ("ts_minmax_norm(close_trade_px, {n})", (6, 12)),
    "volume_surprise": ("div(volume, ts_mean(volume, {n})) - 1", (6, 24)),
    "volatility": ("0 - ts_std(ret_1, {n})", (6, 24)),
    "price_volume": ("0 - ts_corr(close_trade_px, volume, {n})", (12,)),
    "decayed_change": ("ts_decay_linear(delta(close_trade_px, 1), {n})", (3, 6)),
    "rank_of_price": ("0 - ts_rank(close_trade_px, {n})", (8, 16)),
    "smooth_gap": ("close_trade_px - ts_ema(close_trade_px, {n})", (5,)),
    "skewness": ("0 - ts_skew(ret_1, {n})", (12,)),
    "age_of_high": ("ts_argmax(high_trade_px, {n})", (12,)),
    "age_of_low": ("0 - ts_argmin(low_trade_px, {n})", (12,)),
    "trade_size": ("cs_zscore(ts_mean(div(volume, trade_count), {n}))", (6,)),
    "quiet_reversal": ("ifelse(volume < ts_mean(volume, {n}), 0 - ts_pct_change(close_trade_px, 1), 0)", (12,)),
    "dispersion": ("ts_quantile(close_trade_px, {n}, 0.8) - ts_median(close_trade_px, {n})", (12,)),
}


def members(families: dict[str, tuple[str, tuple[int, ...]]] | None = None) -> dict[str, str]:
    """name -> formula, for each family and window."""
    return {f"{family}__{n}": template.format(n=n) for family, (template, windows) in (families or FAMILIES).items() for n in windows}


def search(panel: DataFrame, candidates: dict[str, str], resp: str = "resp") -> DataFrame:
    """Per candidate and sign: family, mean daily IC of its ranks across entities, its ratio and days.

    The values are columns of one pass over time; then each candidate's bars are groups of their own, so that ranking takes one
    exchange and sort for all; bars that lack a value are left out of it, as they have no rank. The opposite sign's IC is the negative, as ranks mirror."""
    signals = formula.evaluate(panel, candidates)
    each = F.array(*(F.struct(F.lit(n).alias("candidate"), F.col(n).alias("x")) for n in candidates))
    long = signals.select("date", "bar_idx", resp, F.inline(each)).filter(F.col("x").isNotNull()).withColumn("_g", F.struct("candidate", "bar_idx"))
    ranked = long.withColumn("_r", average_rank(F.col("x"), "_g"))
    days = ranked.groupBy("candidate", "date", "bar_idx").agg(correlation("_r", resp).alias("ic")).groupBy("candidate", "date").agg(F.avg("ic").alias("ic"))
    signed = days.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("ic", F.col("ic") * F.col("sign"))
    found = signed.groupBy("candidate", "sign").agg(F.avg("ic").alias("ic"), ir("ic").alias("ir"), F.count("ic").alias("days"))
    every = panel.sparkSession.createDataFrame([(n, sign) for n in candidates for sign in (1, -1)], "candidate string, sign int")
    out = every.join(found, ["candidate", "sign"], "left").na.fill({"ir": 0.0, "days": 0})
    return out.withColumn("family", F.split("candidate", "__")[0])


def leaderboard(found: DataFrame) -> DataFrame:
    """Per family: members, the best and the mean IC."""
    return found.groupBy("family").agg(F.count("*").alias("members"), F.max("ic").alias("best"), F.avg("ic").alias("mean"))


def screen(panel: DataFrame, candidates: dict[str, str], days: int, least_ic: float, resp: str = "resp") -> dict[str, str]:
    """The candidates worth a full evaluation: those with enough IC over the last days. Names and numbers only reach the driver."""
    last = panel.select("date").distinct().orderBy(F.desc("date")).limit(days)
    found = search(panel.join(F.broadcast(last), "date"), candidates, resp).filter(F.col("ic") >= least_ic).select("candidate", "sign").collect()
    return {f"{r.candidate}__{r.sign}": f"pct_rank({'' if r.sign > 0 else '0 - '}({candidates[r.candidate]}))" for r in found}


def turnover_of(panel: DataFrame, given: str) -> DataFrame:
    signal = formula.evaluate(panel, {"alpha": given})
    return daily_turnover(bar_turnover(signal)).agg(F.avg("tvr").alias("tvr"), ratio(F.stddev_samp("tvr"), F.avg("tvr")).alias("spread"))
