"""Studies of signals: distributions, coverage, regimes, correlations between signals, and rescue from high turnover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.operators.metrics import bar_ic, by_month, correlation, daily, evaluate, rolling


def distribution(signal: DataFrame, value: str = "alpha") -> DataFrame:
    """One row: moments (bias-corrected), quantiles and shares of the present values, and the share missing."""
    x = F.col(value)
    n = F.count(x).cast("double")
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    kurt = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    at = (0.01, 0.05, 0.5, 0.95, 0.99)
    one = signal.agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), skew.alias("skew"), kurt.alias("kurt"), F.min(x).alias("min"), F.max(x).alias("max"), F.percentile(x, F.array(*map(F.lit, at))).alias("_q"),
        F.avg(x.isNull().cast("double")).alias("missing"), F.avg((x > 0).cast("double")).alias("positive"), F.avg((F.abs(x) <= 0.5).cast("double")).alias("inner"),
    )
    return one.select("*", *(F.col("_q")[k].alias(f"p{round(q * 100)}") for k, q in enumerate(at))).drop("_q")


def histogram(signal: DataFrame, value: str = "alpha", bins: int = 20) -> DataFrame:
    """Counts in bins of equal width between the least and the greatest value; the last bin holds the greatest."""
    x = F.col(value)
    span = signal.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.least(F.floor((x - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    return signal.filter(x.isNotNull()).join(F.broadcast(span)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def coverage(signal: DataFrame, value: str = "alpha") -> DataFrame:
    """Per day: mean over bars of the bar's mean, deviation and share present."""
    x = F.col(value)
    bars = signal.groupBy("date", "bar_idx").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg(x.isNotNull().cast("double")).alias("coverage"))
    return bars.groupBy("date").agg(*(F.avg(c).alias(c) for c in ("mean", "std", "coverage")))


def regimes(signal: DataFrame, alpha: str = "alpha", resp: str = "resp") -> DataFrame:
    """Mean daily IC and days by regime: market up or down, trending or not (its size at or above the median), volatility at or above its
    median or below. Days are few: one task has their medians. With an odd number of days a median is a day's own value, so
    values are rounded to ten places before they are compared."""
    bars = signal.groupBy("date", "bar_idx").agg(correlation(alpha, resp).alias("ic"), F.avg(resp).alias("market"), F.stddev_samp(resp).alias("vol"))
    days = bars.groupBy("date").agg(F.avg("ic").alias("ic"), F.round(F.avg("market"), 10).alias("market"), F.round(F.avg("vol"), 10).alias("vol"))
    middle = lambda c: F.percentile(c, F.lit(0.5)).over(Window.partitionBy())
    known = days.select("ic", "market", "vol", middle(F.col("vol")).alias("mid_vol"), F.abs("market").alias("size"), middle(F.abs("market")).alias("mid_size"))
    either = lambda test, yes, no: F.when(test, yes).otherwise(no)
    flags = F.array(either(F.col("market") >= 0, "up", "down"), either(F.col("vol") >= F.col("mid_vol"), "high_vol", "low_vol"), either(F.col("size") >= F.col("mid_size"), "trend", "chop"))
    return known.select("ic", F.explode(flags).alias("regime")).groupBy("regime").agg(F.avg("ic").alias("ic"), F.count("ic").alias("days"))


def pairwise(signals: DataFrame, names: list[str], least: int = 20) -> DataFrame:
    """(a, b, corr, bars): the mean over bars of the correlation of two signals with `least` common entities at least. One pass: all
    pairs are aggregates of the same rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    per_bar = signals.groupBy("bar_idx").agg(*(F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) >= least, correlation(a, b)).alias(f"{a}|{b}") for a, b in pairs))
    long = per_bar.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))).alias("x")).select("x.*")
    return long.groupBy("a", "b").agg(F.avg("r").alias("corr"), F.count("r").alias("bars"))


def pooled(signals: DataFrame, names: list[str], least: int = 200) -> DataFrame:
    """(a, b, corr, n): correlation of two signals' z-scores by bar over all rows that have both; NULL below `least` such rows."""
    w = Window.partitionBy("bar_idx")
    z = signals.select(*(ratio(F.col(n) - F.avg(n).over(w), F.stddev_samp(n).over(w)).alias(n) for n in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = z.agg(*(F.struct(correlation(a, b).alias("corr"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n")).alias(f"{a}|{b}") for a, b in pairs))
    long = one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`.corr").alias("corr"), F.col(f"`{a}|{b}`.n").alias("n")) for a, b in pairs))))
    return long.withColumn("corr", F.when(F.col("n") >= least, F.col("corr")))


def neighbours(pairs: DataFrame, most: int = 12) -> DataFrame:
    """Per signal its `most` most correlated others by size, numbered."""
    both = pairs.select("a", "b", "corr").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).filter("corr is not null")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.abs("corr").desc(), "b"))
    return both.withColumn("place", place).filter(F.col("place") <= most).select(F.col("a").alias("signal"), F.col("b").alias("other"), "corr", "place")


#: Ways to lower a signal's turnover, each ranked anew (fixed values), and what a rescued signal must keep.
SMOOTHERS = {"ema_10": "pct_rank(ts_ewm(alpha, 10))", "persistence_02": "pct_rank(ts_ema(alpha, 9))", "extremes_q20": "pct_rank(fill_zero(cs_extremes(alpha, 0.2)))", "rolling_15": "pct_rank(ts_mean(alpha, 15))"}
MOST_TVR, LEAST_IC = 380.0, 0.10


def rescue(signal: DataFrame, stamps: list[str] | None = None, smoothers: dict[str, str] | None = None, most_tvr: float = MOST_TVR, least_ic: float = LEAST_IC) -> tuple[DataFrame, DataFrame]:
    """(one row a smoother: estimate, place, ic, ir, tvr, fits, chosen; the signal with a column for each smoother). Smoothers are tried from the lowest estimated
    turnover on (mean over all bars of changes over sizes, in ten-thousandths), and the first whose submission keeps tvr and ic within the limits is chosen.
    All are evaluated in one pass, as groups of the same rows; the smoothed signal is written once, as estimates, scores and the caller read it."""
    from tessella.dsl import formula
    from tessella.llm.scratch import written

    smoothers = smoothers or SMOOTHERS
    smooth = written(formula.evaluate(signal, smoothers), "smoothed")
    each = F.array(*(F.struct(F.lit(n).alias("smoother"), F.col(n).alias("_x")) for n in smoothers))
    long = smooth.select("date", "datetime", "bar_idx", "security_id", "resp", "trading_restriction", F.inline(each)).withColumnRenamed("_x", "alpha")
    change = F.abs(F.col("alpha") - F.lag("alpha").over(Window.partitionBy("smoother", "security_id").orderBy("bar_idx")))
    bars = long.withColumn("_c", change).groupBy("smoother", "bar_idx").agg(ratio(F.coalesce(F.sum("_c"), F.lit(0.0)), F.sum(F.abs("alpha"))).alias("r"))
    estimates = bars.groupBy("smoother").agg(F.round(F.coalesce(F.avg("r"), F.lit(0.9999)) * 1e4, 6).alias("estimate"))
    found = estimates.join(evaluate(long, by=["smoother"], stamps=stamps, stored=True).select("smoother", "ic", "ir", "tvr"), "smoother")
    fits = F.coalesce((F.col("tvr") <= most_tvr) & (F.col("ic") >= least_ic), F.lit(False))
    order = Window.orderBy("estimate", "smoother")  # a row a smoother
    placed = found.withColumns({"fits": fits, "place": F.row_number().over(order)})
    return placed.withColumn("chosen", F.col("fits") & (F.sum(F.col("fits").cast("int")).over(order) == 1)), smooth


def prior_correlation(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Per signal: mean, greatest and least correlation with the signals before it in order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("a"))
    other = F.array_position(F.array(*map(F.lit, order)), F.col("b"))
    later = F.when(place > other, F.col("a")).otherwise(F.col("b"))
    return pairs.groupBy(later.alias("signal")).agg(F.avg("corr").alias("avg_corr"), F.max("corr").alias("max_corr"), F.min("corr").alias("min_corr"))


def low_correlation_set(pairs: list[tuple[str, str, float]], scores: dict[str, float], most: float = 0.7) -> list[str]:
    """The largest set of signals no two of which correlate beyond `most`; of equal sizes the one of higher scores, best first.
    Signals are a few dozen, so this is done on the driver, by branch and bound."""
    order = sorted(scores, key=lambda s: (-scores[s], s))
    clash = {s: set() for s in order}
    for a, b, r in pairs:
        if r is not None and abs(r) > most:
            clash[a].add(b)
            clash[b].add(a)
    best: list[str] = []

    def grow(chosen: list[str], left: list[str]) -> None:
        nonlocal best
        if len(chosen) > len(best):
            best = list(chosen)
        for k, s in enumerate(left):
            if len(chosen) + len(left) - k <= len(best):
                return
            grow([*chosen, s], [t for t in left[k + 1 :] if t not in clash[s]])

    grow([], order)
    return best


def factor_stats(daily: DataFrame, factors: list[str], resp: str = "ret") -> DataFrame:
    """Per factor: mean, deviation and ratio of its daily IC, its sign and size. One pass over the days."""
    per_day = daily.groupBy("date").agg(*(correlation(f, resp).alias(f) for f in factors))
    long = per_day.select(F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("ic")) for f in factors))).alias("x")).select("x.*")
    out = long.groupBy("factor").agg(F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("std"))
    return out.withColumns({"icir": ratio(F.col("ic"), F.col("std")), "sign": F.signum("ic"), "abs_ic": F.abs("ic")})


#: Gates of a card and their labels (fixed values).
GATES = {"IC predictive power": "ic > 0.6", "IR consistency": "ir > 2.5", "TVR turnover": "tvr < 400", "position concentration": "unconcentrated"}


def card(signal: DataFrame, others: list[str], stamps: list[str] | None = None, alpha: str = "alpha", resp: str = "resp") -> DataFrame:
    """One nested row about a signal: status, metrics, distribution, monthly (month, ic), rolling (date, ic_mean, of 20 days once 5 are there), regimes (regime, ic, days), redundancy (other, corr, size: the
    mean correlation by bar with each of the columns `others`, the largest first, at most 12) and gate_notes. Each part is an aggregation of the panel, which is written once, as all of them read it; the row is as large as there are days."""
    from tessella.llm.scratch import written

    signal = written(signal.select(*dict.fromkeys(("date", "datetime", "bar_idx", "security_id", "trading_restriction", resp, alpha, *others))), "card-signals")
    metrics_ = evaluate(signal, alpha, stamps=stamps, resp=resp, stored=True)
    notes = F.array(*(F.concat(F.lit(f"{label}: "), F.when(F.expr(test), "pass").otherwise("fail")) for label, test in GATES.items()))
    out = metrics_.select(F.when(F.col("passes"), "PASS").otherwise("REJECTED").alias("status"), F.struct("ic", "ir", "tvr", "score").alias("metrics"), notes.alias("gate_notes"))
    days = daily(bar_ic(signal, alpha, resp), "ic")
    month = by_month(days, "ic")
    parts = {
        "distribution": distribution(signal, alpha).select(F.struct("mean", "std", "skew", "kurt", "min", "max", "missing", "positive", "inner").alias("v")),
        "monthly": month.agg(F.array_sort(F.collect_list(F.struct("month", "ic"))).alias("v")), "rolling": rolling(days, "ic", 20, 5).agg(F.array_sort(F.collect_list(F.struct("date", "ic_mean"))).alias("v")),
        "regimes": regimes(signal, alpha, resp).agg(F.array_sort(F.collect_list(F.struct("regime", "ic", "days"))).alias("v")),
        "redundancy": neighbours(pairwise(signal, [alpha, *others]).filter((F.col("a") == alpha) | (F.col("b") == alpha))).filter(F.col("signal") == alpha).agg(F.array_sort(F.collect_list(F.struct("place", "other", "corr"))).alias("v")),
    }
    for name, part in parts.items():
        out = out.join(F.broadcast(part.select(F.col("v").alias(name))))  # single rows
    return out


def card_rows(row: DataFrame) -> DataFrame:
    """A card as rows (section, name, value, note)."""
    line = lambda section, name, value=None, note=None: F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(None) if note is None else note).cast("string").alias("note"))
    single = lambda section, fields: F.array(*(line(section, F.lit(f), F.col(f"{section}.{f}")) for f in fields))
    every = F.concat(
        F.array(line("status", F.lit("status"), None, F.col("status"))), single("metrics", ("ic", "ir", "tvr", "score")), single("distribution", ("mean", "std", "skew", "kurt", "min", "max", "missing", "positive", "inner")),
        F.transform("monthly", lambda x: line("monthly", x["month"], x["ic"])), F.transform("rolling", lambda x: line("rolling", x["date"], x["ic_mean"])), F.transform("regimes", lambda x: line("regimes", x["regime"], x["ic"])),
        F.transform("redundancy", lambda x: line("redundancy", x["other"], x["corr"])), F.transform("gate_notes", lambda x: line("gate_notes", F.split(x, ": ")[0], None, F.split(x, ": ")[1])),
    )
    return row.select(F.inline(every))
