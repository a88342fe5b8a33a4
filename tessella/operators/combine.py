"""Combinations of signals: weights from their daily statistics, blends, features and targets.

Statistics and correlations are aggregated in the cluster; with k signals, weights are k numbers and solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.operators.metrics import correlation


#: The least deviation, and the least shrinkage, that weights are divided by (a fixed value).
FLOOR = 1e-4


def normalise(weights: dict[str, float]) -> dict[str, float]:
    total = sum(abs(w) for w in weights.values())
    return {k: (w / total if total > 0 else 1.0 / len(weights)) for k, w in weights.items()}


def weights(scheme: str, stats: dict[str, dict[str, float]], corr: np.ndarray | None = None, k: int = 2, temperature: float = 0.05) -> dict[str, float]:
    """Weights that sum to one in size. stats: per signal ic, std, icir, sign; corr: their correlations, in the same order."""
    names = list(stats)
    ic = np.array([stats[n]["ic"] or 0.0 for n in names])
    sd = np.array([stats[n]["std"] or 0.0 for n in names])
    sign = np.sign(ic)
    match scheme:
        case "equal":
            w = sign
        case "ic":
            w = ic
        case "icir":
            w = np.array([stats[n]["icir"] or 0.0 for n in names])
        case "topk":
            best = sorted(range(len(names)), key=lambda i: (-abs(ic[i]), names[i]))[:k]
            w = np.array([sign[i] if i in best else 0.0 for i in range(len(names))])
        case "softmax":
            e = np.exp((np.abs(ic) - np.abs(ic).max()) / temperature)
            w = sign * e
        case "power":
            w = sign * ic**2
        case "inverse_vol":
            w = sign / np.where(sd > 0, sd, np.inf)
        case "ridge_shrink":
            var = sd**2
            w = ic / (var + max(float(np.median(var[var > 0])) if (var > 0).any() else FLOOR, FLOOR))
        case "diversified":
            w = np.linalg.solve(np.asarray(corr) + 0.25 * np.eye(len(names)), ic)
        case "vol_balanced":
            best = sorted(range(len(names)), key=lambda i: (-abs(ic[i]) / max(sd[i], FLOOR), names[i]))[: max(4, round(2 * len(names) ** 0.5))]
            w = np.array([sign[i] / max(sd[i], FLOOR) if i in best else 0.0 for i in range(len(names))])
        case "top_ic":
            best = sorted(range(len(names)), key=lambda i: (-abs(ic[i]), names[i]))[: max(4, round(2 * len(names) ** 0.5))]
            w = np.array([sign[i] if i in best else 0.0 for i in range(len(names))])
        case "cluster_neutral":
            clusters: list[list[int]] = []
            for i in sorted(range(len(names)), key=lambda i: (-abs(ic[i]), names[i])):
                home = next((c for c in clusters if any(abs(corr[i][j]) >= 0.7 for j in c)), None)
                if home is None:
                    clusters.append([i])
                else:
                    home.append(i)
            w = np.zeros(len(names))
            for c in clusters:
                total = np.abs(ic[c]).sum()
                w[c] = (ic[c] / total if total > 1e-12 else sign[c] / len(c)) / len(clusters)
        case "inverse_corr":
            w = sign / (1e-6 + np.abs(np.asarray(corr)).mean(axis=1))
        case "corr_pruned":
            kept: list[int] = []
            for i in sorted(range(len(names)), key=lambda i: (-abs(ic[i]), names[i])):
                if all(abs(corr[i][j]) <= 0.7 for j in kept):
                    kept.append(i)
            w = np.array([sign[i] if i in kept else 0.0 for i in range(len(names))])
        case _:
            raise ValueError(f"unknown scheme {scheme}")
    return normalise(dict(zip(names, map(float, w), strict=True)))


#: How many of the best signals, and which powers of their ICs, are tried (fixed values).
TOPS, POWERS = (4, 8, 12, 16, 24, 32), (0.5, 1.0, 1.5, 2.0)


def validated(kind: str, fit: dict[str, dict[str, float]], seen: dict[str, dict[str, float]]) -> dict[str, float]:
    """Weights by statistics of the fitting days, chosen by those of the validation days: topk (how many of the signals of largest IC there, by the sum of
    these) or power (of the fitted ICs, by the weighted IC there). The first of equals."""
    names, best, most = list(fit), {}, -float("inf")
    ic = lambda stats, n: stats[n]["ic"] or 0.0
    ranked = sorted(names, key=lambda n: (-abs(ic(seen, n)), n))
    for option in sorted({min(len(names), k) for k in (*TOPS, len(names))}) if kind == "topk" else POWERS:
        if kind == "topk":
            raw = {n: float(np.sign(ic(fit, n))) if n in ranked[:option] else 0.0 for n in names}
            value = sum(abs(ic(seen, n)) for n in ranked[:option])
        else:
            raw = {n: float(np.sign(ic(fit, n))) * abs(ic(fit, n)) ** option for n in names}
            value = sum(w * ic(seen, n) for n, w in normalise(raw).items())
        if value > most:
            best, most = normalise(raw), value
    return best


def blend(df: DataFrame, given: dict[str, float], name: str = "combo") -> DataFrame:
    """The weighted sum over the weights of the signals that are present; NULL where none is."""
    use = {k: w for k, w in given.items() if w}
    top = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in use.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(k).isNotNull(), abs(w)).otherwise(0.0) for k, w in use.items()), F.lit(0.0))
    return df.withColumn(name, ratio(top, bottom))


def pooled_correlations(df: DataFrame, names: list[str]) -> np.ndarray:
    """k x k, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in pairs)).first()
    out = np.eye(len(names))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        out[i, j] = out[j, i] = row[f"{a}|{b}"] or 0.0
    return out


def standard_target(x: Column, day: str = "date") -> Column:
    """Per day: sample z-score, clipped to five, 0 where undefined."""
    w = Window.partitionBy(day)
    z = ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))
    return F.coalesce(F.greatest(F.least(z, F.lit(5.0)), F.lit(-5.0)), F.lit(0.0))


def with_standard_target(rows: DataFrame, x: str, day: str = "date") -> DataFrame:
    """rows with target: standard_target() of x, NULL where x is. The days' means and deviations are aggregated and broadcast, so no task holds a day."""
    return with_standards(rows, {"target": x}, day).withColumn("target", F.when(F.col(x).isNotNull(), F.col("target")))


def with_standards(rows: DataFrame, given: dict[str, str], day: str = "date", days: DataFrame | None = None) -> DataFrame:
    """rows with standard_target() of each column, by the new column's name. days: day_statistics() of the columns."""
    days = day_statistics(rows, list(given.values()), day) if days is None else days
    met = rows.join(F.broadcast(days), F.col(day).eqNullSafe(F.col("_day")), "left")
    z = {name: ratio(F.col(x) - F.col(f"_mean_{x}"), F.col(f"_sd_{x}")) for name, x in given.items()}
    clipped = {name: F.coalesce(F.greatest(F.least(c, F.lit(5.0)), F.lit(-5.0)), F.lit(0.0)) for name, c in z.items()}
    return met.withColumns(clipped).select(*(c for c in rows.columns if c not in given), *given)


def day_statistics(rows: DataFrame, names: list[str], day: str = "date") -> DataFrame:
    """A row a day (_day) with mean and sample deviation of each column."""
    each = dict.fromkeys(names)
    return rows.groupBy(F.col(day).alias("_day")).agg(*(F.avg(x).alias(f"_mean_{x}") for x in each), *(F.stddev_samp(x).alias(f"_sd_{x}") for x in each))


def recency(days: DataFrame) -> DataFrame:
    """(date, weight): from 0.75 for the first day to 1.25 for the last. Days are few: one task orders them."""
    return days.select("date").distinct().withColumn("weight", 0.75 + 0.5 * F.percent_rank().over(Window.orderBy("date")))


def training_weights(days: DataFrame, target: str) -> DataFrame:
    """days with train_weight: the day's recency (1 if there is one day only) times one and a quarter of the target's size up to three; a null target adds nothing."""
    recent = recency(days).withColumn("_several", F.count("*").over(Window.partitionBy()) > 1)
    size = 1.0 + 0.25 * F.least(F.coalesce(F.abs(target), F.lit(0.0)), F.lit(3.0))
    joined = days.join(recent.withColumnRenamed("weight", "_recency"), "date")
    return joined.withColumn("train_weight", size * F.when(F.col("_several"), F.col("_recency")).otherwise(1.0)).drop("_several", "_recency")


def input_correlations(rows: DataFrame, pred: str, names: list[str], scores: DataFrame, least: int = 200) -> DataFrame:
    """(factor, corr, abs_corr, pairs, score, place): the pooled correlation of a prediction with each input that has `least` pairs at least, placed by its size, then
    score, then name, the greatest first. scores has (factor, score), a row each. One pass over rows for all inputs; what follows has a row an input."""
    pairs = lambda n: F.count(F.when(F.col(pred).isNotNull() & F.col(n).isNotNull(), 1))
    one = rows.agg(*(F.struct(F.lit(n).alias("factor"), correlation(pred, n).alias("corr"), pairs(n).alias("pairs")).alias(n) for n in names))
    found = one.select(F.inline(F.array(*names))).filter((F.col("pairs") >= least) & F.col("corr").isNotNull()).join(scores, "factor", "left")
    order = [F.desc("abs_corr"), F.desc_nulls_last("score"), F.desc("factor")]
    return found.withColumn("abs_corr", F.round(F.abs("corr"), 10)).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def lag_features(df: DataFrame, names: list[str], lags: int = 1, day: str = "date") -> DataFrame:
    """name__lag{k}, name__diff1 and name__mom2 over the entity's own days, missing as 0."""
    w = Window.partitionBy("security_id").orderBy(day)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    new: dict[str, Column] = {}
    for n in names:
        for k in range(1, lags + 1):
            new[f"{n}__lag{k}"] = zero(F.lag(n, k).over(w))
        new[f"{n}__diff1"] = zero(F.col(n) - F.lag(n, 1).over(w))
        new[f"{n}__mom2"] = zero(F.col(n) - F.lag(n, 2).over(w))
    return df.withColumns(new)


def lag_tensor(df: DataFrame, names: list[str], steps: int = 8, day: str = "date") -> DataFrame:
    """tensor: for each of the last `steps` days of the entity, the oldest first, the values of all names, 0 where missing."""
    w = Window.partitionBy("security_id").orderBy(day)
    step = lambda k: F.array(*(F.coalesce(F.lag(n, k).over(w), F.lit(0.0)) if k else F.coalesce(F.col(n), F.lit(0.0)) for n in names))
    return df.withColumn("tensor", F.array(*(step(k) for k in range(steps - 1, -1, -1))))


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, model: str = "ridge", seed: int = 42) -> DataFrame:
    """test with pred, by a model of pyspark.ml: ridge, forest or boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    made = {
        "ridge": lambda: LinearRegression(featuresCol="_x", labelCol=target, predictionCol="pred", regParam=0.01, elasticNetParam=0.0, solver="normal"),
        "forest": lambda: RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="pred", numTrees=20, maxDepth=4, seed=seed),
        "boosted": lambda: GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="pred", maxIter=8, maxDepth=3, seed=seed),
    }[model]()
    assemble = VectorAssembler(inputCols=features, outputCol="_x")
    clean = lambda d: assemble.transform(d.na.fill(0.0, features))
    return made.fit(clean(train).filter(F.col(target).isNotNull())).transform(clean(test)).drop("_x")
