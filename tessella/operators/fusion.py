"""Fusion of models' predictions: several ways to weigh them by their score on validation days and their correlations, and the one that promises most.

Scores and correlations are aggregated in the cluster, in one pass each; with k models the weights are k numbers and chosen on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.operators.combine import pooled_correlations
from tessella.operators.metrics import TVR_WEIGHT, correlation
from tessella.operators.metrics import ir as information_ratio

#: Points of a softmax's step, the least correlation to divide by, the part of a score that correlation costs when a model is picked, weighed and when
#: weights are compared, the bonus of an anchor, models of a stack, and anchors and others of an anchored one (fixed values).
TEMPERATURE, LEAST_CORR, PICK, WEIGH, COMPARE, BONUS = 4500.0, 0.20, 0.55, 0.35, 0.45, 1.35
MOST, ANCHORS, OTHERS = 6, 2, 3


def validation_scores(days: DataFrame, names: list[str], resp: str = "resp") -> DataFrame:
    """(model, ic, ir, tvr, score): each column's daily prediction, as combine.period_score has it, in one pass over days(date, security_id, names, resp)."""
    entity = Window.partitionBy("security_id").orderBy("date")
    moved = days.select("date", resp, *names, *(F.abs(F.col(n) - F.lag(n).over(entity)).alias(f"_c_{n}") for n in names))  # a row of all models, not one for each
    of = lambda n: F.struct(F.lit(n).alias("model"), correlation(n, resp).alias("ic"), ratio(F.coalesce(F.sum(f"_c_{n}"), F.lit(0.0)), F.sum(F.abs(F.col(n)))).alias("tvr"))
    by_day = moved.groupBy("date").agg(F.array(*(of(n) for n in names)).alias("_m")).select("date", F.inline("_m"))
    one = by_day.groupBy("model").agg((F.avg("ic") * 100.0).alias("ic"), information_ratio("ic").alias("ir"), (F.avg("tvr") * 100.0).alias("tvr"))
    return one.withColumn("score", F.greatest(F.col("ic") - TVR_WEIGHT * F.col("tvr"), F.lit(0.0)) * F.sqrt(F.greatest("ir", F.lit(0.0))) * 100.0)


def candidates(scores: dict[str, float], corr: np.ndarray, anchors: set[str] = frozenset(), most: int = MOST) -> list[dict]:
    """Ways to weigh the models, in the order tried: name, weights, proxy (the weighted score), penalty (what their correlations cost), objective, chosen. corr: correlations in
    the order of scores. Without a positive score all weigh alike. Equal scores and objectives go by the order given."""
    names = list(scores)
    value = {n: max(scores[n] or 0.0, 0.0) for n in names}
    size = lambda a, b: abs(float(corr[names.index(a)][names.index(b)]))
    scaled = lambda raw: {n: v / (sum(raw.values()) or 1.0) for n, v in raw.items()}
    mean = lambda n, others: float(np.mean([size(n, o) for o in others])) if others else 0.0
    if not names or max(value.values()) <= 0:
        return [{"name": "equal", "weights": dict.fromkeys(names, 1.0 / max(1, len(names))), "proxy": 0.0, "penalty": 0.0, "objective": 0.0, "chosen": True}]
    top = max(value.values())
    ways = {"softmax": scaled({n: math.exp((v - top) / TEMPERATURE) for n, v in value.items()})}
    total = sum(value.values())
    ways["inverse_corr"] = scaled({n: v / total / max(LEAST_CORR, mean(n, [o for o in names if o != n])) for n, v in value.items()})
    order = sorted(names, key=lambda n: -value[n])
    picked = [order[0]]
    while len(picked) < min(most, len(order)):
        left = [n for n in order if n not in picked]
        gain = [value[n] * (1.0 - PICK * mean(n, picked)) for n in left]
        picked.append(left[int(np.argmax(gain))])
    ways["greedy_diversity"] = scaled({n: max(value[n] * (1.0 - WEIGH * mean(n, [o for o in picked if o != n])), 0.0) for n in picked})
    first = [n for n in order if n in anchors][:ANCHORS]
    stack = first + [n for n in order if n not in anchors][:OTHERS]
    ways["anchored_stack"] = scaled({n: value[n] * (BONUS if n in anchors else 1.0) for n in stack})
    out = []
    for name, w in ways.items():
        keys = list(w)
        penalty = sum(size(a, b) * w[a] * w[b] for i, a in enumerate(keys) for b in keys[i + 1 :])
        proxy = sum(value[n] * v for n, v in w.items())
        out.append({"name": name, "weights": w, "proxy": proxy, "penalty": penalty, "objective": proxy * (1.0 - COMPARE * penalty), "chosen": False})
    out[int(np.argmax([c["objective"] for c in out]))]["chosen"] = True
    return out


def fuse(days: DataFrame, names: list[str], anchors: set[str] = frozenset(), resp: str = "resp", most: int = MOST) -> list[dict]:
    """candidates() for the columns of days(date, security_id, names, resp), the validation days. Models are tried in the order of their names."""
    names = sorted(names)
    scores = {r.model: r.score for r in validation_scores(days, names, resp).collect()}  # one row a model
    return candidates({n: scores.get(n) or 0.0 for n in names}, pooled_correlations(days, names), anchors, most)
