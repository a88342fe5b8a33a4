"""Models that are fitted day by day as time goes on: features, weighted ridge from sums by day, walk-forward windows, lag tensors, attention features.

Rows are read once to make features and once for the sums. A ridge needs only the sums of products of features, target and one by day, days x (features + 2)^2
numbers: any training window is a weighted sum of days, so windows that overlap cost no further pass. Those sums, and coefficients, are all the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.llm.scratch import discard, written, written_by
from tessella.operators import combine as K
from tessella.operators import cs
from tessella.operators.metrics import TVR_WEIGHT, correlation
from tessella.operators.metrics import ir as information_ratio

#: Channels of a factor's token (fixed values): the value, its z-score and rank in the day, the last one, and changes over one and two days.
CHANNELS = ("", "__csz", "__rank", "__lag1", "__diff1", "__mom2")
#: Days of history below which nothing is fitted (a fixed value).
LEAST_DAYS = 20
#: Variance below which a feature is constant and gets no coefficient.
FLAT = 1e-12


def model_frame(days: DataFrame, names: list[str], temporal: int = 24) -> DataFrame:
    """days(date, security_id, names, ...) with all channels of each name, 0 where missing; the last three for the first `temporal` names only. Values, ranks and
    the two values before are written once (`tokens`), a large table in passes over entities; the other channels are made from these, and the days' statistics, wherever rows are read."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    w, lagged = Window.partitionBy("security_id").orderBy("date"), names[:temporal]
    rows, columns = cs.rows_read(days), days.columns
    moments = K.day_statistics(days, names)
    ranked = cs.with_ranks(days, {f"{n}__rank": (cs.pct_rank_centred, F.col(n)) for n in names}, "date")
    made = ranked.withColumns({f"{n}__{k}": zero(F.lag(n, i).over(w)) for n in lagged for k, i in (("lag1", 1), ("lag2", 2))})
    made, moments = written_by(made, "tokens", F.col("security_id"), rows), written(moments, "token-days")
    discard_ranked(ranked)
    made = K.with_standards(made, {f"{n}__csz": n for n in names}, days=moments)
    made = made.withColumns({n: zero(F.col(n)) for n in names} | {f"{n}__rank": zero(F.col(f"{n}__rank")) for n in names})
    changes = {f"{n}__{k}": F.col(n) - F.col(f"{n}__{lag}") for n in lagged for k, lag in (("diff1", "lag1"), ("mom2", "lag2"))}
    return made.withColumns(changes).select(*columns, *(f"{n}__{k}" for n in names for k in ("csz", "rank")), *(f"{n}__{k}" for n in lagged for k in ("lag1", "diff1", "mom2")))


def day_index(days: DataFrame) -> DataFrame:
    """days with day, the date's place from 0, and n_days. Dates are few: one task orders them."""
    dates = days.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")).cast("long") - 1).withColumn("n_days", F.count("*").over(Window.partitionBy()))
    return days.join(F.broadcast(dates), "date")


def tensor_columns(days: DataFrame, names: list[str], steps: int = 8) -> tuple[DataFrame, list[str]]:
    """(days with a column for each lag, channel and name, their names): z-scores and ranks of the last `steps` days, the newest first, 0 where missing. The days' statistics are
    aggregated; large ranks, and what a large table's rows look back on, are written once."""
    base = [f"{n}__{k}" for n in names for k in ("z", "rank")]
    w, rows = Window.partitionBy("security_id").orderBy("date"), cs.rows_read(days)
    ranked = cs.with_ranks(days, {f"{n}__rank": (cs.pct_rank_centred, F.col(n)) for n in names}, "date")
    scored = K.with_standards(ranked, {f"{n}__z": n for n in names}).withColumns({f"{n}__rank": F.coalesce(f"{n}__rank", F.lit(0.0)) for n in names})
    lagged = {f"{c}__lag{k}": F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) if k else F.col(c) for k in range(steps) for c in base}
    made = scored.withColumns(lagged)
    if rows > cs.SMALL:
        made = written_by(made.drop(*base), "lagged-days", F.col("security_id"), rows)
        discard_ranked(ranked)
    return made, list(lagged)


def discard_ranked(ranked: DataFrame) -> None:
    """Deletes the table of large ranks, once what is made of it has been written."""
    if hasattr(ranked, "_written_to"):
        discard(ranked)


# --- sums and ridge


@dataclass(frozen=True)
class Made:
    """`width` features that are made of a row's columns by numpy, rows x columns to rows x width, within the tasks that use them: wide rows are never handed on."""

    width: int
    of: Callable[[np.ndarray], np.ndarray]


def sums_by_day(rows: DataFrame, features: list[str], target: str = "target", days_in_one: int | None = None, made: Made | None = None) -> dict[int, np.ndarray]:
    """day -> the weighted sums of products of (1, features, target) over rows(day, features, target) that have a target. A row weighs the more the larger its
    target, up to three deviations. days_in_one: the days below it in one matrix, of day 0, with weights from 0.75 for the first to 1.25 for the last:
    for many features, as (features + 2)^2 / 2 numbers a day go from each task to the driver. made: the features are made of these columns where they are summed."""
    k = (made.width if made else len(features)) + 2
    upper = np.triu_indices(k)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            day = batch.column("day").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features) + 1)
            z = np.concatenate((np.ones((len(x), 1)), made.of(x[:, :-1]), x[:, -1:]) if made else (np.ones((len(x), 1)), x), 1)
            w = 1.0 + 0.25 * np.minimum(np.abs(z[:, -1]), 3.0)
            if days_in_one:
                w, day = w * (0.75 + 0.5 * day / (days_in_one - 1) if days_in_one > 1 else 1.0), np.zeros_like(day)
            for d in np.unique(day):
                own = z[day == d]
                total[int(d)] = total.get(int(d), 0.0) + (own.T @ (own * w[day == d][:, None]))[upper]
        days, n = np.array(sorted(total), np.int64), len(upper[0])
        yield pa.RecordBatch.from_pydict({"day": np.repeat(days, n), "cell": np.tile(np.arange(n), len(days)), "total": np.concatenate([total[d] for d in days]) if len(days) else np.empty(0)})

    known = rows.filter(F.col(target).isNotNull()).select("day", F.array(*(F.col(f"`{c}`") for c in features), F.col(target)).alias("x"))
    if days_in_one:
        known = known.filter(F.col("day") < days_in_one)
    found = known.mapInArrow(add_up, "day long, cell long, total double").groupBy("day", "cell").agg(F.sum("total").alias("total")).groupBy("day").agg(F.collect_list(F.struct("cell", "total")).alias("cells"))
    out: dict[int, np.ndarray] = {}
    for r in found.toLocalIterator():  # a matrix a day
        m = np.zeros((k, k))
        at, v = np.array([c.cell for c in r.cells]), np.array([c.total for c in r.cells])
        m[upper[0][at], upper[1][at]] = v
        out[r.day] = m + np.triu(m, 1).T
    return out


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """(intercept, coefficients) of least squares plus penalty x the squared coefficients of features that are scaled by their weighted deviation. Constant
    features get 0."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    x, var = cov[:-1, :-1], np.diag(cov)[:-1]
    live = var > FLAT
    b = np.zeros(len(var))
    b[live] = np.linalg.solve(x[np.ix_(live, live)] + np.diag(penalty / n * var[live]), cov[:-1, -1][live])
    return np.concatenate(([mean[-1] - mean[:-1] @ b], b))


def recency_sums(sums: dict[int, np.ndarray], first: int, last: int) -> np.ndarray | None:
    """The days first to last in one, from 0.75 for the first to 1.25 for the last."""
    parts = [(sums[d], 0.75 + 0.5 * (d - first) / (last - first) if last > first else 1.0) for d in range(first, last + 1) if d in sums]
    return sum(m * w for m, w in parts) if parts else None


@dataclass(frozen=True)
class WalkForward:
    """Window k predicts the test_days days from k * step_days on (step_days if None), by what the train_days days before them teach."""

    train_days: int
    step_days: int
    test_days: int | None = None

    def train(self, window: int) -> tuple[int, int]:
        return max(0, window * self.step_days - self.train_days), window * self.step_days - 1

    def tests_of(self, day: Column) -> Column:
        """The windows that predict a day."""
        ahead = self.test_days or self.step_days
        return F.sequence(F.greatest(F.floor((day - ahead) / self.step_days) + 1, F.lit(0)).cast("long"), F.floor(day / self.step_days).cast("long"))


def predict(rows: DataFrame, features: list[str], models: dict[int, np.ndarray], windows: WalkForward, made: Made | None = None) -> DataFrame:
    """(date, security_id, pred) for rows(day, ...): the mean over the windows that predict the day. models: window -> (intercept, coefficients); few, so broadcast.
    made: the models' features are made of the columns `features`."""
    spark, overlap = rows.sparkSession, (windows.test_days or windows.step_days) > windows.step_days
    x = F.array(*(F.col(f"`{c}`") for c in features))
    numbered = rows.withColumn("_window", F.explode(windows.tests_of(F.col("day"))))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = made.of(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features)))
            window, pred = batch.column("_window").to_numpy(zero_copy_only=False), np.empty(len(z))
            for w in np.unique(window):
                pred[window == w] = models[int(w)][0] + z[window == w] @ models[int(w)][1:]
            yield pa.RecordBatch.from_arrays([batch.column("date"), batch.column("security_id"), pa.array(pred)], ["date", "security_id", "pred"])

    if made:
        kinds = dict(rows.dtypes)
        value = numbered.filter(F.col("_window").isin(list(models))).select("date", "security_id", "_window", x.alias("x")).mapInArrow(apply, f"date {kinds['date']}, security_id {kinds['security_id']}, pred double")
        return value.groupBy("date", "security_id").agg(F.avg("pred").alias("pred")) if overlap else value
    table = spark.createDataFrame([(k, float(b[0]), [float(v) for v in b[1:]]) for k, b in models.items()], "_window long, _b0 double, _b array<double>")
    placed = numbered.join(F.broadcast(table), "_window")
    value = placed.select("date", "security_id", (F.col("_b0") + F.aggregate(F.zip_with(x, "_b", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("pred"))
    return value.groupBy("date", "security_id").agg(F.avg("pred").alias("pred")) if overlap else value


def prequential(rows: DataFrame, features: list[str], windows: WalkForward, penalty: float = 2.0, fallback: dict[str, float] | None = None) -> DataFrame:
    """(date, security_id, pred): every day's rows, predicted by a ridge of the days before its window only. rows(date, day, n_days, security_id, features, target).
    Windows with less than LEAST_DAYS days of history take the fallback's weights of features, all alike if None."""
    n_days = rows.agg(F.max("n_days")).first()[0] or 0
    sums = sums_by_day(rows, features)
    weights = fallback or dict.fromkeys(features, 1.0 / len(features))
    plain = np.array([0.0, *(weights.get(c, 0.0) for c in features)])
    models = {}
    for k in range(-(-n_days // windows.step_days)):
        first, last = windows.train(k)
        seen = recency_sums(sums, first, last) if last - first + 1 >= LEAST_DAYS else None
        models[k] = plain if seen is None else ridge(seen, penalty)
    return predict(rows, features, models, windows)


def fixed(rows: DataFrame, features: list[str], split: int, penalty: float, made: Made | None = None) -> tuple[DataFrame, np.ndarray | None]:
    """(predictions of the days from `split` on, the model): a ridge of all days before it, or equal weights where those are fewer than LEAST_DAYS."""
    seen = sums_by_day(rows, features, days_in_one=split, made=made).get(0) if split >= LEAST_DAYS else None
    width = made.width if made else len(features)
    model = np.array([0.0, *[1.0 / width] * width]) if seen is None else ridge(seen, penalty)
    ahead = WalkForward(split, split, 1 << 40)
    return predict(rows.filter(F.col("day") >= split), features, {1: model}, ahead, made), None if seen is None else model


def normalised(pred: DataFrame) -> DataFrame:
    """pred with alpha, its centred rank within the day. Predictions equal to ten places are ties, so ranks don't hang on the order of summation."""
    return cs.with_ranks(pred.withColumn("_p", F.round("pred", 10)), {"alpha": (cs.pct_rank_centred, F.col("_p"))}, "date").drop("_p")


def strongest(days: DataFrame, names: list[str], most: int = 24, resp: str = "resp") -> list[str]:
    """The names of largest mean daily IC by size, then by its ratio to its deviation."""
    if len(names) <= most:
        return list(names)
    per_day = days.groupBy("date").agg(*(correlation(n, resp).alias(n) for n in names))
    one = per_day.agg(*(F.avg(n).alias(n) for n in names), *(F.stddev_samp(n).alias(f"{n}__sd") for n in names)).first()
    size = lambda n: (round(abs(one[n] or 0.0), 12), (one[n] or 0.0) / one[f"{n}__sd"] if one[f"{n}__sd"] else 0.0)
    return sorted(names, key=lambda n: (*(-v for v in size(n)), n))[:most]


def folded(model: np.ndarray, features: list[str], names: list[str]) -> dict[str, float]:
    """Sizes of coefficients, added up over the columns made from each name; they sum to one where any is not zero."""
    out = dict.fromkeys(names, 0.0)
    for c, b in zip(features, model[1:], strict=True):
        out[c.split("__", 1)[0]] += abs(float(b))
    total = sum(out.values())
    return {n: v / total if total else v for n, v in out.items()}


# --- attention features


@dataclass(frozen=True)
class Attention:
    """Random queries over a row's factor tokens. decay: of the channels that look back (1: none); prior: factor -> share that draws attention to it, with a
    strength; sign: factor -> sign that aligns its channels."""

    seed: int = 42
    heads: int = 24
    temperature: float = 0.9
    penalty: float = 2.0
    decay: float = 1.0
    prior_strength: float = 0.0
    prior: tuple[float, ...] | None = None
    sign: tuple[float, ...] | None = None

    def width(self, factors: int) -> int:
        c = len(CHANNELS)
        return factors * c + self.heads * (2 * c + (self.prior is not None))

    def made(self, factors: int) -> Made:
        return Made(self.width(factors), lambda rows: self.features(rows.reshape(len(rows), factors, len(CHANNELS))))

    def features(self, state: np.ndarray) -> np.ndarray:
        """state: rows x factors x channels. For each head a softmax over factors weighs the tokens; their weighted means, those of their sizes, and with a prior
        its weighted mean follow the raw state."""
        rows, factors, channels = state.shape
        if self.sign is not None:
            state = state * np.asarray(self.sign)[None, :, None]
        queries = np.random.default_rng(self.seed).normal(0.0, 1.0, (self.heads, factors, channels))
        fade = np.array([1.0, 1.0, 1.0, self.decay, self.decay, self.decay**2])
        parts, size = [state.reshape(rows, -1)], np.abs(state)
        for q in queries:
            scores = np.clip((state * (q * fade)).sum(2) / max(self.temperature, 1e-6), -8.0, 8.0)
            if self.prior is not None:
                scores = scores + self.prior_strength * np.log(np.maximum(np.asarray(self.prior), 1e-8))
            weights = np.exp(scores - scores.max(1, keepdims=True))
            weights /= np.maximum(weights.sum(1, keepdims=True), 1e-6)
            parts += [np.einsum("rf,rfc->rc", weights, state), np.einsum("rf,rfc->rc", weights, size)]
            if self.prior is not None:
                parts.append((weights * np.asarray(self.prior)).sum(1, keepdims=True))
        return np.concatenate(parts, 1)


def with_attention(rows: DataFrame, names: list[str], attention: Attention) -> tuple[DataFrame, list[str]]:
    """(rows with a column for each attention feature, their names); rows has all channels of the names. Row by row, so any partitioning gives the same."""
    width = attention.width(len(names))

    @F.pandas_udf("array<double>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for states in batches:
            state = np.array(states.tolist(), np.float64).reshape(len(states), len(names), len(CHANNELS))
            yield pd.Series(list(attention.features(state)))

    state = F.array(*(F.col(f"`{n}{c}`") for n in names for c in CHANNELS))
    out = rows.withColumn("_a", look(state))
    made = [f"attention__{k}" for k in range(width)]
    return out.withColumns({c: F.get("_a", F.lit(k)) for k, c in enumerate(made)}).drop("_a"), made


def causal(days: DataFrame, names: list[str], resp: str = "resp", **config) -> Attention:
    """Attention whose prior is each factor's share of the sizes of daily IC in days, and which aligns factors by the sign of theirs."""
    per_day = days.groupBy("date").agg(*(correlation(n, resp).alias(n) for n in names))
    ic = per_day.agg(*(F.avg(n).alias(n) for n in names)).first()
    size = np.array([abs(ic[n] or 0.0) for n in names])
    prior = size / size.sum() if size.sum() > 0 else np.full(len(names), 1.0 / len(names))
    return Attention(prior=tuple(prior), sign=tuple(float(np.sign(ic[n] or 1.0)) for n in names), **config)


def attention_stack(rows: DataFrame, names: list[str], split: int, validation: int, configs: list[Attention]) -> tuple[DataFrame, Attention]:
    """(predictions of the days from split on, the attention chosen): of several the one whose ridge, fitted before the last `validation` days before split, scores
    best on those days; fitted anew on all days before split. rows(date, day, security_id, channels, target, resp) are read once for each fit and prediction."""
    best, tokens = configs[0], [f"{n}{c}" for n in names for c in CHANNELS]
    if len(configs) > 1 and split - validation >= LEAST_DAYS:
        seen, scores = rows.filter(F.col("day") < split), []
        for config in configs:
            pred, _ = fixed(seen, tokens, split - validation, config.penalty, config.made(len(names)))
            scores.append(period_score(normalised(pred).join(seen.select("date", "security_id", "resp"), ["date", "security_id"])).first()["score"] or 0.0)
        best = configs[int(np.argmax(scores))]
    return fixed(rows, tokens, split, best.penalty, best.made(len(names)))[0], best


def period_score(pred: DataFrame, alpha: str = "alpha", resp: str = "resp") -> DataFrame:
    """One row: ic (times 100), ir, tvr (times 100, of the share of changes a day) and score of a daily prediction, without gates."""
    change = F.abs(F.col(alpha) - F.lag(alpha).over(Window.partitionBy("security_id").orderBy("date")))
    days = pred.withColumn("_c", change).groupBy("date").agg(correlation(alpha, resp).alias("ic"), ratio(F.coalesce(F.sum("_c"), F.lit(0.0)), F.sum(F.abs(alpha))).alias("tvr"))
    one = days.agg((F.avg("ic") * 100.0).alias("ic"), information_ratio("ic").alias("ir"), (F.avg("tvr") * 100.0).alias("tvr"))
    value = F.greatest(F.col("ic") - TVR_WEIGHT * F.col("tvr"), F.lit(0.0)) * F.sqrt(F.greatest("ir", F.lit(0.0))) * 100.0
    return one.withColumn("score", value)
