"""Walk-forward models, lag tensors and attention features against numpy; spans against the unsplit formulas."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.dsl import formula
from tessella.operators import combine as K
from tessella.operators import models as D
from tessella.operators import spans as S
from tessella.plans import catalogue
from tessella.plans import models as plans
from tessella.sources import panel as P

SF = "/root/testdata/sf0.001"
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def days(spark):
    r = np.random.default_rng(4)
    rows = []
    for d in range(40):
        for i in range(12):
            if r.random() < 0.9:
                x = r.normal(size=3)
                rows.append((datetime.date(2024, 1, 1) + datetime.timedelta(d), i, float(x[0]), None if r.random() < 0.1 else float(x[1]), 1.0, float(x @ [0.5, -0.2, 0.1] + r.normal()) if r.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "date date, security_id long, a double, b double, c double, resp double")
    return D.day_index(df.withColumn("target", F.when(F.col("resp").isNotNull(), K.standard_target(F.col("resp")))))


def plain_ridge(x, y, w, penalty):
    """Weighted least squares with a penalty on features scaled by their weighted deviation, by stacking rows; constant features get 0."""
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    sd = np.sqrt(np.average((x - mx) ** 2, axis=0, weights=w))
    live = sd > 1e-6
    xs = (x - mx)[:, live] / sd[live]
    rows = np.concatenate((xs * np.sqrt(w)[:, None], np.sqrt(penalty) * np.eye(live.sum())))
    b = np.zeros(x.shape[1])
    b[live] = np.linalg.lstsq(rows, np.concatenate(((y - my) * np.sqrt(w), np.zeros(live.sum()))), rcond=None)[0] / sd[live]
    return my - mx @ b, b


def test_prequential_sees_no_later_day(days):
    pdf = days.na.fill(0.0, NAMES).toPandas()
    windows = D.WalkForward(25, 5, 8)
    rows = days.na.fill(0.0, NAMES)
    out = D.prequential(rows, NAMES, windows, penalty=2.0).toPandas().set_index(["date", "security_id"])["pred"]
    assert len(out) == len(pdf)
    models = {}
    for k in range(8):
        first, last = max(0, k * 5 - 25), k * 5 - 1
        own = pdf[(pdf.day >= first) & (pdf.day <= last) & pdf.target.notna()]
        if last - first + 1 < 20:
            models[k] = (0.0, np.full(3, 1 / 3))
        else:
            w = (1 + 0.25 * own.target.abs().clip(upper=3)) * (0.75 + 0.5 * (own.day - first) / (last - first))
            models[k] = plain_ridge(own[NAMES].to_numpy(), own.target.to_numpy(), w.to_numpy(), 2.0)
    for r in pdf.itertuples():
        of = [k for k in range(8) if k * 5 <= r.day < k * 5 + 8]
        expected = np.mean([models[k][0] + np.dot([r.a, r.b, r.c], models[k][1]) for k in of])
        assert out[(r.date, r.security_id)] == pytest.approx(expected, abs=1e-9)
    # what comes after a window's first day changes nothing that the window predicts
    later = rows.withColumn("target", F.when(F.col("day") >= 25, -F.col("target") * 3).otherwise(F.col("target")))
    changed = D.prequential(later, NAMES, windows).toPandas().set_index(["date", "security_id"])["pred"]
    early = [k for k in zip(pdf.date[pdf.day < 30], pdf.security_id[pdf.day < 30], strict=True)]
    assert np.allclose(out[early], changed[early]) and not np.allclose(out, changed[out.index])


def test_partitioning_does_not_matter(days):
    rows = D.model_frame(days, NAMES)
    one, _ = D.attention_stack(rows, NAMES, 30, 5, [D.Attention(heads=3)])
    two, _ = D.attention_stack(rows.repartition(7, "security_id"), NAMES, 30, 5, [D.Attention(heads=3)])
    a, b = (x.toPandas().sort_values(["date", "security_id"]).pred.to_numpy() for x in (one, two))
    assert len(a) == days.filter("day >= 30").count() and np.allclose(a, b, atol=1e-9)


@pytest.mark.parametrize("kind", ["plain", "causal"])
def test_attention_against_numpy(spark, days, kind):
    rows = D.model_frame(days, NAMES)
    pdf = rows.toPandas()
    config = D.Attention(heads=4) if kind == "plain" else D.causal(days.filter("day < 25"), NAMES, seed=51, heads=4, temperature=0.75, penalty=1.6, decay=0.62, prior_strength=0.15)
    state = pdf[[f"{n}{c}" for n in NAMES for c in D.CHANNELS]].to_numpy().reshape(-1, 3, 6)
    if kind == "causal":
        early = pdf[pdf.day < 25]
        ic = []
        for n in NAMES:
            raw = days.filter("day < 25").toPandas()
            per_day = [g[[n, "resp"]].dropna().corr().iloc[0, 1] for _, g in raw.groupby("date") if g[n].std() > 0]
            ic.append(np.nanmean(per_day) if per_day else 0.0)
        assert len(early) and config.prior == pytest.approx(tuple(np.abs(ic) / np.abs(ic).sum()), abs=1e-9)
        state = state * np.sign([v or 1.0 for v in ic])[None, :, None]
    q = np.random.default_rng(config.seed).normal(0.0, 1.0, (4, 3, 6)) * [1, 1, 1, config.decay, config.decay, config.decay**2]
    parts = [state.reshape(len(state), -1)]
    for h in range(4):
        pooled, sizes, prior = [], [], []
        for s in state:
            scores = np.clip([np.sum(s[f] * q[h][f]) / config.temperature for f in range(3)], -8, 8)
            if config.prior is not None:
                scores = scores + config.prior_strength * np.log(np.maximum(config.prior, 1e-8))
            w = np.exp(scores - scores.max())
            w /= w.sum()
            pooled.append(sum(w[f] * s[f] for f in range(3)))
            sizes.append(sum(w[f] * np.abs(s[f]) for f in range(3)))
            prior.append([np.dot(w, config.prior)] if config.prior is not None else [])
        parts += [np.array(pooled), np.array(sizes), np.array(prior).reshape(len(state), -1)]
    x = np.concatenate(parts, 1)
    known = ((pdf.day < 30) & pdf.target.notna()).to_numpy()
    w = (1 + 0.25 * pdf.target.abs().clip(upper=3)) * (0.75 + 0.5 * pdf.day / 29)
    b0, b = plain_ridge(x[known], pdf.target[known].to_numpy(), w[known].to_numpy(), config.penalty)
    pred, _ = D.attention_stack(rows, NAMES, 30, 5, [config])
    out = pred.toPandas().set_index(["date", "security_id"])["pred"]
    late = (pdf.day >= 30).to_numpy()
    expected = pd.Series(b0 + x[late] @ b, index=pd.MultiIndex.from_frame(pdf.loc[late, ["date", "security_id"]]))
    assert np.allclose(out[expected.index], expected, atol=1e-6)


def test_config_of_best_validation_score(days):
    rows = D.model_frame(days, NAMES)
    configs = [D.Attention(seed=s, heads=2, penalty=p) for s, p in ((1, 1.0), (2, 50.0))]
    scores = []
    for c in configs:
        made, features = D.with_attention(rows, NAMES, c)
        pred = D.normalised(D.fixed(made.filter("day < 34"), features, 26, c.penalty)[0]).join(days.select("date", "security_id", "resp"), ["date", "security_id"])
        scores.append(D.period_score(pred).first()["score"])
    assert D.attention_stack(rows, NAMES, 34, 8, configs)[1] == configs[int(np.argmax(scores))]


def test_attention_query_against_numpy(spark):
    """The registered query, over the whole smallest table."""
    rows = D.model_frame(plans.six_signals(spark, SF), plans.NAMES).toPandas()
    config = D.Attention()
    x = config.features(rows[[f"{n}{c}" for n in plans.NAMES for c in D.CHANNELS]].to_numpy().reshape(-1, 6, 6))
    known = ((rows.day < 60) & rows.target.notna()).to_numpy()
    w = (1 + 0.25 * rows.target.abs().clip(upper=3)) * (0.75 + 0.5 * rows.day / 59)
    b0, b = plain_ridge(x[known], rows.target[known].to_numpy(), w[known].to_numpy(), config.penalty)
    out = catalogue.QUERIES["attention_ridge"](spark, SF).toPandas().set_index(["date", "security_id"])["pred"]
    late = rows[rows.day >= 60]
    expected = pd.Series(b0 + x[rows.day >= 60] @ b, index=pd.MultiIndex.from_frame(late[["date", "security_id"]]))
    assert len(out) == len(expected) and np.allclose(out[expected.index], expected, atol=1e-6)


def test_too_short_a_history(days):
    pred, model = D.fixed(days.filter("day < 15").na.fill(0.0, NAMES), NAMES, 10, 1.0)
    assert model is None and pred.count() == days.filter("day >= 10 and day < 15").count()
    row = pred.join(days.na.fill(0.0, NAMES), ["date", "security_id"]).first()
    assert row.pred == pytest.approx((row.a + row.b + row.c) / 3)


def test_strongest_and_folded(days):
    seen = days.toPandas()
    ic = {n: abs(np.nanmean([g[[n, "resp"]].dropna().corr().iloc[0, 1] for _, g in seen.groupby("date")])) for n in ("a", "b")}
    assert D.strongest(days, NAMES, 2) == [*sorted(ic, key=lambda n: -ic[n])]
    assert D.folded(np.array([9.0, 1.0, -2.0, 1.0]), ["a__z__lag0", "b__z__lag0", "a__rank__lag0"], NAMES) == {"a": 0.5, "b": 0.5, "c": 0.0}


# --- spans


@pytest.fixture(scope="module")
def panel(spark):
    r = random.Random(2)
    rows = [(i, b, None if r.random() < 0.15 else r.random() * 10, r.random()) for i in range(5) for b in range(1, 31)]
    df = spark.createDataFrame(rows, "security_id long, bar_idx long, volume double, vwap double")
    return df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("bar_idx") / 3).cast("int")))


FORMULAS = {"e": "ts_ema(volume, 2)", "n": "ts_mean(cs_rank(ts_sum(volume, 4)), 3)", "d": "lag(volume, 2) - cs_demean(vwap)", "r": "ts_rank(volume, 5)", "k": "ts_decay_linear(vwap, 6)", "c": "ts_corr(volume, vwap, 7)"}


@pytest.mark.parametrize("bars", [1, 4, 7, 100])
def test_spans_give_the_unsplit_values(panel, bars):
    whole = formula.evaluate(panel, FORMULAS).orderBy("security_id", "bar_idx").toPandas()
    split = S.evaluate(panel, FORMULAS, bars).orderBy("security_id", "bar_idx").toPandas()
    assert list(whole.columns) == list(split.columns) and len(whole) == len(split)
    pd.testing.assert_frame_equal(whole, split, check_exact=False, rtol=1e-9)


def test_one_entity_is_dealt_out(panel):
    one = S.split(panel.filter("security_id = 1"), 3, 5).groupBy("_span").count().collect()
    assert {r["_span"]: r["count"] for r in one} == {0: 4, 1: 8, 2: 8, 3: 8, 4: 8, 5: 8, 6: 4}


def test_between(panel):
    whole = formula.evaluate(panel, FORMULAS).filter("date between '2024-01-04' and '2024-01-07'").orderBy("security_id", "bar_idx").toPandas()
    part = S.between(panel, FORMULAS, "2024-01-04", "2024-01-07", bars=4).orderBy("security_id", "bar_idx").toPandas()
    pd.testing.assert_frame_equal(whole, part, rtol=1e-9)
    warm = S.between(panel, {"m": "ts_sum(vwap, 30)"}, "2024-01-04", "2024-01-07", warm_up_days=1, bars=4).toPandas()
    only = panel.filter("date between '2024-01-03' and '2024-01-07'").toPandas().sort_values("bar_idx")
    assert len(warm) == 60 and all(v == pytest.approx(only[(only.security_id == i) & (only.bar_idx <= b)].vwap.sum()) for i, b, v in warm[["security_id", "bar_idx", "m"]].itertuples(index=False))
    assert S.between(panel, FORMULAS, "2030-01-01", "2030-02-01").count() == 0


def test_callable(panel):
    def factor(rows: pd.DataFrame) -> pd.Series:
        return rows["volume"].rolling(3, min_periods=1).mean() / rows["vwap"].where(rows["bar_idx"] != 5, 0.0)

    whole = formula.evaluate(panel, {"y": "ts_mean(volume, 3) / vwap"}).filter("bar_idx <> 5").orderBy("security_id", "bar_idx").toPandas().y
    for bars in (2, 50):
        out = S.callable_factor(panel, factor, 2, ["volume", "vwap"], bars=bars).orderBy("security_id", "bar_idx").toPandas()
        assert len(out) == 150 and out[out.bar_idx == 5].alpha.isna().all()
        assert np.allclose(out[out.bar_idx != 5].alpha.to_numpy(dtype=float), whole.to_numpy(dtype=float), equal_nan=True)
    with pytest.raises(Exception, match="1 values for"):
        S.callable_factor(panel, lambda rows: pd.Series([1.0]), 2, ["volume"]).collect()


def test_bad_formula(panel):
    for bad in ("ts_mean(nothing, 3)", "ts_ewm(volume, 3)"):  # an unknown field; a value that is carried without end
        with pytest.raises(formula.FormulaError):
            S.evaluate(panel, {"x": bad})


def test_adjusted_means_are_carried(spark):
    rows = [(1, b, 4.0 if b == 0 else 1.0 if b == 3 else None) for b in range(200)]
    df = spark.createDataFrame(rows, "security_id long, bar_idx long, x double")
    out = [r.y for r in formula.evaluate(df, {"y": "ts_ewm(x, 2)"}).orderBy("bar_idx").collect()]
    expected = pd.Series([r[2] for r in rows], dtype=float).ewm(span=2).mean()
    assert np.allclose(out, expected)


def test_panel_grows_with_the_table(spark):
    assert P.part_panel(spark, SF).select("security_id").distinct().count() == 200


def test_callable_gets_many_spans_in_one_call(panel):
    def factor(rows: pd.DataFrame) -> pd.Series:
        return rows.groupby("group", sort=False)["volume"].rolling(3, min_periods=1).sum()

    whole = formula.evaluate(panel, {"y": "ts_sum(volume, 3)"}).orderBy("security_id", "bar_idx").toPandas().y
    out = S.callable_factor(panel.coalesce(1), factor, 2, ["volume"], bars=4, many=True).coalesce(1).orderBy("security_id", "bar_idx").toPandas().alpha
    assert np.allclose(out.to_numpy(dtype=float), whole.to_numpy(dtype=float), equal_nan=True)


def test_wide_features_stay_in_their_task(spark, days):
    rows = D.model_frame(days.withColumn("n_days", F.lit(40)), NAMES)
    pred, _ = D.attention_stack(rows, NAMES, 30, 5, [D.Attention(heads=3)])
    assert "attention__" not in pred._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_beside_each_other_are_not_exchanged(spark, days):
    """F2: correlations of signals of the same rows are those of their joined z-scores, without a join or window of rows."""
    from tessella.streaming import correlations as Q

    days = days.withColumn("c", F.col("a") - F.col("resp"))
    long = lambda names: Q.z_scores(days.select("date", "security_id", F.inline(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("alpha")) for n in names)))))
    want = Q.new_pairs(long(NAMES[1:]), long(NAMES[:1]), 10)
    got = Q.new_pairs_beside(days, NAMES[1:], NAMES[:1], 10)
    close = lambda df: {(r.a, r.b): (pytest.approx(r["corr"]), r.n) for r in df.collect()}
    assert len(close(want)) == 3 and {(r.a, r.b): (r["corr"], r.n) for r in got.collect()} == close(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_models_are_scored_side_by_side(days):
    """F8: turnover is taken from rows that have all models, not from a row for each model."""
    from tessella.operators import fusion

    scores = fusion.validation_scores(days, NAMES)
    for n in NAMES:
        one = D.period_score(days.withColumn("alpha", F.col(n))).first()
        assert scores.filter(F.col("model") == n).select("ic", "ir", "tvr", "score").first() == pytest.approx(tuple(one[c] for c in ("ic", "ir", "tvr", "score")))
    windows = [x for x in scores._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert len(windows) == 1 and "model" not in windows[0]


def test_large_frames_of_days_are_written_in_passes(spark, days, monkeypatch, tmp_path):
    """channels and lags of a large table are those of a small one, and are read from tables, not exchanged each time they are read."""
    from tessella.llm import scratch
    from tessella.operators import cs

    small = [D.model_frame(days, NAMES), D.tensor_columns(days, NAMES, 3)[0]]
    want = [[x.orderBy("date", "security_id").toPandas()] for x in small]
    for module, name, value in ((cs, "SMALL", 0), (cs, "SLICE", 300), (cs, "RANGE", 16), (scratch, "PASS", 200)):
        monkeypatch.setattr(module, name, value)
    days.write.parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    for got, (w,) in zip([D.model_frame(stored, NAMES), D.tensor_columns(stored, NAMES, 3)[0]], want, strict=True):
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
        have = got.orderBy("date", "security_id").toPandas()
        numbers = [c for c in w.columns if w[c].dtype == "float64"]
        assert set(have.columns) <= set(w.columns) and len(have) == len(w) and len(numbers) > 10
        assert all(np.allclose(have[c], w[c], atol=1e-12, equal_nan=True) for c in numbers if c in have)


def test_spans_after_large_ranks_are_written_in_passes(spark, monkeypatch):
    """rows with halos are not shuffled at once after their ranks, and only the result stays."""
    from pathlib import Path

    from tessella.llm import scratch
    from tessella.operators import cs

    panel = P.part_panel(spark, SF).drop("resp").filter("security_id % 9 = 0")
    asked = {"x": "ts_max(cs_rank(volume), 5)", "y": "cs_rank(ts_sum(volume, 3))"}
    want = sorted(map(repr, S.evaluate(panel, asked, 24, keep=("security_id", "bar_idx")).collect()))
    for module, name, value in ((cs, "SMALL", 0), (cs, "SLICE", 3000), (cs, "RANGE", 16), (scratch, "PASS", 1000), (scratch, "PASSES", 2)):
        monkeypatch.setattr(module, name, value)
    tables = lambda: set(Path(scratch.shared_dir(spark).removeprefix("file:")).iterdir())
    before = tables()
    got = S.evaluate(panel, asked, 24, keep=("security_id", "bar_idx"))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [p.name.startswith("span-values-") for p in tables() - before] == [True]
    assert sorted(map(repr, got.collect())) == want
