"""Lists by group, capped contexts, comparison curves, training weights and ranked inputs against plain Python."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessella.operators import combine, library, portfolio


def ideas(n: int, groups: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    return [(k, "hot" if r.random() < 0.4 else f"g{r.randrange(groups)}", float(r.randrange(20))) for k in range(n)]


BY = lambda: [F.desc("score"), F.col("k")]
SCHEMA = "k long, g string, score double"


@pytest.mark.parametrize(("n", "groups", "k"), [(300, 4, 10), (300, 40, 10), (7, 3, 20), (0, 1, 5)])
def test_diversified(spark, n, groups, k):
    rows = ideas(n, groups, n + groups)
    ordered = sorted(rows, key=lambda x: (-x[2], x[0]))
    best = list({x[1]: x for x in reversed(ordered)}.values())
    expected = sorted(ordered, key=lambda x: (x not in best, -x[2], x[0]))[:k]
    assert [tuple(x) for x in library.diversified(spark.createDataFrame(rows, SCHEMA), "g", BY(), k).collect()] == expected


@pytest.mark.parametrize(("n", "k", "groups"), [(300, 10, ["g1", "hot"]), (300, 12, ["g2", "none", "none too"]), (9, 20, ["g0", "hot"]), (300, 5, []), (0, 4, ["g0"])])
def test_balanced_fills_up(spark, n, k, groups):
    rows = ideas(n, 4, 3) + ([(1000, None, 99.0)] if n else [])
    ordered = sorted(rows, key=lambda x: (-x[2], x[0]))
    expected, share = [], max(1, k // max(1, len(groups))) + 1
    for g in groups:
        expected += [x for x in ordered if x[1] == g][:share]
    expected = (expected + [x for x in ordered[: 2 * k] if x not in expected])[:k]
    out = library.balanced(spark.createDataFrame(rows, SCHEMA), "g", BY(), k, groups).orderBy("place").collect()
    assert [(x.k, x.g, x.score) for x in out] == expected and [x.place for x in out] == list(range(1, len(expected) + 1))


def test_capped_context(spark):
    """A hot group, one text longer than the cap before others, empty and null texts, and equal texts."""
    r = random.Random(5)
    rows = [(k, r.choice(["hot", "hot", "b", None]), r.choice([None, "", "x" * 3, "same text", "y" * r.randrange(40)])) for k in range(2000)] + [(-1, "long", "z" * 500), (3000, "long", "after")]
    expected, running = set(), {}
    for k, g, t in sorted(rows):
        running[g] = running.get(g, 0) + len(t or "")
        if running[g] <= 300:
            expected.add((k, running[g]))
    out = library.capped_context(spark.createDataFrame(rows, "k long, g string, t string"), "t", [F.col("k")], 300, "g")
    assert out.columns == ["k", "g", "t", "running"]
    assert {(x.k, x.running) for x in out.collect()} == expected and expected


def test_comparison(spark):
    r = random.Random(1)
    days = [(f"2024-01-{d:02d}", e, float(r.randrange(8)), r.gauss(0, 1)) for d, n in ((1, 45), (2, 20), (3, 19), (4, 30)) for e in range(n)]
    frame = spark.createDataFrame(days, "date string, security_id long, pred double, ret double")
    out = {x.date: x for x in portfolio.comparison(frame).collect()}
    means, spreads = [], []
    for d in sorted(out):
        day = sorted((x for x in days if x[0] == d), key=lambda x: (x[2], x[1]))
        size = max(1, int(len(day) * 0.2))
        if len(day) < 20:
            assert all(v == 0.0 for c, v in out[d].asDict().items() if c != "date" and not c.endswith("aligned"))
            means.append((0.0, 0.0))
            spreads.append((0.0, 0.0))
            continue
        mean = lambda rows, c: statistics.fmean(x[c] for x in rows)
        means.append((mean(day, 2), mean(day, 3)))
        spreads.append(tuple(mean(day[-size:], c) - mean(day[:size], c) for c in (2, 3)))
        assert (out[d].predicted_spread, out[d].realized_spread, out[d].pnl) == pytest.approx((*spreads[-1], spreads[-1][1]))
        assert out[d].ic == pytest.approx(statistics.correlation([x[2] for x in day], [x[3] for x in day]))
    for found, column in ((means, "mean_prediction_aligned"), (spreads, "predicted_spread_aligned")):
        x, y = zip(*found)
        for d, v in zip(sorted(out), x):
            assert out[d][column] == pytest.approx((v - statistics.fmean(x)) * statistics.stdev(y) / statistics.stdev(x) + statistics.fmean(y))


def test_comparison_of_one_day_is_the_mean(spark):
    frame = spark.range(30).select(F.lit("d").alias("date"), F.col("id").alias("security_id"), F.col("id").cast("double").alias("pred"), (-F.col("id")).cast("double").alias("ret"))
    row = portfolio.comparison(frame).first()
    assert row.mean_prediction_aligned == row.mean_return == -14.5 and row.ic == pytest.approx(-1.0)


def test_training_weights(spark):
    rows = [("d1", 1, 0.0), ("d1", 2, -8.0), ("d2", 1, 2.0), ("d3", 1, None)]
    make = lambda x: combine.training_weights(spark.createDataFrame(x, "date string, security_id long, y double"), "y")
    assert {(x.date, x.security_id): x.train_weight for x in make(rows).collect()} == {("d1", 1): 0.75, ("d1", 2): 0.75 * 1.75, ("d2", 1): 1.5, ("d3", 1): 1.25}
    assert {x.security_id: x.train_weight for x in make(rows[:2]).collect()} == {1: 1.0, 2: 1.75}


def test_inputs_are_ranked_and_thin_ones_go(spark):
    rows = [(float(k), float(k), float(-k), float(k % 7), float(k) if k < 199 else None, 1.0) for k in range(250)]
    frame = spark.createDataFrame(rows, "pred double, a double, b double, c double, thin double, flat double")
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "factor string, score double")
    out = combine.input_correlations(frame, "pred", ["a", "b", "c", "thin", "flat"], scores).orderBy("place").collect()
    assert [x.factor for x in out] == ["b", "a", "c"] and out[0].corr == pytest.approx(-1.0) and out[2].score is None
    assert math.isclose(out[2].corr, statistics.correlation([x[0] for x in rows], [x[3] for x in rows]), abs_tol=1e-9)


def test_comparison_of_a_day_with_one_entity(spark):
    days = spark.createDataFrame([("2024-01-01", 1, 0.5, 0.1), ("2024-01-02", 1, 0.1, 0.2), ("2024-01-02", 2, 0.3, 0.4)], "date string, security_id long, pred double, ret double")
    assert [(r.date, r.pnl) for r in portfolio.comparison(days, least=1).orderBy("date").collect()] == [("2024-01-01", 0.0), ("2024-01-02", pytest.approx(0.2))]
