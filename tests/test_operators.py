"""Operators on hand-written panels with gaps, ties and constant windows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import cs
from tessella.dsl import formula
from tessella.operators import cs, metrics, research


@pytest.fixture(scope="module")
def series(spark):
    values = [1, 3, 2, None, 5, 5, 0, 7]
    return spark.createDataFrame([(1, i + 1, None if v is None else float(v)) for i, v in enumerate(values)], "security_id long, bar_idx long, x double")


def run(df, f):
    out = formula.evaluate(df, {"y": f}).orderBy("security_id", "bar_idx").collect()
    return [r.y for r in out]


@pytest.mark.parametrize(("f", "last"), [("ts_std(x, 4)", 2.986079), ("ts_skew(x, 4)", -1.380237), ("ts_kurt(x, 4)", 2.602498), ("ts_quantile(x, 4, 0.8)", 5.8), ("ts_mean(x, 4)", 4.25)])
def test_rolling(series, f, last):
    assert run(series, f)[-1] == pytest.approx(last, abs=1e-6)


def test_gap_counts_bars(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 5.0), (2, 0, 2.0), (2, 1, 3.0), (2, 2, 7.0)], "security_id long, bar_idx long, x double")
    assert run(df, "ts_mean(x, 2)") == [1.0, 1.0, 5.0, 2.0, 2.5, 5.0]
    assert run(df, "lag(x, 1)") == [None, 1.0, None, None, 2.0, 3.0]
    assert run(df, "ts_ema(x, 2)")[:3] == [1.0, 1.0, pytest.approx(4.428571, abs=1e-6)]


def test_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate([1.0, 2.0, 2.0, None])], "security_id long, bar_idx long, x double")
    assert run(df, "pct_rank(x)") == [pytest.approx(v) if v is not None else None for v in (1 / 3 - 0.5, 2.5 / 3 - 0.5, 2.5 / 3 - 0.5, None)]
    assert run(df, "cs_rank(x)") == [0.0, 0.75, 0.75, None]
    assert run(df, "gt(x, 0.5)") == [1.0, 1.0, 1.0, 0.0]
    assert run(df, "ifelse(x, 1, 2)") == [1.0, 1.0, 1.0, 2.0]
    assert run(df, "min_of(x, 2)") == [1.0, 2.0, 2.0, None]


def test_constant_window_has_no_correlation(spark):
    df = spark.createDataFrame([(1, i, 1.0, float(i)) for i in range(3)], "security_id long, bar_idx long, x double, y double")
    assert run(df, "ts_corr(x, y, 3)") == [None, None, None]
    assert run(df, "ts_kurt(x, 3) + ts_skew(x, 3)") == [None, None, None]


def test_cross_section_properties(spark):
    df = spark.createDataFrame([(i, b, float((i * 7 + b * 3) % 11)) for i in range(9) for b in range(4)], "security_id long, bar_idx long, x double")
    out = formula.evaluate(df, {"s": "cs_scale(x)", "d": "cs_demean(x)", "r": "cs_rank(x)"}).groupBy("bar_idx").agg(F.sum("s"), F.sum(F.abs("s")), F.avg("d"), F.min("r"), F.max("r")).collect()
    for _, s, a, d, lo, hi in out:
        assert abs(s) < 1e-9 and abs(a - 1) < 1e-9 and abs(d) < 1e-9 and lo >= 0 and hi <= 1


def test_no_look_ahead(series):
    for f in ("ts_rank(x, 4)", "ts_decay_linear(x, 2)", "ts_argmax(x, 3)", "ts_ema(x, 3)", "ts_zscore(x, 4)"):
        whole = run(series, f)
        assert run(series.filter("bar_idx <= 5"), f) == whole[:5]


@pytest.mark.parametrize(("ic", "ir", "tvr", "spread", "score"), [(2.1324, 5.5736, 55.6497, True, 496.8581), (1.6654, 24.2608, 691.6246, True, 0.0), (1.7912, 28.2852, 714.9574, True, 0.0), (2.1324, 5.5736, 55.6497, False, 0.0)])
def test_golden_scores(spark, ic, ir, tvr, spread, score):
    passes, value = metrics.score(F.lit(ic), F.lit(ir), F.lit(tvr), F.lit(spread))
    row = spark.range(1).select(passes, value).first()
    assert row[1] == pytest.approx(score, abs=0.02) and row[0] == (score > 0)


@pytest.mark.parametrize(("mode", "ic", "tvr", "passes"), [("official", 0.007, 5.0, True), ("official", 0.007, 399.0, True), ("official", 0.007, 400.0, False), ("official", 0.006, 5.0, False), ("submission", 0.61, 399.0, True), ("submission", 0.61, 400.0, False), ("submission", 0.6, 5.0, False)])
def test_gates(spark, mode, ic, tvr, passes):
    assert spark.range(1).select(metrics.score(F.lit(ic), F.lit(2.6), F.lit(tvr), F.lit(True), mode)[0]).first()[0] == passes


def _book(spark, weight_of, hours=range(24), days=4, entities=300):
    """A panel whose alpha predicts resp well, but for a little noise."""
    rows = []
    for d in range(days):
        for h in hours:
            for i in range(entities):
                x = weight_of(i, d, h)
                rows.append((i, d * 24 + h, f"2024-01-0{d + 1} {h:02d}:00:00", x, x + ((i * 31 + h * 7 + d * 5) % 13 - 6) * 0.3, 0))
    df = spark.createDataFrame(rows, "security_id long, bar_idx long, datetime string, alpha double, resp double, trading_restriction int")
    return df.withColumn("datetime", F.col("datetime").cast("timestamp")).withColumn("date", F.to_date("datetime"))


def test_official_turnover_is_not_a_ratio(spark):
    """24 bars of changes as large as the book: a raw turnover over 4 a day, which only a gate of 400 lets pass."""
    row = metrics.evaluate(_book(spark, lambda i, d, h: ((i + h * 17) % 300 - 149.5) / 300), mode="official").first()
    assert 4 < row.tvr < 400 and row.unconcentrated is False  # 300 entities: a weight of over 50 ten-thousandths
    row = metrics.evaluate(_book(spark, lambda i, d, h: 1.0 if (i + h * (1 + d)) % 2 else -1.0, entities=700), mode="official").first()
    assert 4 < row.tvr < 400 and row.unconcentrated and row.passes and row.score > 0


def test_submission_looks_at_stamps_only(spark):
    """Between the stamps the book turns around; at the stamps it stands still."""
    book = _book(spark, lambda i, d, h: (1.0 if i % 2 else -1.0) * (1 if h in (1, 2, 3) else -1), entities=40)
    stamps = ["01:00:00", "02:00:00", "03:00:00"]
    assert metrics.evaluate(book).first().tvr > 0
    row = metrics.evaluate(book, stamps=stamps).first()
    assert row.tvr == 0 and row.ic == pytest.approx(metrics.evaluate(book.filter("hour(datetime) in (1, 2, 3)")).first().ic)


def test_scores_by_run(spark):
    one, two = _book(spark, lambda i, d, h: (i % 7 - 3) / 10, range(3)), _book(spark, lambda i, d, h: (i * h % 5 - 2) / 10, range(3))
    both = one.withColumn("run", F.lit("a")).union(two.withColumn("run", F.lit("b")))
    for mode in metrics.MODES:
        rows = {r.run: r for r in metrics.evaluate(both, mode=mode, by=["run"]).collect()}
        for run, alone in (("a", one), ("b", two)):
            assert tuple(rows[run])[1:] == pytest.approx(tuple(metrics.evaluate(alone, mode=mode).first()))


def test_restriction(spark):
    df = spark.createDataFrame([(1, -1.0), (1, 1.0), (2, 1.0), (3, 1.0), (0, 1.0), (None, -1.0)], "c int, a double")
    assert [r[0] for r in df.select(metrics.restricted(F.col("a"), F.col("c"))).collect()] == [None, 1.0, None, None, 1.0, -1.0]


def test_low_correlation_set():
    pairs = [("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.1), ("a", "d", None)]
    assert research.low_correlation_set(pairs, {"a": 9.0, "b": 2.0, "c": 1.0}) == ["b", "c"]
    assert math.isclose(sum(len(x) for x in research.low_correlation_set([], {"q": 1.0})), 1)


def test_exponential_mean_is_carried_over_any_gap(spark):
    rows = [(1, b, 4.0 if b == 0 else 7.0 if b in (300, 301) else None) for b in range(400)]
    df = spark.createDataFrame(rows, "security_id long, bar_idx long, x double")
    assert run(df, "ts_ema(x, 5)")[100:] == [4.0] * 200 + [pytest.approx(7.0)] * 100


def test_search_ranks_only_values(spark):
    from tessella.operators import candidates

    rows = [(i, b, float(i * b % 5), None if b % 2 else float(i), None, float(i)) for i in range(4) for b in range(4)]
    df = spark.createDataFrame(rows, "security_id long, bar_idx long, volume double, vwap double, dvolume double, resp double").withColumn("date", F.lit("2024-01-01").cast("date"))
    out = candidates.search(df, {"a__1": "vwap", "b__1": "dvolume"})
    assert {(r.candidate, r.sign): (r.ic, r.days) for r in out.collect()} == {("a__1", 1): (pytest.approx(1.0), 1), ("a__1", -1): (pytest.approx(-1.0), 1), ("b__1", 1): (None, 0), ("b__1", -1): (None, 0)}
    assert "isnotnull(x" in out._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_by_ranges_of_values(spark):
    """Bars cut into ranges, with ties, nulls, zeros of both signs and values without end, have the ranks of whole bars; no window is over a bar."""
    odd = [None, 0.0, -0.0, float("inf"), float("-inf"), float("nan"), 5e-324, -5e-324, 1e308]
    rows = [(b, i, odd[i] if i < len(odd) else 7.0 if i % 3 == 0 else ((i * 37 + (b or 0)) % 101 - 50) / 7, None if i % 4 else float(i % 5)) for b in (1, 2, None) for i in range(240)]
    df = spark.createDataFrame(rows, "bar_idx long, security_id long, x double, y double")
    given = {"a": (cs.pct_rank_centred, F.col("x")), "b": (cs.rank, F.col("y") * 2), "c": (cs.average_rank, F.col("x") - F.col("y"))}
    whole = df.withColumns({n: how(x) for n, (how, x) in given.items()})
    parts = cs.ranked(df, given, most=16, task=100)
    assert parts.columns == whole.columns
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3 and plan.count("_dealt") >= 3


def test_a_large_grid_is_dealt_out(spark, tmp_path, monkeypatch):
    """Few entities of many bars are not one task's: tasks follow the grid's rows."""
    from tessella.sources import panel as P

    path = str(tmp_path / "bars.parquet")
    spark.range(40).selectExpr("id as security_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 20 as int)) as datetime", "cast(id as double) as volume").write.parquet(path)
    bars = spark.read.parquet(path).withColumn("date", F.to_date("datetime"))
    whole = sorted(map(repr, P.densify(bars).collect()))
    monkeypatch.setattr(P, "SMALL", 10)
    monkeypatch.setattr(P, "TASK", 100)
    dealt = P.densify(bars)
    assert dealt.rdd.getNumPartitions() == 8
    assert sorted(map(repr, dealt.collect())) == whole and len(whole) == 800


def test_nearest_vectors_as_by_plain_products(spark, tmp_path):
    """vector_topk with copies, missing, short, NULL and NaN components has the rows of plain products, over several blocks of queries and rows."""
    from tessella.functions import text as X
    from tessella.plans import texts

    odd = {3: None, 5: [1.0, 2.0], 200: None, 300: [1.0], 7: [1.0, None, 2.0], 8: [0.0, 0.0, 0.0], 9: [float("nan"), 1.0, 1.0]}
    rows = [(i, odd.get(i, [float(i % 7) - 3.0, float(i % 5), 1.0 + i % 3]), i % 2) for i in range(601)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    e = spark.read.parquet(str(tmp_path / "embeddings.parquet")).select("vec_id", X.unit(F.col("embedding")).alias("v"))
    met = e.filter("vec_id % 100 = 0").selectExpr("vec_id as query", "v as u").join(e, F.col("query") != F.col("vec_id")).select("query", "vec_id", F.round(X.dot(F.col("u"), F.col("v")), 6).alias("cosine"))
    met.createOrReplaceTempView("met")
    want = spark.sql("select * from (select *, row_number() over (partition by query order by cosine desc, vec_id) as place from met) where place <= 5")
    got = texts._vectors(spark, str(tmp_path), block=50, asked=2)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # pairs don't become rows


def test_a_large_signal_is_scored_without_a_window_by_bar(spark, monkeypatch):
    """bars without any alpha are found by aggregation, and no window takes a whole bar; scores by run stay as they are."""
    book = _book(spark, lambda i, d, h: (i * 7 + h * 3) % 11 / 10 - 0.5, range(20)).withColumn("alpha", F.expr("if(bar_idx % 5 = 2 or (security_id + bar_idx) % 6 = 0, null, alpha)")).withColumn("run", F.when(F.col("security_id") % 2 == 0, "a"))
    before = {r.run: tuple(r)[1:] for r in metrics.evaluate(book, by=["run"]).collect()}
    left_out = metrics.bar_turnover(book, overnight=False).orderBy("bar_idx").collect()
    monkeypatch.setattr(cs, "SMALL", 0)
    large = metrics.evaluate(book, by=["run"])
    assert len(before) == 2 and all(x[2] > 0 for x in before.values())
    assert {r.run: pytest.approx(tuple(r)[1:]) for r in large.collect()} == before
    assert [tuple(r) for r in metrics.bar_turnover(book, overnight=False).orderBy("bar_idx").collect()] == [pytest.approx(tuple(r)) if r.tvr is not None else tuple(r) for r in left_out]
    windows = [x for x in large._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert windows and all("security_id" in x for x in windows)


def test_a_large_grid_is_dealt_out_on_both_sides_of_its_join(spark, monkeypatch):
    """the tasks of the grid's join follow its rows, not the session's setting."""
    from tessella.sources import panel

    whole = panel.part_panel(spark, "/root/testdata/sf0.001").orderBy("security_id", "bar_idx").collect()
    monkeypatch.setattr(panel, "SMALL", 0)
    monkeypatch.setattr(panel, "TASK", 1000)
    large = panel.part_panel(spark, "/root/testdata/sf0.001")
    assert large.orderBy("security_id", "bar_idx").collect() == whole
    plan = large._jdf.queryExecution().executedPlan().toString()
    cells = [x for x in plan.splitlines() if "hashpartitioning(security_id" in x and "datetime" in x]
    assert len(cells) >= 3 and all("REPARTITION_BY_NUM" in x for x in cells)


def test_large_ranks_shuffle_a_slice_of_bars_at_a_time(spark, monkeypatch):
    """Bars are ranked slice by slice into a table, in passes over entities, with the ranks of whole bars; what is only ranked along is not kept, and nothing but the result stays."""
    from tessella.llm import scratch

    rows = [(b, i, None if i % 7 == 0 else ((i * 37 + b) % 101 - 50) / 7 + i / 1e6, float(i % 5) if i % 3 else None, f"n{i}") for b in range(9) for i in range(120)]
    df = spark.createDataFrame(rows, "bar_idx long, security_id long, x double, y double, name string").withColumns({n: F.col("x") for n in ("size", "total", "s", "part", "first", "below")})
    given = {"a": (cs.pct_rank_centred, F.col("x")), "b": (cs.rank, F.col("y") * 2), "c": (cs.average_rank, F.col("x") - F.col("y"))}
    whole = df.withColumns({n: how(x) for n, (how, x) in given.items()})
    for module, name, value in ((cs, "SMALL", 0), (cs, "SLICE", 300), (cs, "RANGE", 16), (cs, "TASK", 100), (scratch, "PASS", 400)):
        monkeypatch.setattr(module, name, value)
    for only in (None, F.col("y").isNotNull()):
        used: list = []
        got = cs.with_ranks(df, given, only=only, used=used)
        want = whole if only is None else whole.filter(only)
        assert got.columns == want.columns and len(used) == 1
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan  # the slices are ranked, so their exchanges are gone
