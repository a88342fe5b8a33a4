"""The formula language: what is accepted, how far back it looks, and printing."""

from __future__ import annotations

import pytest

from tessella.dsl import formula


@pytest.mark.parametrize("f", ["close_trade_px -1", "close_trade_px-1e-8", "volume > 1.5", "rank(-vwap)", "combine_rank(vwap, volume)", "weighted_sum(1, vwap, -2, volume)", "ret_1"])
def test_valid(f):
    assert formula.check(f).valid
    again = formula.canonical(f)
    assert formula.canonical(again) == again


@pytest.mark.parametrize("f", ["resp", "ts_mean(vwap)", "ts_mean(vwap, 0)", "ts_mean(vwap, 2.5)", "ts_mean(vwap, volume)", "open('x')", "vwap.real", "__import__('os')", "vwap if volume else 1", "foo(vwap)", "1 +", "unknown_field", "[x for x in vwap]"])
def test_invalid(f):
    assert not formula.check(f).valid


def test_look_back_adds_up():
    assert formula.check("ts_mean(delta(vwap, 3), 5)").look_back == 7
    assert formula.check("cs_rank(lag(vwap, 2)) + ts_max(vwap, 4)").look_back == 3


def test_stages_share_an_exchange(spark):
    df = spark.createDataFrame([(i, b, float(i + b)) for i in range(3) for b in range(5)], "security_id long, bar_idx long, x double")
    many = {f"y{n}": f"cs_rank(ts_mean(x, {n})) + cs_rank(ts_std(x, {n}))" for n in (2, 3, 4)}
    plan = formula.evaluate(df, many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_grid():
    assert formula.grid("{op}(vwap, {n})", op=["ts_mean"], n=[2, 3]) == {"ts_mean_2": "ts_mean(vwap, 2)", "ts_mean_3": "ts_mean(vwap, 3)"}
