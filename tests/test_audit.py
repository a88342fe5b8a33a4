"""Reports on formulas, key assertions, and the grid of submissions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.dsl import audit
from tessella.operators import memory, submit


@pytest.mark.parametrize(("text", "passed"), [("cs_rank(volume)", (True, True, True)), ("resp + 1", (False, False, True)), ("nothing_like(volume)", (False, True, False)), ("volume +", (False, True, True))])
def test_compliance(text, passed):
    found = audit.compliance(text)
    assert list(found) == ["syntax", "no_leakage", "operators_allowed"] and tuple(ok for ok, _ in found.values()) == passed
    assert all((detail == "OK") == ok for ok, detail in found.values())


def test_audit(spark):
    cases = {"ts_mean(volume, 3)": [], "RESP * 2": ["forbidden: resp"], "lead (volume, 1) + future_px": ["forbidden: lead(", "forbidden: future_"], "delay(x, -2)": ["negative delay"], "delay(x, 2) - 3": [], None: []}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.e for r in df.select("t", audit.audit(F.col("t")).alias("e")).collect()} == cases
    one = spark.range(1).select(audit.parameters(F.create_map(F.lit("b"), F.lit(0), F.lit("a"), F.lit(-1), F.lit("c"), F.lit(2))).alias("e")).first().e
    assert one == ["not above zero: a", "not above zero: b"]


def test_keys(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "k long, s string, v double")
    assert audit.assert_keys(df, ["k", "s"]) is df
    for bad, keys in ((df, ["k"]), (df.unionByName(df), ["k", "s"]), (df.withColumn("s", F.when(F.col("v") > 1, F.col("s"))), ["k", "s"]), (df, ["k", "gone"])):
        with pytest.raises(ValueError):
            audit.assert_keys(bad, keys)


def test_rows_outside_the_grid(spark):
    universe = spark.createDataFrame([("2024-01-01", 1, True), ("2024-01-01", 2, True), ("2024-01-01", 3, False)], "date string, security_id long, eq_univ boolean").withColumn("date", F.to_date("date"))
    rows = [("2024-01-01", f"2024-01-01 {t}", i, 0.1 * i) for t in ("01:00:00", "02:00:00") for i in (1, 2)]
    schema, days = "date string, datetime string, security_id long, alpha double", universe
    good = submit.sanity(spark.createDataFrame(rows, schema), days, 2, universe, ["01:00:00", "02:00:00"]).first()
    assert good.outside == 0 and good.ready
    more = [*rows, ("2024-01-01", "2024-01-01 01:00:00", 3, 0.1), ("2024-01-01", "2024-01-01 03:00:00", 1, 0.1)]
    bad = submit.sanity(spark.createDataFrame(more, schema), days, 2, universe, ["01:00:00", "02:00:00"]).first()
    assert bad.outside == 2 and not bad.ready


def test_character_grams_of_padded_words(spark):
    df = spark.createDataFrame([("Ab  c",), ("a",), ("",), (None,)], "t string")
    out = [r.g for r in df.select(memory.char_grams(F.col("t")).alias("g")).collect()]
    assert out == [[" ab", "ab ", " ab ", " c "], [" a "], [], []]
