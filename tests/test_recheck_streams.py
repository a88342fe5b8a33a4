"""Stored submissions read and checked at once, correlations of a stream of signals, tolerant parsing, fusion's corner cases."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import fusion, metrics, submit
from tessella.streaming import correlations as Q


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(i, d * 3 + h, f"2024-01-0{d + 1} 0{h + 1}:00:00", ((i * 7 + h * 3 + d) % 11 - 5) / 10, 0) for d in range(5) for h in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "security_id long, bar_idx long, datetime string, resp double, trading_restriction int")
    return df.withColumn("datetime", F.col("datetime").cast("timestamp_ntz")).withColumn("date", F.to_date("datetime"))


def test_stored_submissions(spark, panel, tmp_path):
    good = panel.withColumn("alpha", F.col("resp") * 0.5 + (F.col("security_id") % 3) / 50)
    for run, alpha in (("run_a", F.col("alpha")), ("run_b", -F.col("alpha"))):
        rows = good.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "security_id", alpha.cast("float").alias("alpha"))
        rows.write.parquet(str(tmp_path / "submit" / run))
    exports = submit.read_exports(spark, str(tmp_path / "submit"))
    assert {r.run_id: r["count"] for r in exports.groupBy("run_id").count().collect()} == {"run_a": 450, "run_b": 450}
    found = {r.run_id: r for r in submit.recheck(exports, panel).collect()}
    alone = metrics.evaluate(good.withColumn("alpha", F.col("alpha").cast("float").cast("double"))).first()
    assert tuple(found["run_a"])[1:] == pytest.approx(tuple(alone)) and found["run_b"].ic == pytest.approx(-found["run_a"].ic)
    library = spark.createDataFrame([("run_b", "x", True, 3.0), ("lost", "y", True, 4.0)], "run_id string, note string, passes boolean, score double")
    after = {r.run_id: r for r in submit.updated(library, submit.recheck(exports, panel)).collect()}
    assert {k: (r.note, r.status) for k, r in after.items()} == {"run_a": (None, "ok"), "run_b": ("x", "ok"), "lost": ("y", "recompute_error")}
    assert not after["lost"].passes and after["lost"].score == 0.0 and after["run_b"].score == found["run_b"].score


def test_correlations_of_a_stream(spark, tmp_path):
    r = np.random.default_rng(3)
    base = r.normal(size=(20, 15))
    signals = {n: base * c + r.normal(size=base.shape) for n, c in (("a", 1.0), ("b", 0.5), ("c", -2.0), ("d", 0.0))}
    rows = {n: [(n, f"2024-01-{d + 1:02d}", i, float(x[d, i])) for d in range(20) for i in range(15) if (d + i) % 17] for n, x in signals.items()}
    schema = "signal string, date date, security_id long, alpha double"
    for k, names in enumerate((("a", "b"), ("c",), ("d",))):
        df = spark.createDataFrame([x for n in names for x in rows[n]], "signal string, date string, security_id long, alpha double").withColumn("date", F.to_date("date"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stored = str(tmp_path / "store")
    write = Q.correlate_batches(stored)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    write(spark.createDataFrame(rows["d"], "signal string, date string, security_id long, alpha double").withColumn("date", F.to_date("date")), 2)  # once more

    def read():
        return {(x.a, x.b): x for x in Q.latest_pairs(spark.read.parquet(f"{stored}/pairs")).collect()}

    z = {}
    for n, x in signals.items():
        m = np.where([[(d + i) % 17 != 0 for i in range(15)] for d in range(20)], x, np.nan)
        z[n] = ((m - np.nanmean(m, 1, keepdims=True)) / np.nanstd(m, 1, ddof=1, keepdims=True)).ravel()
    found = read()
    assert set(found) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    for (a, b), x in found.items():
        both = ~np.isnan(z[a]) & ~np.isnan(z[b])
        assert x.n == both.sum() and x["corr"] == pytest.approx(np.corrcoef(z[a][both], z[b][both])[0, 1])
    assert spark.read.parquet(f"{stored}/pairs/batch=1").count() == 2  # the third signal met the first two only
    few = spark.createDataFrame([("e", f"2024-01-{d + 1:02d}", i, float(d * i)) for d in range(3) for i in range(5)], "signal string, date string, security_id long, alpha double").withColumn("date", F.to_date("date"))
    write(few, 3)
    assert all(read()[(n, "e")]["corr"] is None for n in "abcd")


def test_tolerant_json(spark):
    cases = {
        '{"a": 1}': ("json", {"a": 1}), "{'a': (1, 2), 'b': None, 'c': True}": ("literal", {"a": [1, 2], "b": None, "c": True}), " [1, 'x'] ": ("literal", [1, "x"]), "{'a': open('x')}": ("corrupt", None), "nothing": ("corrupt", None), "": ("empty", None), "  ": ("empty", None), None: ("empty", None),
        "{'a': " * 300 + "1": ("corrupt", None), "7": ("json", 7), "null": ("json", None), '{"s": "it\'s"}': ("json", {"s": "it's"}),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.tolerant_json(F.col("t")).alias("r")).select("t", "r.*").collect()
    assert len(rows) == len(cases)
    for r in rows:
        how, value = cases[r.t]
        assert r.how == how and (r.json is None if how in ("corrupt", "empty") else json.loads(r.json) == value), r
        assert r.corrupt == (r.t if how == "corrupt" else None)


def test_fusion_without_scores():
    only = fusion.candidates({"a": 0.0, "b": -3.0}, np.eye(2))
    assert only[0]["weights"] == {"a": 0.5, "b": 0.5} and only[0]["chosen"] and len(only) == 1
    assert fusion.candidates({}, np.eye(0))[0]["weights"] == {}


def test_fusion_prefers_what_differs():
    corr = np.array([[1, 0.99, 0.0], [0.99, 1, 0.0], [0.0, 0.0, 1]])
    ways = {c["name"]: c for c in fusion.candidates({"a": 100.0, "b": 99.0, "c": 60.0}, corr, {"c"}, most=2)}
    assert set(ways["greedy_diversity"]["weights"]) == {"a", "c"}
    assert ways["anchored_stack"]["weights"]["c"] == pytest.approx(60 * 1.35 / (199 + 60 * 1.35))
    assert sum(c["chosen"] for c in ways.values()) == 1 and all(sum(c["weights"].values()) == pytest.approx(1) for c in ways.values())
    assert max(ways.values(), key=lambda c: c["objective"])["chosen"]
