"""Parents, guidance and small scores against plain Python, on hand-made tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import ideas as I

SCHEMA = "idea long, formula string, family string, source string, status string, passes boolean, score double, ic double, ir double, tvr double, tokens array<string>, generation long"


def plain_parents(rows: list[dict], k: int, least_ic: float = 0.2) -> list[int]:
    """The same choice, one after another."""
    rows = [r for r in rows if r["status"] in ("ok", "screened_out") and r["formula"]]
    chosen: list[dict] = []

    def add(r) -> bool:
        if r["formula"] not in {c["formula"] for c in chosen}:
            chosen.append(r)
        return len(chosen) >= k

    passing = sorted((r for r in rows if r["passes"] and r["ic"] >= least_ic), key=lambda r: (-r["score"], -r["ic"], r["idea"]))
    if passing:
        for r in passing[: max(1, min(2, k))]:
            if add(r):
                return [c["idea"] for c in chosen]
        families, sources = {c["family"] for c in chosen}, {c["source"] for c in chosen}
        order = sorted(passing, key=lambda r: (r["family"] in families, r["source"] in sources, -r["score"], -r["ic"], r["idea"]))
        seen = set(families)
        for r in order:
            if r["family"] in seen and len(chosen) < max(2, k - 1):
                continue
            if add(r):
                return [c["idea"] for c in chosen]
            seen.add(r["family"])
    else:
        for r in sorted((r for r in rows if r["tvr"] < 400), key=lambda r: (-r["ic"], r["idea"]))[: max(1, k // 2)]:
            if add(r):
                return [c["idea"] for c in chosen]
    for r in sorted((r for r in rows if not r["passes"] and r["ic"] >= least_ic and r["tvr"] < 400), key=lambda r: (-r["ic"], r["tvr"], r["idea"])):
        if add(r):
            break
    return [c["idea"] for c in chosen]


@pytest.mark.parametrize(("k", "share", "formulas"), [(1, 0.5, 30), (2, 0.5, 30), (3, 0.5, 30), (4, 0.5, 30), (4, 0.0, 30), (4, 0.9, 3), (6, 0.5, 5), (5, 0.05, 30), (4, 0.5, 8)])
def test_parents(spark, k, share, formulas):
    for seed in range(3):
        r = random.Random(seed)
        rows = [{"idea": i, "formula": f"f{r.randrange(formulas)}", "source": f"s{r.randrange(3)}", "status": r.choice(["ok", "ok", "screened_out", "invalid"]), "passes": r.random() < share, "score": float(r.randrange(5)), "ic": r.randrange(5) / 5, "ir": 1.0, "tvr": float(r.randrange(600)), "tokens": [], "generation": 0} for i in range(40)]
        for x in rows:
            x["family"] = f"g{hash(x['formula'][1:]) % 4 if formulas > 5 else x['formula']}"
        df = spark.createDataFrame([tuple(x[c.split()[0]] for c in SCHEMA.split(", ")) for x in rows], SCHEMA)
        out = I.parents(df, k).orderBy("place").collect()
        assert [x.idea for x in out] == plain_parents(rows, k)


def test_nothing_tried(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert I.parents(empty).count() == 0 and I.experience(empty).count() == 0
    row = I.guidance(empty).first()
    assert row.n_recent == 0 and row.alert == "" and row.dominant_failure == "" and row.crowded_tokens == [] and row.strong_examples == []


def test_guidance(spark):
    rows = [(i, f"f{i}", "bad" if i % 2 else "good", "s", "ok", i % 2 == 0 and i < 8, float(i), 0.7, 3.0, 350.0 if i > 8 else 10.0, ["a", "b"] if i % 2 else ["c", "b"], 0) for i in range(12)] + [(20 + i, "f1", "good", "s", "duplicate", False, 0.0, 0.0, 0.0, 0.0, [], 1) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    row = I.guidance(df, recent=10, crowded=3).first()
    # the latest ten: 20, 21, 22 and 11 down to 5; 6 passes
    assert row.n_recent == 10 and row.crowded_tokens == ["b", "a"] and row.weak_examples == [5, 7, 8, 9] and row.strong_examples == [6, 4, 2, 0]
    assert row.productive_pairs == ["b + c (4/6)"] and row.exhausted_families == ["bad"] and row.dominant_failure == "failed_gate"
    assert row.alert.startswith("3/6 of the latest that don't pass turn over too much (mean 350)") and row.alert.endswith("3/10 of the latest repeat earlier ones")


def test_failure_reasons(spark):
    cases = [(True, "invalid", 1.0, 9.0, 9.0, 0.0, "passed"), (False, "invalid", 1.0, 9.0, 9.0, 0.0, "invalid_formula"), (False, "ok", 1.0, 9.0, 9.0, 330.0, "high_tvr"), (False, "ok", 1.0, 9.0, 2.5, 0.0, "low_ir"), (False, "ok", 1.0, 0.6, 3.0, 0.0, "low_ic"), (False, "ok", 0.0, 0.7, 3.0, 0.0, "zero_score"), (False, None, 1.0, 0.7, 3.0, None, "failed_gate"), (None, "duplicate", None, None, None, None, "duplicate_formula")]
    df = spark.createDataFrame(cases, "passes boolean, status string, score double, ic double, ir double, tvr double, expected string")
    assert all(r.r == r.expected for r in df.withColumn("r", I.failure_reason()).collect())


def test_small_scores(spark):
    df = spark.createDataFrame([("alpha beta gamma of returns in stock",), ("nothing",), (None,)], "t string")
    out = df.select(I.relevance(F.col("t"), ["alpha", "beta", "gamma", "returns", "stock", "delta"], ["junk"], ["return"], ["stock"]).alias("r")).select("r.*").collect()
    assert [(round(r.score, 6), r.keep, r.hits) for r in out] == [(0.6, False, 5), (0.25, False, 0), (0.25, False, 0)]
    o = spark.createDataFrame([("a", "passing"), ("a", "screened_out"), ("b", "compute_error"), ("c", None)], "kind string, outcome string")
    assert {r.kind: round(r.weight, 6) for r in I.archetype_weights(o, "kind").collect()} == {"a": round(0.825 * 1.12, 6), "b": 0.2, "c": 1.0}
    words = spark.range(1).select(I.expanded(F.lit("A High TVR, it"), {"high_tvr": ["smooth", "tvr"], "low_ir": ["x"]}).alias("w")).first().w
    assert words == ["high", "smooth", "tvr"]
