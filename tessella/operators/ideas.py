"""What to try next: parents, guidance and experience from a table of tried ideas.

ideas(idea, formula, family, source, status, passes, score, ic, ir, tvr, ...): formula is the canonical text, family its structural fingerprint, and a larger idea is a
later one. Lists that come out are short by what they are for (a few parents, examples, tokens); all else is aggregated in the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turnover from which an idea counts as turning over too much, and gates of ir and ic (fixed values).
HIGH_TVR, LEAST_IR, LEAST_IC, MOST_TVR = 330.0, 2.5, 0.6, 400.0
#: Attempts before a pair or family is judged, wins among them that make a pair productive, and the share of high turnover that raises an alert (fixed values).
ATTEMPTS, PRODUCTIVE, ALERT = 3, 0.4, 0.4


def failure_reason() -> Column:
    """Why an idea failed: the first reason that holds."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    by_status = {"invalid": "invalid_formula", "compute_error": "compute_error", "duplicate": "duplicate_formula", "screened_out": "screened_out"}
    out = F.when(F.coalesce("passes", F.lit(False)), "passed")
    for status, reason in by_status.items():
        out = out.when(F.col("status") == status, reason)
    return out.when(c("tvr") >= HIGH_TVR, "high_tvr").when(c("ir") <= LEAST_IR, "low_ir").when(c("ic") <= LEAST_IC, "low_ic").when(c("score") <= 0, "zero_score").otherwise("failed_gate")


_ROW = ("idea", "formula", "family", "source")


def _first(rows: DataFrame, order: list[Column], n: int, each: str | None = None) -> list:
    """The first n rows by order, of each value of `each` but the first. Each value's rows meet as partial minima."""
    keyed = rows.select(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))).alias("_k"), *_ROW)
    if each:
        keyed = keyed.groupBy(F.col(each).alias("_each")).agg(F.min(F.struct("_k", *_ROW)).alias("r")).select("r.*")
    return keyed.orderBy("_k").limit(n).collect()


def parents(ideas: DataFrame, k: int = 4, least_ic: float = 0.2, most_tvr: float = MOST_TVR) -> DataFrame:
    """(place, idea, kind): k ideas to build on, no two of one formula. anchor: the two best that pass; diverse: passing ones of families not yet chosen, first those of new
    sources, until one place is left, which the next by that order takes whatever its family; exploratory: ones that fail but have ic and keep turnover low.
    Without a passing idea the best half are of low turnover, whatever their status. Each step is a sort of the cluster's with a small limit."""
    ideas = ideas.filter(F.col("status").isin("ok", "screened_out") & F.col("formula").isNotNull() & (F.col("formula") != ""))
    passing = ideas.filter(F.col("passes") & (F.col("ic") >= least_ic))
    best = [-F.coalesce("score", F.lit(0.0)), -F.coalesce("ic", F.lit(0.0)), F.col("idea")]
    chosen: list[tuple] = []

    def take(rows: list, kind: str) -> None:
        for r in rows:
            if len(chosen) < k and r.formula not in {c[1] for c in chosen}:
                chosen.append((r.idea, r.formula, r.family, r.source, kind))

    anchors = _first(passing, best, max(1, min(2, k)))
    take(anchors, "anchor")
    if anchors:
        families, sources = [c[2] for c in chosen], [c[3] for c in chosen]
        order = [F.coalesce(F.col("family").isin(families), F.lit(False)), F.coalesce(F.col("source").isin(sources), F.lit(False)), *best]
        until = max(2, k - 1)
        last = None
        if len(chosen) < min(k, until):
            fresh = _first(passing.filter(~F.coalesce(F.col("family").isin(families), F.lit(False))), order, until - len(chosen), "family")
            take(fresh, "diverse")
            last = fresh[-1]["_k"] if fresh else None
        if until <= len(chosen) < k:
            rest = passing.filter(~F.col("formula").isin([c[1] for c in chosen]))
            if last is not None:  # what came before was passed over
                kinds = [f.dataType for f in rest.select(*order).schema.fields]
                rest = rest.filter(F.struct(*order) > F.struct(*(F.lit(v).cast(kind) for v, kind in zip(last, kinds, strict=True))))
            take(_first(rest, order, k - len(chosen), "formula"), "diverse")
    else:
        take(_first(ideas.filter(F.coalesce("tvr", F.lit(0.0)) < most_tvr), [-F.coalesce("ic", F.lit(0.0)), F.col("idea")], max(1, k // 2)), "low turnover")
    if len(chosen) < k:
        tries = ideas.filter(~F.coalesce("passes", F.lit(False)) & (F.coalesce("ic", F.lit(0.0)) >= least_ic) & (F.coalesce("tvr", F.lit(0.0)) < most_tvr) & ~F.col("formula").isin([c[1] for c in chosen]))
        take(_first(tries, [-F.coalesce("ic", F.lit(0.0)), F.coalesce("tvr", F.lit(0.0)), F.col("idea")], k - len(chosen), "formula"), "exploratory")
    return ideas.sparkSession.createDataFrame([(i + 1, c[0], c[4]) for i, c in enumerate(chosen)], "place int, idea long, kind string")


def _few(rows: DataFrame, order: list[Column], n: int, value: str, name: str) -> DataFrame:
    """One row: the values of the first n rows by order, as an array."""
    few = rows.orderBy(*order).limit(n).withColumn("_p", F.row_number().over(Window.orderBy(*order)))
    return few.agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", value))), lambda x: x[value]).alias(name))


def guidance(ideas: DataFrame, recent: int = 20, crowded: int = 5) -> DataFrame:
    """One row of advice. ideas has tokens (distinct words of its formula) too. crowded_tokens: in `crowded` or more of the latest `recent` ideas that failed; weak_examples
    and strong_examples: ids of the four worst of those and the four best that pass; productive_pairs: up to five pairs of tokens that win often; exhausted_families: up
    to six families that never won; dominant_failure: the most common reason of the latest that don't pass; alert: says so if many of those turn over too much."""
    known = ideas.filter(F.col("formula").isNotNull() & (F.col("formula") != "")).withColumn("reason", failure_reason())
    last = known.orderBy(F.desc("idea")).limit(recent)
    failed = last.filter((F.col("status") == "ok") & ~F.col("passes"))
    unlucky = last.filter(F.col("status").isin("ok", "screened_out") & ~F.col("passes"))
    counted = failed.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") >= crowded)
    sort = F.array_sort(F.col("tokens"))
    both = F.flatten(F.transform(sort, lambda a, i: F.transform(F.slice(sort, i + 2, F.size(sort)), lambda b: F.concat_ws(" + ", a, b))))
    pairs = known.select(F.explode(both).alias("pair"), "passes").groupBy("pair").agg(F.count("*").alias("n"), F.count(F.when(F.col("passes"), 1)).alias("w"))
    good = pairs.filter((F.col("n") >= ATTEMPTS) & (F.col("w") / F.col("n") >= PRODUCTIVE)).withColumn("text", F.concat(F.col("pair"), F.lit(" ("), F.col("w"), F.lit("/"), F.col("n"), F.lit(")")))
    families = known.groupBy("family").agg(F.count("*").alias("n"), F.count(F.when(F.col("passes"), 1)).alias("w")).filter((F.col("n") >= ATTEMPTS) & (F.col("w") == 0))
    reasons = unlucky.groupBy("reason").agg(F.count("*").alias("n"))
    high = F.when(F.coalesce("tvr", F.lit(0.0)) >= HIGH_TVR, F.coalesce("tvr", F.lit(0.0)))
    tvr = unlucky.agg(F.count("*").alias("u"), F.count(high).alias("h"), F.avg(high).alias("m"))
    repeats = last.agg(F.count(F.when(F.col("status") == "duplicate", 1)).alias("d"), F.count("*").alias("n_recent"))
    said = F.concat(F.col("h"), F.lit("/"), F.col("u"), F.lit(" of the latest that don't pass turn over too much (mean "), F.round("m").cast("long"), F.lit("): lengthen the outer smoother"))
    more = F.when(F.col("d") >= 3, F.concat(F.lit("; "), F.col("d"), F.lit("/"), F.col("n_recent"), F.lit(" of the latest repeat earlier ones"))).otherwise("")
    alert = tvr.join(F.broadcast(repeats)).select("n_recent", F.when((F.col("u") > 0) & (F.col("h") / F.col("u") >= ALERT), F.concat(said, more)).otherwise("").alias("alert"))
    out = alert
    for part in (  # single rows
        _few(counted, [F.desc("n"), F.col("t")], 1000, "t", "crowded_tokens"), _few(failed, [F.col("score"), F.col("ic"), F.col("idea")], 4, "idea", "weak_examples"),
        _few(known.filter("passes"), [F.desc("score"), F.desc("ic"), F.col("idea")], 4, "idea", "strong_examples"), _few(good, [F.desc(F.col("w") / F.col("n")), F.desc("n"), F.col("pair")], 5, "text", "productive_pairs"),
        _few(families, [F.desc("n"), F.col("family")], 6, "family", "exhausted_families"), _few(reasons, [F.desc("n"), F.col("reason")], 1, "reason", "_reasons"),
    ):
        out = out.join(F.broadcast(part))
    return out.withColumn("dominant_failure", F.coalesce(F.get("_reasons", F.lit(0)), F.lit(""))).drop("_reasons")


def experience(ideas: DataFrame, generation: str = "generation", top: int = 6, weak: int = 8) -> DataFrame:
    """Per generation: total, passing, best_score, failures ("reason=n", by reason), and the ids of its best and weakest ideas. Of a generation only that many rows meet."""
    known = ideas.withColumn("reason", failure_reason())
    by = Window.partitionBy(generation)
    counts = known.groupBy(generation, "reason").agg(F.count("*").alias("n"), F.count(F.when(F.col("passes"), 1)).alias("p"), F.max(F.coalesce("score", F.lit(0.0))).alias("b"))
    rows = counts.groupBy(generation).agg(F.sum("n").alias("total"), F.sum("p").alias("passing"), F.max("b").alias("best_score"), F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat(x["reason"], F.lit("="), x["n"])).alias("failures"))
    for name, order, n in (("top_examples", [F.desc("score"), F.desc("ic"), F.col("idea")], top), ("weak_examples", [F.col("passes"), F.col("score"), F.col("ic"), F.col("idea")], weak)):
        few = known.select(generation, "idea", "passes", "score", "ic").withColumn("_p", F.row_number().over(by.orderBy(*order))).filter(F.col("_p") <= n)
        rows = rows.join(few.groupBy(generation).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "idea"))), lambda x: x["idea"]).alias(name)), generation)
    return rows


def relevance(text: Column, wanted: list[str], unwanted: list[str], outcome: list[str], market: list[str]) -> Column:
    """struct(score, keep, hits): a text's points for wanted words and against unwanted ones, from 0 to 1, and whether it is worth reading: three wanted words, 0.62 points, and a
    word of outcome and one of market."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    hits, points = count(wanted), F.least(F.lit(0.98), F.lit(0.25) + 0.07 * count(wanted) - 0.12 * count(unwanted))
    keep = (count(outcome) > 0) & (count(market) > 0) & (hits >= 3) & (F.round(points, 9) >= 0.62)
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points)).alias("score"), keep.alias("keep"), hits.alias("hits"))


def archetype_weights(outcomes: DataFrame, kind: str, outcome: str = "outcome") -> DataFrame:
    """(kind, tried, weight): how often to draw a kind of idea, by its past outcomes: errors and screenings lower it, passes raise it; from 0.15 to 1.5."""
    n = lambda *names: F.count(F.when(F.col(outcome).isin(*names), 1))
    sums = outcomes.groupBy(kind).agg(F.count(outcome).alias("tried"), n("syntax_error", "compute_error").alias("_e"), n("screened_out").alias("_s"), n("passing").alias("_p"))
    share = lambda c: F.col(c) / F.when(F.col("tried") > 0, F.col("tried"))
    weight = F.greatest(F.lit(0.2), 1.0 - 0.8 * share("_e")) * F.greatest(F.lit(0.4), 1.0 - 0.35 * share("_s")) * (1.0 + F.least(F.lit(0.35), 0.12 * F.col("_p")))
    return sums.select(kind, "tried", F.when(F.col("tried") > 0, F.greatest(F.lit(0.15), F.least(weight, F.lit(1.5)))).otherwise(1.0).alias("weight"))


def expanded(text: Column, aliases: dict[str, list[str]]) -> Column:
    """The distinct words of three characters or more, with those that stand for the names a text has (with _ or a space), in order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    own = F.filter(F.split(low, "[^a-z0-9_]+"), lambda w: F.length(w) >= 3)
    more = [F.when(F.contains(low, F.lit(k)) | F.contains(low, F.lit(k.replace("_", " "))), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in aliases.items()]
    return F.array_sort(F.array_distinct(F.concat(own, *more)))


def relevant_experience(records: DataFrame, asked: Column, generation: str = "generation", text: str = "text", recent: int = 2) -> DataFrame:
    """The older record (all but the latest `recent` generations) that has most of the asked words, of equals the latest; no row if none has one."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    latest = [r[0] for r in records.select(generation).distinct().orderBy(F.desc(generation)).limit(recent).collect()]
    older = records.filter(~F.col(generation).isin(latest)) if latest else records
    scored = older.withColumn("hits", F.size(F.filter(asked, lambda w: F.contains(low, w))))
    return scored.filter("hits > 0").orderBy(F.desc("hits"), F.desc(generation)).limit(1)


def gate_notes(gates: dict[str, Column]) -> Column:
    """An array of "label: pass" or "label: fail", one for each gate that is known."""
    return F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), F.when(c, "pass").otherwise("fail"))) for label, c in gates.items())))
