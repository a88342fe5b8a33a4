"""What was tried before: scores of ideas, retrieval by shared words, lessons, tags, outcomes, and changes to such tables.

Changes are relations: a table and a change give the table after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points for a shared word, for a success and for a failure that teaches (fixed values).
SHARED, PASSED, TRIED, TAUGHT = 4.0, 3.0, 1.0, 0.4


def effective_score(quality: Column, used: Column, passed: Column) -> Column:
    """Half the quality and half the success rate; what was never used gets a bonus."""
    rate = F.coalesce(passed, F.lit(0)) / F.greatest(F.coalesce(used, F.lit(0)), F.lit(1))
    return F.coalesce(quality, F.lit(0.0)) * 0.5 + rate * 0.5 + F.when(F.coalesce(used, F.lit(0)) == 0, 0.08).otherwise(0.0)


def tokens(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))


def experience_score(shared: Column, passed: Column, tried: Column, score: Column, age: Column, failed: Column) -> Column:
    """Shared words, success, the score up to ten, recency (age from 1 for the newest) and failures, in points."""
    quality = F.when(passed, PASSED).when(tried, TRIED).otherwise(0.0)
    return shared * SHARED + quality + F.greatest(F.least(F.coalesce(score, F.lit(0.0)), F.lit(10.0)), F.lit(0.0)) * 0.2 + F.greatest(F.lit(0.2), 2.5 / age) + F.when(failed, TAUGHT).otherwise(0.0)


def best_distinct(rows: DataFrame, same: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows by order, of each value of `same` but the first row."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(same).orderBy(*order))).filter("_place = 1").drop("_place").orderBy(*order).limit(k)


def recent_outcomes(rows: DataFrame, kind: str, outcome: str, order: Column, n: int) -> DataFrame:
    """Of the n latest rows that have a kind and an outcome: how many of each."""
    known = rows.filter(F.col(kind).isNotNull() & (F.trim(kind) != "") & F.col(outcome).isNotNull()).orderBy(order).limit(n)
    return known.groupBy(kind, outcome).agg(F.count("*").alias("n"))


def tags(text: Column, words: dict[str, list[str]]) -> Column:
    """The names whose words a text has, in the order given."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda found: F.array_contains(F.array(*(low.contains(w) for w in found)), True)
    return F.array_compact(F.array(*(F.when(has(found), F.lit(name)) for name, found in words.items())))


def with_page(rows: DataFrame, order: list[Column], number: int, size: int, least: int = 1) -> DataFrame:
    """A page, from 1, clamped to those there are, with the count of rows and pages."""
    total = rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.ceil(F.col("total") / size), F.lit(least)))
    n = total.first()  # one row
    return rows.orderBy(*order).offset((max(1, min(number, n.pages)) - 1) * size).limit(size).withColumns({"total": F.lit(n.total).cast("long"), "pages": F.lit(n.pages).cast("long")})


def oldest(rows: DataFrame, waiting: Column, order: list[Column], n: int) -> DataFrame:
    """First in, first out: the n oldest rows that wait."""
    return rows.filter(waiting).orderBy(*order).limit(n)


def changed(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the columns of changes (key, ...) in the rows whose key is there; a null changes nothing."""
    new = [c for c in changes.columns if c != key]
    both = table.alias("t").join(changes.alias("c"), key, "left")
    return both.select(*(F.coalesce(f"c.{c}", f"t.{c}").alias(c) if c in new else F.col(key) if c == key else F.col(f"t.{c}") for c in table.columns))


def synced(table: DataFrame, source: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): what brings table to source: insert, update where the digest differs, delete, or keep."""
    old, new = table.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_had")), source.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_has"))
    action = F.when(F.col("_had").isNull(), "insert").when(F.col("_has").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("keep")
    return old.join(new, key, "full").select(key, action.alias("action"))


def importance(rows: DataFrame, feature: str, value: str, models: str) -> DataFrame:
    """Per feature: the mean over models of its share of a model's total importance, in how many models, numbered."""
    total = F.sum(F.abs(F.col(value))).over(Window.partitionBy(models))
    shares = rows.withColumn("_share", F.when(total > 0, F.abs(F.col(value)) / total).otherwise(0.0))
    out = shares.groupBy(feature).agg(F.round(F.avg("_share"), 9).alias("share"), F.countDistinct(models).alias("models"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("share").desc(), feature)))  # features are few


def onto_stamps(daily: DataFrame, grid: DataFrame, value: str = "alpha") -> DataFrame:
    """A daily value on every stamp of its day: grid(date, datetime, security_id) with value, 0 where missing."""
    return grid.join(daily.select("date", "security_id", value), ["date", "security_id"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that depend on keys and seed only, however the table is cut."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), key).limit(n)


def char_grams(text: Column, least: int = 3, most: int = 5) -> Column:
    """All character n-grams of the words of a lower-cased text, each word with a space before and behind it; a padded word no longer than n counts once, whole."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    cut = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), lambda w: F.concat(*(cut(w, n) for n in range(least, most + 1)))))
