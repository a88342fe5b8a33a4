"""Joins by hash keys: large groups dealt out in blocks, and rows that few keys want."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import written

#: Hash buckets of a broadcast set, at most.
BUCKETS = 1 << 20
#: Rows of a key in a block, rows of which one is looked at to find keys with more, and the most such keys to broadcast.
BLOCK, LOOKED_AT, MOST_HOT = 512, 16, 1 << 16


def only(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """df's rows whose key's bucket is among the wanted keys' buckets: all that can match, and few more if few are wanted."""
    bucket = F.pmod(F.col(key), F.lit(BUCKETS)).cast("int").alias("_b")
    return df.withColumn("_b", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "_b", "left_semi").drop("_b")


def meet(keyed: DataFrame, condition: Column, other: DataFrame | None = None, used: list[DataFrame] | None = None, settle: Callable | None = None) -> DataFrame:
    """(p, q): h1 of rows of keyed(key, h1, ...), as a, and of rows of other, or of itself, as b, of equal key and what the condition says. Keys of many rows,
    of which a look at one row in LOOKED_AT tells, are dealt out: a row in its own block meets each block of the other side; all others meet in one exchange, which
    both sides of a join with itself share. settle(rows of such keys, with their number of blocks) -> (rows, condition) may leave out pairs of these. What was written for this, and can go once
    the result has been, is added to used."""
    b = keyed if other is None else other
    pair = (F.col("a.h1").alias("p"), F.col("b.h1").alias("q"))
    looked = keyed.filter(F.pmod("h1", F.lit(LOOKED_AT)) == 0).groupBy("key").count().filter(F.col("count") * LOOKED_AT > BLOCK)
    hot = written(looked.select("key", F.ceil(F.col("count") * LOOKED_AT / BLOCK).cast("int").alias("blocks")), "hot-keys")
    if used is not None:
        used.append(hot)
    n = hot.count()
    if not n:
        return keyed.alias("a").join(b.alias("b"), (F.col("a.key") == F.col("b.key")) & condition).select(*pair)
    if n <= MOST_HOT:
        hot = F.broadcast(hot)
    cool = [x.join(hot.select("key"), "key", "left_anti") for x in (keyed, b)]
    met = cool[0].alias("a").join(cool[1].alias("b"), (F.col("a.key") == F.col("b.key")) & condition).select(*pair)
    left, right = (x.join(hot, "key") for x in (keyed, b))
    if settle is not None:
        left, condition = settle(left)
        right = left
    left = left.withColumns({"i": own_block(), "j": every_block()})
    right = right.withColumns({"j": own_block(), "i": every_block()})
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "i", "j")])
    return met.union(left.alias("a").join(right.alias("b"), same & condition).select(*pair))


def own_block() -> Column:
    return F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int")


def every_block() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
