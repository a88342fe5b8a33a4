"""Product quantisation: vectors are cut in parts, and each part is named by the nearest entry of its position's codebook.

Each round broadcasts a kd-tree for each codebook (parts x entries x part length numbers, whatever the table's size); tasks find the nearest
entries by branch and bound and return sums and counts of each entry, which the cluster adds up as integers. The vectors are read anew for
each round and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of a component: integers are floor(UNITS * x), held within +-MOST so that the distance of 2048 components fits a long.
UNITS = 256
MOST = (1 << 25) - 1
#: Entries in a leaf of a tree.
LEAF = 4
#: Labels, the most frequent ones, whose sums are broadcast; each other label has less than one part in so many of all rows.
MOST_LABELS = 1 << 16


class KdTree:
    """Points by halves of their widest axis, each node with the box about its points."""

    def __init__(self, points: np.ndarray):
        self.points = np.asarray(points, np.int64)
        self.root = self._node(np.arange(len(self.points)))

    def _node(self, own: np.ndarray) -> tuple:
        low, high = self.points[own].min(0), self.points[own].max(0)
        if len(own) <= LEAF or (low == high).all():
            return low, high, np.sort(own), None, None
        axis = int(np.argmax(high - low))
        order = own[np.argsort(self.points[own, axis], kind="stable")]
        half = len(order) // 2
        return low, high, None, self._node(order[:half]), self._node(order[half:])

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest point for each query; of equally near points the lowest index."""
        best, at = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(self.points))
        self._visit(self.root, queries, np.arange(len(queries)), best, at)
        return at, best

    def _visit(self, node: tuple, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Looks for what is nearer below a node, for all rows that got there. The child whose box is nearer comes first; the other one
        only for rows whose bound doesn't exceed the best distance: an equal bound may hide an equally near point of lower index."""
        if not len(rows):
            return
        _, _, own, left, right = node
        if own is not None:
            q = queries[rows]
            for i in own:
                d = ((q - self.points[i]) ** 2).sum(1)
                nearer = (d < best[rows]) | ((d == best[rows]) & (i < at[rows]))
                best[rows[nearer]], at[rows[nearer]] = d[nearer], i
            return
        to_left, to_right = _bound(left, queries[rows]), _bound(right, queries[rows])
        first = to_left <= to_right
        self._visit(left, queries, rows[first], best, at)
        self._visit(right, queries, rows[~first], best, at)
        self._visit(left, queries, rows[~first & (to_left <= best[rows])], best, at)
        self._visit(right, queries, rows[first & (to_right <= best[rows])], best, at)


def _bound(node: tuple, q: np.ndarray) -> np.ndarray:
    """Squared distance to the node's box: no point below is nearer."""
    outside = np.maximum(np.maximum(node[0] - q, q - node[1]), 0)
    return (outside**2).sum(1)


def integers(column: pa.Array, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their integer components as rows x parts x part length): vectors of the width without a null or non-finite component."""
    kept = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    x = column.filter(kept).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # a null becomes NaN
    right = np.isfinite(x).all(1)
    rows = np.flatnonzero(kept.to_numpy(zero_copy_only=False))[right]
    whole = np.clip(np.floor(x[right] * UNITS), -MOST, MOST).astype(np.int64)
    length = -(-width // parts)
    return rows, np.pad(whole, ((0, 0), (0, length * parts - width))).reshape(len(whole), parts, length)


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


class Codebooks:
    """entries: parts x entries x part length integers; width: components of a vector."""

    def __init__(self, entries: np.ndarray, width: int):
        self.entries, self.width = entries, width

    @property
    def parts(self) -> int:
        return len(self.entries)

    def trees(self) -> list[KdTree]:
        return [KdTree(x) for x in self.entries]

    def sha256(self) -> str:
        """Of all components as decimal numbers, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _assigned(batch: pa.RecordBatch, vector_col: str, width: int, trees: list[KdTree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept rows, their parts, nearest entry by part, squared distance by part)."""
    rows, x = integers(batch.column(vector_col), width, len(trees))
    found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
    return rows, x, np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def _updated(vectors: DataFrame, vector_col: str, books: Codebooks) -> Codebooks:
    """A round: parts go to the nearest entries, and entries become the floors of their parts' means; unused ones stay."""
    shared, width = vectors.sparkSession.sparkContext.broadcast(books.trees()), books.width
    parts, k, length = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * k, length + 1), np.int64)  # the last: how many
        for batch in batches:
            _, x, at, _ = _assigned(batch, vector_col, width, shared.value)
            cells = (at + k * np.arange(parts)).ravel()
            np.add.at(total, cells, np.concatenate((x.reshape(-1, length), np.ones((len(cells), 1), np.int64)), 1))
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_pydict({"cell": np.repeat(used, length + 1), "place": np.tile(np.arange(length + 1), len(used)), "total": total[used].ravel()})

    found = vectors.select(vector_col).mapInArrow(sums, "cell long, place long, total long").groupBy("cell", "place").agg(F.sum("total").alias("total"))
    total = np.zeros((parts * k, length + 1), np.int64)
    for r in found.collect():  # as many numbers as the codebooks have
        total[r.cell, r.place] = r.total
    n = total[:, -1:]
    entries = np.where(n > 0, total[:, :-1] // np.maximum(n, 1), books.entries.reshape(parts * k, length))
    return Codebooks(entries.reshape(parts, k, length), width)


def fit(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks that start as the parts of the vectors of smallest id (nulls last, equal ids by vector) and are moved `rounds` times to the
    floors of their parts' means. All vectors take part, but for those that are null, have a null or non-finite component, or are
    shorter than the longest, as they lack components. A width that parts doesn't divide is filled up with zeros. None without a vector."""
    good = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    width = good.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if not width:
        return None
    first = good.filter(F.size("v") == width).orderBy(F.asc_nulls_last("i"), "v").limit(entries).collect()
    start = pa.array([r.v for r in first], pa.list_(pa.float64()))
    books = Codebooks(integers(start, width, parts)[1].transpose(1, 0, 2).copy(), width)
    for _ in range(rounds):
        books = _updated(vectors, vector_col, books)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, vector_col: str = "embedding") -> DataFrame:
    """The vectors that fit() counts, with code (an entry's index for each part, two hex digits each) and error (the squared distances summed over the
    parts). Columns of these names are replaced, all others stay; repeated rows stay."""
    new = [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    own = [c for c in vectors.columns if c not in ("code", "error") or c == vector_col]
    vectors = vectors.select(*(F.col(f"`{c}`") for c in own))
    schema = T.StructType([f for f in vectors.schema.fields if f.name not in ("code", "error")] + new)
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared, width = vectors.sparkSession.sparkContext.broadcast(books.trees()), books.width

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexadecimal = np.array([f"{i:02x}" for i in range(len(shared.value[0].points))])
        for batch in batches:
            rows, _, at, far = _assigned(batch, vector_col, width, shared.value)
            kept = batch.take(pa.array(rows, pa.int64()))
            code = pa.array(["".join(x) for x in hexadecimal[at].tolist()], pa.string())
            columns = [kept.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, code, pa.array(far.sum(1), pa.int64())], names=schema.names)

    return vectors.mapInArrow(codes, schema)


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error, error summed over equal labels, nulls together. coded is read twice, so it should be a written table.

    Sums are made before anything is shuffled by label. The MOST_LABELS most frequent labels' sums are broadcast; where there are more labels,
    the others are joined by a shuffle, in which no key has more than one in MOST_LABELS of all rows."""
    label = F.col(f"`{label_col}`")
    totals = coded.groupBy(label.alias("_l")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    hot = totals.orderBy(F.desc("_n"), "_l").limit(MOST_LABELS).select("_l", "label_error")
    joined = coded.join(F.broadcast(hot), label.eqNullSafe(F.col("_l")), "left").drop("_l")
    if totals.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        return joined
    rest = totals.select("_l", F.col("label_error").alias("_r")).join(F.broadcast(hot.select(F.col("_l").alias("_h"))), F.col("_l").eqNullSafe(F.col("_h")), "left_anti")
    cold = joined.filter("label_error is null").drop("label_error").join(rest, label.eqNullSafe(F.col("_l"))).drop("_l").withColumnRenamed("_r", "label_error")
    return joined.filter("label_error is not null").unionByName(cold)
