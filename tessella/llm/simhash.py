"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints at 3 or fewer differing bits have a half of 32 bits at 1 or fewer. Each half becomes 16 bit counts, of its 2-bit
segments; the Manhattan distance of the counts never exceeds the differing bits. So every link is a pair within distance 1 in
one half's grid of unit cells: each fingerprint stands in its own cell, and visits the cells one count above. A pair that meets
in a cell is verified on all 64 bits within the join. Equal fingerprints are one grid point, so copies cost nothing; a cell with
many fingerprints is dealt out as pairs of blocks, each of which returns a spanning forest instead of all pairs.

near_copies() is for a similarity of 0.8 on five words, where fingerprints alone decide too little: what they find is verified on the
shingles, and samples of shingles find the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.keys import meet, only
from tessella.llm.scratch import discard, written

#: Fingerprints of a cell beyond which it is dealt out in blocks of about this size, and times as many beyond which its visitors are, too.
BLOCK, VISITED = 256, 16
SEED = 42
#: Shingles of a sample, samples of a text, and bits in which the SimHashes of texts of similarity 0.8 differ at most (10 +- 3).
SAMPLE, GROUPS, FAR = 5, 32, 22
#: Copies of a fingerprint beyond which its rows are dealt out, over so many parts.
COPIES, PARTS = 200, 64


def fingerprint_of(text: str, width: int = 3) -> int:
    """Signed 64 bits: bit b is set if set in over half the XXH64 hashes of the text's word shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space parts words
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint_of(t, width) for t in batch.fillna("")], dtype="int64")

    return of(text)


def _cells(points: DataFrame) -> DataFrame:
    """(cell, home, fp): the cell of each half, and those one count above it."""
    found = []
    for half in (0, 1):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        counts = bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555))
        tag = F.lit(half << 32)
        found.append(F.struct((counts + tag).alias("cell"), F.lit(True).alias("home")))
        for k in range(16):
            free = F.shiftrightunsigned(counts, 2 * k).bitwiseAND(F.lit(3)) < 2
            found.append(F.when(free, F.struct((counts + F.lit(1 << 2 * k) + tag).alias("cell"), F.lit(False).alias("home"))))
    return points.select("fp", F.explode(F.array_compact(F.array(*found))).alias("c")).select("c.cell", "c.home", "fp")


def _forest(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """A spanning forest of the links between the homes of block i and the members of block j."""
    a = pdf.loc[pdf["left"], "fp"].to_numpy(np.int64)
    b = pdf.loc[~pdf["left"], "fp"].to_numpy(np.int64)
    near = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= most
    root = {int(x): int(x) for x in np.concatenate([a, b])}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = find(int(a[i])), find(int(b[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(a[i]), int(b[j])))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def links(points: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """points(fp), distinct -> (u, v): pairs of fingerprints at `most` (3 at the most) or fewer bits that connect whatever all such
    pairs connect. Spark sizes cells as the points that they are exploded from, a thirtieth of what they are, and would broadcast them: so they are merged, and
    of cells and hot ones the hot are broadcast, at most a sixtieth of the points."""
    if most > 3:
        raise ValueError("the two halves' grids find pairs of up to 3 differing bits")
    cells = _cells(points)
    homes = F.count(F.when(F.col("home"), 1))
    hot = cells.groupBy("cell").agg(homes.alias("homes"), F.count("*").alias("members")).filter((F.col("homes") > block) | (F.col("homes") > 0) & (F.col("members") > VISITED * block))
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most
    pair = (F.col("a.cell") == F.col("b.cell")) & near & (~F.col("b.home") | (F.col("a.fp") < F.col("b.fp")))
    cool = cells.join(hot, "cell", "left_anti")
    plain = cool.filter("home").alias("a").join(cool.alias("b").hint("merge"), pair).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    # Homes are dealt out in rows of blocks, members in columns: a block of the product has about `block` of each.
    rows, columns = (F.ceil(F.col(c) / block).cast("int") for c in ("homes", "members"))
    dealt = cells.join(F.broadcast(hot), "cell")
    own = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    lefts = dealt.filter("home").select("cell", "fp", F.lit(True).alias("left"), own(rows).alias("i"), every(columns).alias("j"))
    rights = dealt.select("cell", "fp", F.lit(False).alias("left"), every(rows).alias("i"), own(columns).alias("j"))
    forest = lefts.unionByName(rights).groupBy("cell", "i", "j").applyInPandas(lambda pdf: _forest(pdf, most), "u long, v long")
    return plain.unionByName(forest)


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3, most: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed 64 bits), component_id (the smallest doc_id that links reach).

    A null or blank text has fingerprint 0 and links like any other. Repeated rows share their component. A null id is passed over
    by the minimum; a component of null ids only has a null id. An empty table gives no rows."""
    prints = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col).cast("string"), width).alias("fp")), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    member = components(links(points.select("fp"), most))
    rooted = points.join(member.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    ids = rooted.join(least, "root").select("fp", "least")
    named = points.join(ids, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return salted(prints, named, "fp").select("doc_id", "fp", "component_id")


def _shingles(text: str, width: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, sorted; none for a text without words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def _majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The SimHash of each run of hashes that begins at starts."""
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts[1:], len(hashes))
    for k in range(0, len(starts), 1 << 10):  # runs at a time, so that bits of few hashes are spread out at once
        lo, hi = starts[k], ends[min(k + (1 << 10), len(starts)) - 1]
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, starts[k : k + (1 << 10)] - lo, axis=0, dtype=np.int64)
        sizes = (ends - starts)[k : k + (1 << 10), None]
        out[k : k + (1 << 10)] = np.packbits(votes * 2 > sizes, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def sketch_of(text: str, width: int = 5, similarity: float = 0.8) -> tuple[int, int, int, list[int]]:
    """Of a text: a digest of its set of shingles, their number, their SimHash (signed), and keys: SimHashes of samples of them.

    The hashes' residues deal shingles out in classes of about SAMPLE, of which the first GROUPS are samples. Two texts of
    similarity 0.8 have a sample in common but for one pair in a thousand or less; up to GROUPS * SAMPLE shingles all of them are in
    samples. The number of classes doubles with the length; a text near the next length class also has that one's samples."""
    import xxhash

    own = _shingles(text, width)
    n = len(own)
    if not n:
        return 0, 0, 0, []
    digest = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    fp = int(_majority(own, np.zeros(1, np.int64)).view(np.int64)[0])
    keys: list[int] = []
    doublings = {max(0, math.ceil(math.log2(m / (GROUPS * SAMPLE)))) for m in (n, n / similarity)}
    for d in sorted(doublings):
        residue = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (GROUPS.bit_length() - 1) - d)
        chosen = residue < GROUPS
        order = np.argsort(residue[chosen], kind="stable")
        hashes, groups = own[chosen][order], residue[chosen][order]
        if len(groups):
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            prints = _majority(hashes, starts)
            keys += [x - (1 << 63) for x in ((prints * np.uint64(0xD6E8FEB86659FD93) + groups[starts] * np.uint64(64) + np.uint64(d)) & np.uint64((1 << 64) - 1)).tolist()]
    return digest - (1 << 63), n, fp, keys


def _sketch(text: Column, width: int, similarity: float) -> Column:
    @F.pandas_udf("same long, n long, fp long, keys array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([sketch_of(t, width, similarity) for t in batch.fillna("")], columns=["same", "n", "fp", "keys"])

    return of(text)


def _shingle_set(text: Column, width: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_shingles(t, width).view(np.int64) for t in batch.fillna("")])

    return of(text)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Of pairs(p, q) of classes: (u, v), those whose sets of shingles have the Jaccard similarity, and the tables that this reads. Only texts in pairs are read in full."""
    pairs = written(pairs.distinct(), "copy-pairs")
    ends = classes.select("same", F.col("first").alias("doc_id"), "n").join(pairs.select(F.explode(F.array("p", "q")).alias("same")).distinct(), "same")
    wanted = written(ends, "copy-ends")
    sets = only(docs, "doc_id", wanted).join(wanted, "doc_id").select("same", "doc_id", "n", _shingle_set(F.col("text"), width).alias("set"))
    sets = written(sets.groupBy("same").agg(F.min(F.when(F.size("set") == F.col("n"), F.col("set"))).alias("set")), "copy-sets")  # an id may repeat
    both = pairs.join(sets.select(F.col("same").alias("p"), F.col("set").alias("x")), "p").join(sets.select(F.col("same").alias("q"), F.col("set").alias("y")), "q")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select(F.col("p").alias("u"), F.col("q").alias("v")), [pairs, wanted, sets]


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs with an id: doc_id, component_id, the smallest doc_id that links reach: a link is a Jaccard similarity
    of the sets of word shingles of at least `similarity`.

    Texts of one set are one class. First the classes whose SimHashes differ in 3 bits or fewer are found by links(), verified and
    joined to components. A SimHash of texts of similarity 0.8 differs in 10 bits, too many for a grid. So, second, classes meet
    that share the SimHash of a sample of shingles, that the first step has not joined, whose lengths and whole SimHashes (FAR bits)
    allow the similarity; these are verified, too. The samples miss about one such pair in a thousand, the bits one in ten thousand; what is verified
    is compared in full. Texts without words are one class; rows without an id are left out; an empty table gives no rows."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("doc_id is not null")
    prints = written(docs.select("doc_id", _sketch(F.col("text"), width, similarity).alias("s")).select("doc_id", "s.*"), "sketches")
    classes = written(prints.groupBy("same").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "copy-classes")
    points = classes.groupBy("fp").agg(F.min("same").alias("head"))
    heads = lambda end: points.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    near = links(points.select("fp")).join(heads("u"), "u").join(heads("v"), "v").select(F.col("u_head").alias("p"), F.col("v_head").alias("q"))
    beside = classes.select("fp", "same").join(points, "fp").filter("same <> head").select(F.col("head").alias("p"), F.col("same").alias("q"))
    alike, read = _verified(near.union(beside), classes, docs, width, similarity)
    first = written(alike, "copy-links")
    discard(*read)
    joined = components(first).withColumnRenamed("node", "same")
    keyed = classes.join(joined, "same", "left").select(F.col("same").alias("h1"), "n", "fp", F.coalesce("root", "same").alias("root"), F.explode("keys").alias("key"))
    sizes = (F.col("a.n") >= similarity * F.col("b.n")) & (F.col("b.n") >= similarity * F.col("a.n"))
    bits = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= FAR
    hot: list[DataFrame] = []
    met = meet(keyed, (F.col("a.h1") < F.col("b.h1")) & (F.col("a.root") != F.col("b.root")) & sizes & bits, used=hot)
    alike, read = _verified(met, classes, docs, width, similarity)
    member = components(first.union(alike)).withColumnRenamed("node", "same")  # has read them when it returns
    discard(*hot, *read)
    rooted = classes.select("same", "first").join(member, "same", "left").withColumn("root", F.coalesce("root", "same"))
    named = written(rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("same", "component_id"), "copy-names")
    discard(classes, first)
    return salted(prints.select("doc_id", "same"), named, "same").select("doc_id", "component_id")


def salted(many: DataFrame, named: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """many joined by key with named, which has each key once: rows of one key are dealt out over `parts`, and named's row is sent to each of
    them if there are many."""
    hot = written(many.groupBy(key).count().filter(F.col("count") > COPIES).select(key), "hot-copies")
    dealt = many.join(hot.withColumn("_hot", F.lit(True)), key, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(parts))).otherwise(0).cast("int")).drop("_hot")
    sent = named.join(hot.withColumn("_hot", F.lit(True)), key, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(sent, [key, "_part"]).drop("_part")


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the documents whose component of near_copies() has a smaller id; rows without an id stay."""
    gone = near_copies(docs, text_col, id_col, width, similarity).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`") == F.col("g.gone"), "left_anti")
