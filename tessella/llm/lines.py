"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line is a duplicate if an earlier line (by doc_id, then position) is equal to it or within its edit tolerance. Equal lines meet
on their hash. For the rest, first occurrences of lines meet on hashes of segments, are filtered by counts inside the join, and are
verified by a banded bit-parallel edit distance.

Two lines that both have WORDS[0] words or more are compared by words, all others by characters. For words, a line is cut into chunks after words of certain endings, which depends on
nothing but the word before the cut; an edit of a word changes at most BROKEN chunks. So a line with more than
BROKEN chunks for each edit keeps one, and in any order of chunks one is among the first BROKEN * edits + 1 of either line: those are
its segments. Two lines that both have too few chunks for that meet on least hashes of neighbouring runs of RUN words, as they share
longer runs.

By characters meet the shorter lines, and with them those lines of WORDS[0] words or more from which so few edits as their length allows can lead below
WORDS[0]. Up to three edits, each line indexes the edits-plus-one segments of its text and probes
the substrings of lines up to the tolerance shorter that could match a segment: with so few edits one segment survives, at a place
that the lengths bound. Keys carry the segment's number and the indexed length. Where the edits follow the length (one for each PER
characters, in few but long words, or in scripts without spaces), the longest passage that so many edits can't break is of q + w - 1
characters or more, and both lines have the least hash of w neighbouring q-grams of that passage: they meet on such least hashes.

Pairs that share a key must agree, up to two bits or counts an edit, in the parity of their words, each of which flips one of 128 bits, or in how often some letters
occur - checked inside the join, so that lines with a common passage aren't paired. A key of many lines is dealt out in pairs of blocks.

A line's text is shuffled only to verify a pair; everything else travels as hashes. Where few rows of a table are
wanted by key (lines to verify, documents to change), a broadcast set of a bounded number of hash buckets spares the others the
shuffle; if all buckets are wanted it is a plain join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.keys import BUCKETS, every_block, meet, only, own_block
from tessella.llm.scratch import discard, written

#: (least length of the shorter line, edits): lines below the first length are compared for equality only. None, which only the
#: last may have, is one edit for each PER characters of the shorter line: 5 %, as the steps before it are.
TOLERANCE = ((20, 1), (40, 2), (60, None))
PER = 20
#: (least length of the shorter line, bytes of a gram q, grams of a window w): m characters with m // PER edits have an unbroken
#: passage of ceil((m - m // PER) / (m // PER + 1)) characters, 15 from 60 on and 18 from 200 on, which is q + w - 1.
GRAMS = ((60, 9, 7), (200, 11, 8))
#: (least words of both lines, words for each edit): if both have so many words, what single spaces part, they are compared by words: 5 %
#: of the shorter line's, one at least. If either has fewer, by characters.
WORDS = (13, 20)
#: A chunk of words ends after a word that ends in one of these (fixed values; any choice is exact, this one cuts every few words).
CUT = r" (?<=[st.,;:!?] )"
#: Chunks that one edit of a word can break, and words of a run that lines without enough chunks share.
BROKEN, RUN = 2, 6
#: Runs of a window: lines of 40 words or more within the tolerance share 13 words in a row, RUN + WINDOW - 1.
WINDOW = 8
#: (least words of the shorter line, words of a half): where one edit is allowed, two lines share their first or their last words of that number, which is half of the shorter line's at most.
HALVES = ((13, 6), (17, 8), (24, 12))
#: Earliest lines of a key of many lines that all its lines meet first; a line meets the others only as far as they may be earlier than what it has found.
PIVOTS = 32
_RANKS = 1023
#: Lines shorter than this are not taken for duplicates unless min_chars says so, as the query and the pipeline do with 1.
MIN_CHARS = 20
#: Letters whose counts bound the edits from below, and bits of each count.
LETTERS, COUNT_BITS = "etaoinshrl", 6
#: Edits up to which the distance is taken by bit vectors; beyond, by the banded distance of Spark.
NARROW = 3
_LAST = (1 << 63) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(edits: int, shorter: int) -> list[tuple[int, int, int]]:
    """(segment, first shift, last shift) from the segment's place in a line `shorter` shorter: the multi-match-aware bounds."""
    out = []
    for i in range(edits + 1):
        lo, hi = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
        if lo <= hi:
            out.append((i, lo, hi))
    return out


def _keys(line: Column, n: Column, tolerance: tuple[tuple[int, int | None], ...]) -> tuple[Column, Column]:
    """The index keys and the probe keys of a line of n characters, as arrays of hashes. Texts of one byte a character are cut as
    bytes, which takes no walk from the start."""
    raw = line.cast("binary")
    cut = lambda at, size: F.when(F.octet_length(line) == n, F.substring(raw, at, size)).otherwise(F.substring(line, at, size).cast("binary"))
    index, probe = [], []
    for k, (least, edits) in enumerate(tolerance):
        if edits is None:
            continue
        below = tolerance[k + 1][0] if k + 1 < len(tolerance) else 1 << 31
        for shorter in range(edits + 1):
            m = n - shorter
            fits = (m >= least) & (m < below)
            for i, lo, hi in _windows(edits, shorter):
                begin = F.floor(m * i / (edits + 1)).cast("int")
                size = F.floor(m * (i + 1) / (edits + 1)).cast("int") - begin
                if not shorter:
                    index.append(F.when(fits, F.xxhash64(F.lit(i), m, cut(begin + 1, size))))
                for shift in range(lo, hi + 1):
                    at = begin + 1 + shift
                    probe.append(F.when(fits & (at >= 1), F.xxhash64(F.lit(i), m, cut(F.greatest(at, F.lit(1)), size))))
    return F.array_compact(F.array(*index)), F.array_compact(F.array(*probe))


def _gram_keys(line: Column, n: Column) -> Column:
    """The least hashes of each window of grams of characters, for each length class whose pairs a line of n characters can be in. Grams are cut
    as bytes: a passage has at least as many bytes as characters."""
    raw = line.cast("binary")

    def least_hashes(k: int, q: int, w: int) -> Column:
        hashes = lambda r: F.transform(F.sequence(F.lit(1), F.octet_length(r) - (q - 1)), lambda i: F.xxhash64(F.lit(k), F.substring(r, i, F.lit(q))))
        windows = lambda h: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda at: F.least(*(F.get(h, at + j) for j in range(w)))))
        return F.get(F.transform(F.transform(F.array(raw), hashes), windows), F.lit(0))  # the bytes, and the hashes, are made once

    found = []
    for k, (least, q, w) in enumerate(GRAMS):
        fits = n >= least
        if k + 1 < len(GRAMS):
            fits = fits & (n - F.floor(n / PER) < GRAMS[k + 1][0])  # as the longer line of a pair, too
        found.append(F.when(fits, least_hashes(k, q, w)).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*found)


def _counts(line: Column) -> Column:
    """Counts of LETTERS, each modulo 2^COUNT_BITS, packed in a long."""
    size, ring = F.octet_length(line), (1 << COUNT_BITS) - 1
    count = lambda c: (size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(ring))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(count(c), COUNT_BITS * k) for k, c in enumerate(LETTERS)])


def _count_distance(a: Column, b: Column) -> Column:
    """Sum of the letters' differences on the ring, which never exceeds that of the full counts."""
    ring = (1 << COUNT_BITS) - 1
    ahead = lambda k: (F.shiftright(a, COUNT_BITS * k) - F.shiftright(b, COUNT_BITS * k)).bitwiseAND(F.lit(ring))
    return reduce(lambda x, y: x + y, [F.least(ahead(k), ring + 1 - ahead(k)) for k in range(len(LETTERS))])


def banded_distance(a: Column, b: Column, most: int, words: bool = False) -> Column:
    """The edit distance of two texts, by characters or by words that single spaces part, if it is at most `most` (up to 15), else null.

    Bit vectors hold the vertical differences of a band of 2 * most + 1 cells around the diagonal, which slides down a row with
    each character of b (Hyyro's banded form of Myers' algorithm). The distance is followed along the band's lower edge to the last row
    and then along that row; a pair that can't come back to `most` is carried on unchanged."""
    width = 2 * most + 1
    full = (1 << width) - 1
    flip = lambda x: x.bitwiseXOR(F.lit(full))
    bit = lambda x, k: F.shiftright(x, k).bitwiseAND(F.lit(1))

    def run(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        m, n = F.size(x), F.size(y)
        hopeless = F.lit(2 * most) + n - m

        def step(s: Column, at: Column) -> Column:
            ch, j = at["ch"], at["j"]  # j from 0
            rows = [F.when(F.coalesce(F.get(x, F.when(j + k - most >= 0, j + k - most)) == ch, F.lit(False)), F.lit(1 << k)).otherwise(0) for k in range(width)]
            hits = reduce(lambda p, q: p.bitwiseOR(q), rows)
            vp, vn = s["vp"], s["vn"]

            def diagonals(eq: Column) -> Column:
                return (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def advance(d0: Column) -> Column:
                hp, hn, down = vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftright(d0, 1)
                row = m - 1 - j + most  # the last row's bit
                along = F.when(row >= width - 1, 1 - bit(d0, width - 1)).otherwise(sum(F.when(row == k, bit(hp, k) - bit(hn, k)).otherwise(0) for k in range(width - 1)))
                return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + along).alias("d"))

            return F.when(s["d"] > hopeless, s).otherwise(let(let(hits, diagonals), advance))

        start = F.struct(F.lit(full ^ ((1 << most) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(most).alias("d"))
        return F.aggregate(F.transform(y, lambda ch, j: F.struct(ch.alias("ch"), j.alias("j"))), start, step)["d"]

    parts = lambda t: F.split(t, " ") if words else F.filter(F.split(t, ""), lambda c: c != "")
    size = (lambda t: _n_words(t)) if words else F.length
    long_enough = (size(a) > most) & (F.abs(size(a) - size(b)) <= most)
    short = F.lit(None).cast("int") if words else F.when(F.length(a) <= most, F.levenshtein(a, b))
    d = F.when(long_enough, let(F.struct(parts(a).alias("x"), parts(b).alias("y")), run)).otherwise(short)
    return let(d, lambda d: F.when(d <= most, d))


def word_distance(a: Column, b: Column, most: Column) -> Column:
    """The edit distance by words of two texts if it is at most `most`, else null. Each different word of the two becomes a code
    point of its own, so that the banded distance of texts does."""
    code = lambda at: F.decode(F.unhex(F.lpad(F.hex(at + F.when(at < 0x8000, 0x2000).otherwise(0x10000)), 8, "0")), "UTF-32")  # noqa: E731  past the surrogates
    spelt = lambda words, known: F.array_join(F.transform(words, lambda w: code(F.array_position(known, w))), "")
    pair = F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"))
    d = let(pair, lambda p: let(F.array_distinct(F.concat(p["x"], p["y"])), lambda known: let(F.struct(spelt(p["x"], known).alias("x"), spelt(p["y"], known).alias("y"), most.alias("k")), _threshold)))
    return F.when(d >= 0, d)


def _codes(line: Column) -> Column:
    """A text whose characters stand for the words of a line, by their hashes; different words may share one."""
    code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xF0000)) + 0x10000), 8, "0")  # noqa: E731  past the surrogates
    return F.decode(F.unhex(F.array_join(F.transform(F.split(line, " "), code), "")), "UTF-32")


def _coded_distance(p: str, q: str, most: Column) -> Column:
    """The edit distance by words of columns {p}_line and {q}_line if it is at most `most`, else null, from their codes: a lower bound,
    and where no two different words of the pair share a code the distance itself; else it is taken on the words."""
    bound = F.call_function("levenshtein", F.col(f"{p}_codes"), F.col(f"{q}_codes"), most)
    different = lambda c, part: F.size(F.array_union(F.split(f"{p}_{c}", part), F.split(f"{q}_{c}", part)))
    own = different("codes", "") == different("line", " ")
    narrow = banded_distance(F.col(f"{p}_line"), F.col(f"{q}_line"), NARROW, words=True)
    return F.when(bound >= 0, F.when(own, bound).when(most <= NARROW, narrow).otherwise(word_distance(F.col(f"{p}_line"), F.col(f"{q}_line"), most)))


def _threshold(p: Column) -> Column:
    return F.call_function("levenshtein", p["x"], p["y"], p["k"])


def _edits(shorter: Column, tolerance: tuple[tuple[int, int | None], ...]) -> Column:
    return reduce(lambda rule, t: F.when(shorter >= t[0], F.floor(shorter / PER).cast("int") if t[1] is None else F.lit(t[1])).otherwise(rule), tolerance, F.lit(0))


def _word_edits(shorter: Column) -> Column:
    return F.greatest(F.floor(shorter / WORDS[1]).cast("int"), F.lit(1))


def _n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _half_keys(line: Column, n: Column) -> Column:
    """The keys of a line of n words for pairs of one edit: its first and its last words, for its own length class and that of a line a word shorter."""

    def halves(m: Column) -> Column:
        h = reduce(lambda rule, c: F.when(m >= c[0], c[1]).otherwise(rule), HALVES, F.lit(None).cast("int"))
        return F.array(F.xxhash64(F.lit(-3), h, F.call_function("substring_index", line, F.lit(" "), h)), F.xxhash64(F.lit(-4), h, F.call_function("substring_index", line, F.lit(" "), -h)))

    two = lambda m: (m >= WORDS[0]) & (m < 2 * WORDS[1])
    begins = n.isin(*(least for least, _ in HALVES[1:]))  # with other halves than a line a word shorter has
    return F.when(two(n) & ~begins, halves(n)).when(two(n), F.concat(halves(n), halves(n - 1))).otherwise(halves(n - 1))


def _word_keys(line: Column, n: Column) -> Column:
    many = 2 * WORDS[1]  # words from which more than one edit is allowed
    return F.when(n < many, _half_keys(line, n)).when(n == many, F.concat(_half_keys(line, n), _chunk_keys(line, n))).otherwise(_chunk_keys(line, n))


def _chunk_keys(line: Column, n: Column) -> Column:
    """The keys of a line of n words for pairs of two edits or more: of its different chunks the first, in the order of their lengths, the longest first, as these
    are in few lines; all, and least hashes of its runs of words, if they are few."""
    enough = _word_edits(n) * BROKEN + 1
    rank = lambda c: (_RANKS - F.least(F.octet_length(c), F.lit(_RANKS))).cast("long")
    ranked = F.transform(F.split(line, CUT), lambda c: F.shiftleft(rank(c), 53).bitwiseOR(F.shiftrightunsigned(F.xxhash64(c), 11)))
    hashes = lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - (RUN - 1)), lambda i: F.xxhash64(F.lit(-2), F.slice(words, i, RUN)))
    least = lambda found: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(found) - (WINDOW - 1)), lambda i: F.array_min(F.slice(found, i, WINDOW))))
    chosen = lambda keys: F.when(F.size(keys) >= enough, F.slice(keys, F.lit(1), enough)).otherwise(F.concat(keys, let(let(F.split(line, " "), hashes), least)))
    return let(F.sort_array(F.array_distinct(ranked)), chosen)


def _parities(line: Column) -> Column:
    """Struct of two longs of which each word of a line flips a bit. An edit replaces a word, so two bits, or puts one in or leaves it out, so one."""
    flip = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h)  # noqa: E731  the shift takes its lowest bits
    half = lambda hashes, own: F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: F.when(own(h), s.bitwiseXOR(flip(h))).otherwise(s))
    return let(F.transform(F.split(line, " "), lambda w: F.hash(w)), lambda hashes: F.struct(half(hashes, lambda h: h >= 0).alias("low"), half(hashes, lambda h: h < 0).alias("high")))


def _met(leaders: DataFrame, tolerance: tuple[tuple[int, int | None], ...], used: list[DataFrame], alike: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """(p, q): hashes h1 of lines that share a key and may be within the tolerance; and what alike() has found of pairs that are left out for that, if any. Tables that these read are added to used."""
    found: list[DataFrame] = []
    distance = _count_distance(F.col("a.c"), F.col("b.c"))
    by_word = leaders.filter("keys is not null").select("h1", "at", "words", "low", "high", F.explode("keys").alias("key"))
    flipped = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in ("low", "high")])
    longer = F.abs(F.col("a.words") - F.col("b.words"))  # so many edits flip one bit only
    close = longer + F.greatest(flipped, longer) <= 2 * _word_edits(F.least("a.words", "b.words"))

    def settle(rows: DataFrame) -> tuple[DataFrame, Column]:
        """The rows, with the document in which the earliest line found for a line stands (before that, its own), when all lines have met the earliest of their keys; and which pairs are left."""
        rows = written(rows, "hot-rows")
        order = Window.partitionBy("key").orderBy("at", "h1")
        pivots = written(rows.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= PIVOTS), "pivots")
        first = pivots.withColumn("i", every_block()).alias("a").join(rows.withColumn("i", own_block()).alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.at") < F.col("b.at")) & close)
        star = written(first.select(F.col("a.h1").alias("p"), F.col("b.h1").alias("q")).distinct(), "pivot-pairs")
        found.append(alike(star))
        bound = found[0].groupBy("h1").agg(F.min("first")["d"].alias("bound"))
        leads = pivots.select("key", "h1", F.lit(True).alias("lead"))
        known = rows.join(bound, "h1", "left").join(leads, ["key", "h1"], "left")
        known = written(known.select("key", "h1", "words", "low", "high", "blocks", F.col("at.d").alias("d"), F.coalesce("bound", "at.d").alias("bound"), F.coalesce("lead", F.lit(False)).alias("lead")), "hot-bounds")
        discard(rows, pivots, star)
        used.append(known)
        useful = lambda x, y: (F.col(f"{x}.d") <= F.col(f"{y}.bound")) & ~(F.col(f"{x}.lead") & (F.col(f"{x}.d") < F.col(f"{y}.d")))  # noqa: E731  x is earlier, and y has not met it
        return known, (F.col("a.h1") < F.col("b.h1")) & close & (useful("a", "b") | useful("b", "a"))

    pairs = [meet(by_word, (F.col("a.h1") < F.col("b.h1")) & close, used=used, settle=settle)]
    short = leaders.filter(F.col("line").isNotNull() & (F.col("chars") >= min(t[0] for t in tolerance))).withColumns({"n": F.col("chars"), "few": F.col("keys").isNull()})
    near = (F.col("a.few") | F.col("b.few")) & (distance <= 2 * _edits(F.col("a.n"), tolerance))  # a is the shorter
    once = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.h1") < F.col("b.h1"))
    keys = lambda k: short.select("h1", "c", "n", "few", F.explode(_keys(F.col("line"), F.col("n"), tolerance)[k]).alias("key"))
    pairs.append(meet(keys(0), ((F.col("a.n") < F.col("b.n")) | (F.col("a.h1") < F.col("b.h1"))) & near, keys(1), used))
    if tolerance[-1][1] is None:
        grams = short.filter(F.col("n") >= tolerance[-1][0]).select("h1", "c", "n", "few", F.explode(_gram_keys(F.col("line"), F.col("n"))).alias("key"))
        pairs.append(meet(grams, once & (F.col("b.n") - F.col("a.n") <= _edits(F.col("a.n"), tolerance)) & near, used=used))
    met = reduce(DataFrame.union, pairs)
    return met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct(), found[0] if found else None


def similar_lines(leaders: DataFrame, lines: DataFrame, tolerance: tuple[tuple[int, int | None], ...] = TOLERANCE) -> DataFrame:
    """leaders(h1, h2, at struct<d, t, no>, words, chars, keys, low, high, c, line): the distinct lines, with keys and words' parities if they are compared by words and letters' counts and
    text if they are compared by characters; lines(h1, at, line): all -> (h1, h2, first): lines with an earlier line (a smaller `at`)
    within the tolerance of the shorter one, and where the earliest such line stands."""
    used: list[DataFrame] = []
    met, settled = _met(leaders, tolerance, used, lambda pairs: written(_alike(pairs, leaders, lines, tolerance, used), "settled-lines"))
    pairs = written(met, "line-pairs")
    found = _alike(pairs, leaders, lines, tolerance, used)
    found = found if settled is None else found.union(settled)
    similar = written(found.groupBy("h1", "h2").agg(F.min("first").alias("first")), "similar-lines")
    discard(pairs, *used, *([] if settled is None else [settled]))
    return similar


def _alike(pairs: DataFrame, leaders: DataFrame, lines: DataFrame, tolerance: tuple[tuple[int, int | None], ...], used: list[DataFrame]) -> DataFrame:
    """(h1, h2, first) of the later line of each of pairs(p, q) that is within the tolerance, and where the earlier one stands. Tables that this reads are added to used."""
    wanted = pairs.select(F.explode(F.array("p", "q")).alias("h1")).distinct()
    places = leaders.join(wanted, "h1", "left_semi").select("h1", "h2", "at", "chars", "words")
    place = F.xxhash64("at").alias("place")
    places = written(places.withColumn("place", place), "wanted-places")
    texts = only(lines.select(place, F.col("line")), "place", places).join(places, "place")
    texts = written(texts.withColumn("codes", F.when(F.col("words") >= WORDS[0], _codes(F.col("line")))), "wanted-lines")
    used += [places, texts]
    side = lambda new: texts.select(F.col("h1").alias(new), *(F.col(c).alias(f"{new}_{c}") for c in ("h2", "at", "line", "chars", "words", "codes")))
    words = F.least("p_words", "q_words")
    both = pairs.join(side("p"), "p").join(side("q"), "q").withColumn("_by_word", words >= WORDS[0])
    line = (F.col("p_line"), F.col("q_line"))
    allowed = F.when(F.col("_by_word"), _word_edits(words)).otherwise(_edits(F.least("p_chars", "q_chars"), tolerance))
    narrow = F.col("_k") <= NARROW
    by_character = F.when(narrow, banded_distance(*line, NARROW)).otherwise(F.expr("nullif(levenshtein(p_line, q_line, _k), -1)"))
    distance = F.when(F.col("_by_word"), _coded_distance("p", "q", F.col("_k"))).otherwise(by_character)
    alike = both.withColumn("_k", allowed).withColumn("_d", distance).filter(F.col("_d") <= F.col("_k"))
    later = F.col("p_at") > F.col("q_at")
    return alike.select(F.when(later, F.col("p")).otherwise(F.col("q")).alias("h1"), F.when(later, F.col("p_h2")).otherwise(F.col("q_h2")).alias("h2"), F.least("p_at", "q_at").alias("first"))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tolerance: tuple[tuple[int, int | None], ...] = TOLERANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text_col rid of duplicate lines, and n_lines, n_equal, n_similar (lines that went) and first_docs, the ids of the
    documents, distinct and sorted, that hold the lines for which they went.

    Lines are compared without surrounding white space; those under min_chars characters stay. Null texts stay null with no
    lines. Rows of equal id and text stand or fall together, rows of equal id are ordered by a hash of their texts, and null ids
    come last. An empty table gives no rows; columns of docs with the new names are replaced, all others stay, whatever their names."""
    new = ("n_lines", "n_equal", "n_similar", "first_docs")
    others = [c for c in docs.columns if c != text_col and c not in new]
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row") if others else F.struct(F.lit(0).alias("none")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("t"),
    )
    split = F.split("text", "\n")
    long_lines = F.filter(F.transform(split, lambda x, i: F.struct(i.alias("no"), F.btrim(x, F.lit(" \t\r\f\v")).alias("line"))), lambda s: F.length(s["line"]) >= min_chars)
    lines = keyed.select("d", "t", F.inline(long_lines)).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.struct("d", "t", "no").alias("at"), "line")
    counted = F.transform(long_lines, lambda s: F.struct(s["no"].alias("no"), s["line"].alias("line"), _n_words(s["line"]).alias("words")))
    by_word = F.col("words") >= WORDS[0]
    may_be_fewer = F.col("words") - (WORDS[0] - 1) <= _edits(F.length("line"), tolerance)  # each edit can join two words
    with_keys = keyed.select("d", "t", F.inline(counted)).select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.struct("d", "t", "no").alias("at"), "words", F.when(by_word, _word_keys(F.col("line"), F.col("words"))).alias("keys"), F.when(by_word, _parities(F.col("line"))).alias("k"), F.when(~by_word | may_be_fewer, F.col("line")).alias("line")
    )
    firsts = with_keys.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("words", "keys", "k", "line")))
    leaders = firsts.select("h1", "h2", "times", "at", "words", F.length("line").alias("chars"), "keys", "k.low", "k.high", _counts(F.col("line")).alias("c"), "line")
    leaders = written(leaders, "first-lines")
    similar = similar_lines(leaders, lines, tolerance)
    known = leaders.filter("times > 1").select("h1", "h2", F.col("at").alias("lead")).join(similar, ["h1", "h2"], "full")
    gone = only(lines.select("h1", "h2", "at"), "h1", known).join(known, ["h1", "h2"]).filter("first is not null or at <> lead")
    per_doc = gone.groupBy("at.d", "at.t").agg(F.collect_set(F.struct(F.col("at.no").alias("no"), F.col("first").isNotNull().alias("similar"), F.coalesce("first", "lead")["d"].alias("doc"))).alias("gone"))
    per_doc = written(per_doc, "gone-lines")
    discard(leaders, similar)
    bucket = F.pmod("t", F.lit(BUCKETS)).cast("int").alias("b")
    marks = F.broadcast(per_doc.select(bucket).distinct().withColumn("hit", F.lit(True)))
    marked = keyed.withColumn("b", bucket).join(marks, "b", "left")
    changed = marked.filter("hit").join(per_doc.hint("shuffle_hash"), ["d", "t"], "left").select("row", "text", "gone")
    out = changed.unionByName(marked.filter("hit is null").select("row", "text", F.lit(None).cast(per_doc.schema["gone"].dataType).alias("gone")))
    kept = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.transform("gone", lambda g: g["no"]))
    rest = let(split, lambda parts: F.array_join(F.transform(kept(parts), lambda i: F.get(parts, i)), "\n"))
    count = lambda similar: F.coalesce(F.size(F.filter("gone", lambda g: g["similar"] == similar)), F.lit(0))
    made = {
        text_col: F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest), "n_lines": F.greatest(F.size(split), F.lit(0)), "n_equal": count(False), "n_similar": count(True),
        "first_docs": F.coalesce(F.array_sort(F.array_distinct(F.transform("gone", lambda g: g["doc"]))), F.array().cast("array<bigint>")),
    }
    order = [c for c in docs.columns if c not in new] + list(new)
    return out.select(*(made.get(c, F.col("row").getField(c) if c in others else None).alias(c) for c in order))
