"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections, in DataFrame functions only.

Lines are paragraphs; a paragraph's leaves are its sentences, so that an edit in a text of one line still spares the other leaves. A
section ends after a paragraph whose digest says so, one in SECTION, so that paragraphs put in or left out move no other section's
bounds. Every parent is the SHA-256 of its children's digests; the root tests equality, and where roots differ the sections, then
the paragraphs that the other tree lacks locate the edit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paragraphs of a section, on average: 8, as a paragraph ends one if its digest ends in one of two of 16 digits.
SECTION, SECTION_ENDS = 8, "[08]$"
#: Bits of a packed leaf that hold its length.
_LENGTH_BITS = 26
#: A sentence: up to a stop that white space follows, with that white space.
_SENTENCE_END = r"(?<=[.!?…;:])(?=\s)"


def spans(text: Column) -> Column:
    """array<array<string>>: of each paragraph, its sentences; joined again they give the text."""
    return F.transform(F.split(text, "\n"), lambda p: F.split(p, _SENTENCE_END))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tree(text: Column) -> Column:
    """struct<paragraphs array<string>, leaves array<bigint>>: the digest of each paragraph, and the leaves, repeats included.

    A leaf packs 38 bits of its span's hash with its length (up to 2^26 code points), for likeness(); the second and later of equal leaves have the hash
    of how many went before as well, so that sets of leaves compare as the bags they stand for. Null is the empty text."""
    digest = lambda parts: F.sha2(F.array_join(parts, "\x1f"), 256)
    most = (1 << _LENGTH_BITS) - 1
    pack = lambda h, s: F.shiftleft(h, _LENGTH_BITS).bitwiseOR(F.least(F.length(s), F.lit(most)).cast("long"))

    def numbered(bag: Column) -> Column:
        again = lambda v, i: F.shiftleft(F.xxhash64(v, i + 1 - F.array_position(bag, v)), _LENGTH_BITS).bitwiseOR(v.bitwiseAND(F.lit(most)))
        return F.transform(bag, lambda v, i: F.when(F.get(bag, i - 1) == v, again(v, i)).otherwise(v))

    def both(cut: Column) -> Column:
        packed = F.transform(F.filter(F.flatten(cut), lambda s: s != ""), lambda s: pack(F.xxhash64(s), s))
        paragraphs = F.transform(cut, lambda p: digest(F.transform(p, lambda s: F.sha2(s, 256))))
        return F.struct(paragraphs.alias("paragraphs"), let(F.sort_array(packed), numbered).alias("leaves"))

    return let(spans(F.coalesce(text, F.lit(""))), both)


def _sections(paragraphs: Column) -> Column:
    """struct<digests array<string>, ends array<int>>: each section's digest, and the number of its last paragraph, from 1."""
    n = F.size(paragraphs)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.get(paragraphs, i - 1).rlike(SECTION_ENDS))

    def cut(at: Column) -> Column:
        before = lambda k: F.coalesce(F.get(at, k - 1), F.lit(0))
        return F.struct(F.transform(at, lambda end, k: F.sha2(F.array_join(F.slice(paragraphs, before(k) + 1, end - before(k)), "\x1f"), 256)).alias("digests"), at.alias("ends"))

    return let(ends, cut)


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, "\x1f"), 256)


def with_tree(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """df with {prefix}paragraphs, {prefix}sections, {prefix}ends, {prefix}root and {prefix}leaves of text_col; columns of these names are replaced."""
    out = df.withColumn(f"{prefix}leaves", tree(F.col(text_col)))
    out = out.withColumns({f"{prefix}paragraphs": F.col(f"{prefix}leaves.paragraphs"), f"{prefix}leaves": F.col(f"{prefix}leaves.leaves")})
    out = out.withColumn(f"{prefix}sections", _sections(F.col(f"{prefix}paragraphs")))
    out = out.withColumns({f"{prefix}ends": F.col(f"{prefix}sections.ends"), f"{prefix}sections": F.col(f"{prefix}sections.digests")})
    return out.withColumn(f"{prefix}root", root(F.col(f"{prefix}sections")))


def likeness(a: Column, b: Column) -> Column:
    """Of two trees' leaves: twice the length of the spans that both have, each as often as in both, over the length of each one's; 1 if
    both have none."""
    weigh = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v.bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1)))
    total = weigh(a) + weigh(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * weigh(F.array_intersect(a, b)) / F.when(total == 0, 1).otherwise(total))


def differing(a: Column, b: Column) -> Column:
    """Positions in b, from 0, of digests that a lacks."""
    at = lambda new: F.filter(F.transform(b, lambda d, i: F.when(F.array_contains(new, d), i)), lambda i: i.isNotNull())
    return let(F.array_except(b, a), lambda new: F.when(F.size(new) > 0, at(new)).otherwise(F.array().cast("array<int>")))


def differing_paragraphs(sections: Column, ends: Column, paragraphs: Column, other: Column) -> Column:
    """Down the branches: of the sections at these positions, the positions of paragraphs, from 0, that the other tree lacks."""
    first = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
    places = F.flatten(F.transform(sections, lambda k: F.sequence(first(k), F.get(ends, k) - 1)))
    return let(F.array_except(paragraphs, other), lambda new: F.filter(places, lambda i: F.array_contains(new, F.get(paragraphs, i))))


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", rows_a_bucket: int = 2000) -> DataFrame:
    """docs with next_{column}: those of the next row in descending id (after the last: the first).

    Ids are cut into ranges at their quantiles, so one shuffle brings neighbours together, whatever the ids' gaps, and the rows next
    to a range's end travel with it. Rows of equal ids follow one another by their text's
    hash; null ids come last. Ids that repeat much can't be parted by ranges and share a task. There are 5000 ranges at the most: beyond
    5000 * rows_a_bucket rows they grow, and with them the largest task."""
    count = docs.count()
    buckets = max(1, min(5000, count // rows_a_bucket))
    cuts = docs.select(F.percentile_approx(id_col, [k / buckets for k in range(1, buckets)] or [0.5], 20 * buckets).alias("q")).first()["q"]
    bucket = F.when(F.col(id_col).isNull(), -1).otherwise(_range_of(F.col(id_col), sorted(set(cuts or [0]))))
    keyed = docs.withColumns({"_bucket": bucket, "_tie": F.xxhash64(*columns)})
    # The first row of each range also goes, as an extra one, to the range before it (of the first range: to the last).
    first = F.max(F.struct(F.col(id_col).alias("i"), F.bitwise_not("_tie").alias("t"))).alias("h")
    heads = keyed.select("_bucket", id_col, "_tie").groupBy("_bucket").agg(first)
    before = F.lag("_bucket").over(Window.orderBy(F.col("_bucket").desc()))  # a row for each range, 5000 at the most
    sent = heads.withColumns({"_before": before, "_last": F.min("_bucket").over(Window.partitionBy())})
    sent = sent.select(F.col("h.i").alias("_i"), F.bitwise_not("h.t").alias("_t"), F.coalesce("_before", "_last").alias("_to"))
    marked = keyed.join(F.broadcast(sent), F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t")), "left")
    place = lambda to, extra: F.struct(to.alias("at"), F.lit(extra).alias("extra"))
    places = F.array_compact(F.array(place(F.col("_bucket"), False), F.when(F.col("_to").isNotNull(), place(F.col("_to"), True))))
    dealt = marked.select(*docs.columns, "_tie", F.inline(places))
    order = Window.partitionBy("at").orderBy("extra", F.col(id_col).desc_nulls_last(), "_tie")
    led = dealt.withColumn("_next", F.lead(F.struct(*columns)).over(order)).filter(~F.col("extra"))
    return led.select(*docs.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))


def _range_of(value: Column, cuts: list[int], step: int = 64) -> Column:
    """How many of the sorted cuts are at or below value: first among every step-th, then among those between."""
    below = lambda edges: F.size(F.filter(edges, lambda q: q <= value))
    coarse = below(F.array(*map(F.lit, cuts[step - 1 :: step])).cast("array<bigint>"))
    return coarse * step + below(F.slice(F.array(*map(F.lit, cuts)).cast("array<bigint>"), coarse * step + 1, step))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many characters, or all, of the beginning of another."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def compare_with_edit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    edited_section_list and edited_paragraph_list, where in the edited text the branches stand that the text's tree lacks.

    Null texts are empty; a table of one row is its own successor; repeated rows are compared like others. Other columns are left out."""
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    both = with_next(plain, ["text"])
    both = both.withColumns({"edited_text": edited(F.col("text"), F.col("next_text")), "next_leaves": tree(F.col("next_text"))["leaves"]})
    both = with_tree(with_tree(both, "text", ""), "edited_text", "edited_")
    both = both.withColumn("edited_section_list", differing(F.col("sections"), F.col("edited_sections")))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), F.col("root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        "edited_section_list", differing_paragraphs(F.col("edited_section_list"), F.col("edited_ends"), F.col("edited_paragraphs"), F.col("paragraphs")).alias("edited_paragraph_list"),
    )
