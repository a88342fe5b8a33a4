"""Fill-in-middle: a text's middle moves behind its prefix and suffix, with a marker before each part.

A text is stored as its maximal runs of white space and of other characters, each with the units that end in it and all units up to
its end. A cut after so many units is found by binary search for its run, and its offset within the run by arithmetic, so no list of
tokens is made. Everything happens within the row: scan -> Arrow -> project, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle (fixed values). A text that has one of them stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Runs:
    """Maximal runs of the two classes. starts: where each begins; units: how many units end in it; upto: all units up to its end; step: the
    length of a unit within it. For words, a unit is a run of other characters with the white space before it (white space at the end
    is a unit of its own); for chars, a code point."""

    def __init__(self, text: str, unit: str = "word"):
        codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        white = (codes == 32) | ((codes >= 9) & (codes <= 13))
        self.chars = len(codes)
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.starts = np.concatenate(([0], edges)) if self.chars else np.empty(0, np.int64)
        lengths = np.diff(np.append(self.starts, self.chars))
        if unit == "char":
            self.units, self.step = lengths, np.ones_like(lengths)
        elif unit == "word":
            self.units, self.step = (~white[self.starts]).astype(np.int64), lengths
            if self.chars and white[-1]:
                self.units[-1] = 1
        else:
            raise ValueError(f"unknown unit {unit}")
        self.upto = np.cumsum(self.units)
        self.n = int(self.upto[-1]) if self.chars else 0

    def offset(self, k: int) -> int:
        """Code points before the end of the k-th unit, 0 for none."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.upto, k))
        return int(self.starts[run] + (k - self.upto[run] + self.units[run]) * self.step[run])


def moved(text: str, h: tuple[int, int, int, int], rate: int, suffix_first: int, unit: str) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) for four draws."""
    runs = Runs(text, unit)
    if not text or h[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return runs.n, "plain", None, None, text
    a, b = sorted((h[0] % (runs.n + 1), h[1] % (runs.n + 1)))
    i, j = runs.offset(a), runs.offset(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h[3] % 100 < suffix_first:
        return runs.n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return runs.n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four numbers below 2^32 from the digest of seed and id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: as the text has no marker, the output has just the three."""
    x = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda k: F.get(x, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rate: int = 50, suffix_first: int = 80, unit: str = "word", seed: int = 42) -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and output.

    rate: per cent of texts whose middle moves; suffix_first: per cent of those that begin with the suffix. Draws hang on seed and id only, so rows of
    one id are cut after the same draws, and the result is the same for any partitioning. Null texts count as empty; empty texts stay plain. Rows are
    neither dropped nor merged; columns of docs with these names are replaced, all others stay as they are."""

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def move(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *hs in batches:
            rows = [moved(t, h, rate, suffix_first, unit) for t, *h in zip(texts.tolist(), *(h.tolist() for h in hs), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ([],) * 5
            yield pd.DataFrame({"n": np.array(n, np.int64), "form": list(form), "prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64"), "output": list(output)})

    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    got = move(F.coalesce(F.col(text_col), F.lit("")), *draws(F.col(id_col), seed))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # a name of docs can't clash with what is added
    return docs.select(row.alias("row"), got.alias("got")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *(F.col("got").getField(c).alias(c) for c in new))
