"""Text columns: formulas as text, HTML as text, tokens and similarity of token sets."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that a structural fingerprint folds together (fixed values).
PRICES = ("close_trade_px", "open_trade_px", "high_trade_px", "low_trade_px", "close_mid_px", "open_mid_px", "high_mid_px", "low_mid_px", "vwap")
VOLUMES = ("trade_count", "dvolume", "volume")


def canonical(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"\s+", ""))


def fingerprint(x: Column) -> Column:
    """A formula with fields as _price or _vol and whole numbers as _n."""
    out = canonical(x)
    for name in sorted(PRICES + VOLUMES, key=len, reverse=True):
        out = F.replace(out, F.lit(name), F.lit("_price" if name in PRICES else "_vol"))
    return F.regexp_replace(out, r"\b\d+\b", "_n")


def slug(x: Column) -> Column:
    """Lower-case words joined by dashes, with eight digits of the text's SHA-1."""
    words = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat_ws("-", F.substring(words, 1, 40), F.substring(F.sha1(x), 1, 8))


def html_to_text(x: Column, most: int | None = None) -> Column:
    """Without scripts, styles and tags, white space as single spaces."""
    out = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]+>", " "), r"[ \t\n\r\f]+", " "))
    return F.substring(out, 1, most) if most else out


def title(x: Column) -> Column:
    return F.trim(F.regexp_extract(x, r"(?is)<title[^>]*>(.*?)</title>", 1))


def tokens(x: Column) -> Column:
    """The distinct words of a text, lower-cased: letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9_]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """A vector of length one, or of zeros."""
    scaled = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / F.when(n > 0, n)).otherwise(0.0))
    return F.get(F.transform(F.array(F.sqrt(dot(a, a))), scaled), F.lit(0))  # the length is taken once


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.when(norm > 0, norm)).otherwise(0.0)


def _literal(texts: pd.Series) -> pd.Series:
    def parse(t: str | None) -> str | None:
        try:
            return json.dumps(ast.literal_eval(t.strip())) if t is not None else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return texts.map(parse)


def tolerant_json(x: Column) -> Column:
    """struct(json, how, corrupt): a text as JSON, or else as a Python literal made JSON. how: json, literal, corrupt or empty; corrupt: the text itself where neither works.
    No text is lost. Only what isn't JSON goes to Python."""
    literal = F.pandas_udf(_literal, "string")
    parsed = F.to_json(F.try_parse_json(x))
    blank = x.isNull() | (F.trim(x) == "")
    other = literal(F.when(parsed.isNull() & ~blank, x))
    how = F.when(blank, "empty").when(parsed.isNotNull(), "json").when(other.isNotNull(), "literal").otherwise("corrupt")
    return F.struct(F.when(~blank, F.coalesce(parsed, other)).alias("json"), how.alias("how"), F.when(how == "corrupt", x).alias("corrupt"))
