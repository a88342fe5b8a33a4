"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged alone: a line goes if it does not end like prose, reads like navigation, is boilerplate, or is
mostly symbols or shouting. A document goes if too much of it went, or if it fails the base rules (too short, or too much of
it in repeated word windows). Everything happens within the row, so the plan is scan -> project: no shuffle, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: what stands between ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]"
#: Line endings that close a sentence, closing quotes and brackets included.
CLOSED = r"[.!?:;…。！？][\"'»”’)\]]*\s*$"
#: Menus and trails: items parted by bars, arrows or bullets, or one item alone (fixed values, in the corpus's languages).
BARS = "|»›>•·"
TRAIL = rf"\S\s*[{BARS}]\s*\S.*[{BARS}]"
MENU = (
    r"(?i)^\s*(home|menu|login|log in|sign in|sign up|next|previous|back to top|skip to content|share|tweet"
    r"|startseite|men[üÜ]|anmelden|registrieren|weiter|zur[üÜ]ck|teilen"
    r"|accueil|connexion|s'inscrire|suivant|pr[éÉ]c[éÉ]dent|partager"
    r"|inicio|men[úÚ]|iniciar sesi[óÓ]n|registrarse|siguiente|anterior|compartir)\s*$"
)
#: The longest item of MENU has fewer characters.
MENU_CHARS = 20
#: Phrases of notices and footers (fixed values, in the corpus's languages).
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|enable javascript|copyright (©|\(c\))|subscribe to our newsletter|click here to"
    r"|alle rechte vorbehalten|datenschutz(erkl[äÄ]rung|bestimmungen)|nutzungsbedingungen|cookies (akzeptieren|zulassen)|newsletter abonnieren"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|conditions (g[éÉ]n[éÉ]rales )?d'utilisation|accepter (tous )?les cookies"
    r"|todos los derechos reservados|pol[íÍ]tica de (privacidad|cookies)|t[éÉ]rminos (de uso|y condiciones)|aceptar (todas )?(las )?cookies)"
)
#: Each phrase has one of these, in lower case: a line without them needs no look for phrases.
BOILERPLATE_HINTS = ("rights res", "terms of", "privacy pol", "cookie", "javascript", "copyright", "newsletter", "click here", "rechte vorb", "datenschutz", "nutzungsb", "droits r", "confidentialit", "d'utilisation", "derechos res", "tica de ", "rminos ")
#: What rules take for white space at the ends of a line.
SPACES = " \t\n\x0b\f\r"
#: A word that ends in a run of symbols.
NOISE = r"[#*$%&!|<>~^=_]{2,}(\s|$)"


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare != "", F.split(bare, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words lie in word windows that the text has twice or more.

    Words are hashed once, windows from their words' hashes. Equal windows are found by sorting (hash, position) pairs, and only in texts whose
    distinct hashes are fewer than their windows; the covered words then follow from the gaps between the sorted positions."""
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)

    def positions(p: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])

        return F.sort_array(F.transform(F.filter(p, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(_sorted(h), lambda p: let(positions(p), covered))))
    return F.when(F.size(words) >= window + 1, some).otherwise(F.lit(0)).cast("long")


def _sorted(hashes: Column) -> Column:
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def failing_line(line: Column, min_words: int = 3) -> Column:
    """The rule that a line fails, or null: "navigation", "boilerplate", "noise" or "punctuation", the first that holds.

    "punctuation" is a line of min_words words or more that does not end a sentence; shorter lines without an end are taken for
    headings and stay."""
    gaps = F.regexp_count(line, F.lit(WORD_GAP))
    noisy = F.when(line.rlike(NOISE), F.regexp_count(line, F.lit(NOISE)) * 2 > gaps + 1).otherwise(False)
    some = lambda found: reduce(lambda a, b: a | b, found)
    boilerplate = let(F.lower(line), lambda low: some(low.contains(hint) for hint in BOILERPLATE_HINTS)) & line.rlike(BOILERPLATE)
    navigation = some(line.contains(bar) for bar in BARS) & line.rlike(TRAIL) | (F.length(F.btrim(line, F.lit(SPACES))) < MENU_CHARS) & line.rlike(MENU)
    closed = F.substring(line, -1, 1).isin(*".!?") | line.rlike(CLOSED)
    return (
        F.when(boilerplate, "boilerplate")
        .when(noisy, "noise")
        .when(navigation, "navigation")
        .when(~closed & (gaps + 1 >= min_words), "punctuation")
    )


def clean_lines(text: Column) -> Column:
    """The lines of a text that pass, joined again; lines without words stay where they are."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: failing_line(line).isNull() | ~line.rlike(WORD)), "\n")


def judge(docs: DataFrame, text_col: str = "text", min_words: int = 10, most_repeated: float = 0.2, most_lost: float = 0.5) -> DataFrame:
    """docs with clean_text (failing lines removed), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
    base_failed and kept.

    base_failed: fewer than min_words words, or repeated windows cover more than most_repeated of them; such texts go whole, so
    their lines are not judged and clean_text is the text. kept: not base_failed,
    and no more than most_lost of the words' characters stood in failing lines. A null text has no words, so it fails.
    Repeated rows get equal results; columns of docs with these names are replaced, all others stay, whatever their names."""
    new = ("clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")
    others = [c for c in docs.columns if c not in new]
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("none"))
    chars = lambda x: F.length(F.regexp_replace(x, WORD_GAP, "")).cast("long")
    out = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    words = lambda: words_of(F.col("t"))
    with_words = F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD))
    counts = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    out = out.select("*", let(words(), counts).alias("w"))
    out = out.select("row", "t", "w.*", ((F.col("w.n_words") < min_words) | (F.col("w.n_repeat_words") > most_repeated * F.col("w.n_words"))).alias("base_failed"))
    out = out.select(
        "*", F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.when(F.col("base_failed"), F.col("t")).otherwise(clean_lines(F.col("t"))).alias("clean_text"),
    )
    out = out.withColumn("lost_chars", F.col("word_chars") - F.when(F.col("clean_text") == F.col("t"), F.col("word_chars")).otherwise(chars(F.col("clean_text"))))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= most_lost * F.col("word_chars")))
    return out.select(*(F.col("row").getField(c).alias(c) for c in others), *new)
