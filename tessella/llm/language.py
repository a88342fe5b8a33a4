"""Language by rank order: a document's most frequent n-grams against the most frequent ones of each language, by how far out of place they are.

Grams are one to three characters of lower-cased words with their bounds, packed in one long. For training each task counts the grams of its
batches by language and only (language, gram, count) is shuffled, so no language's documents meet in one task. A profile is the SIZE most frequent
grams; profiles are languages x SIZE numbers and are broadcast. Prediction happens within the row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.chunks import per_worker

#: Grams of a profile, of a document as of a language, and languages at most: with them the broadcast has at most 240 MB.
SIZE = 1000
MOST_LANGUAGES = 10_000
#: Grams that a task gathers before it counts them.
GATHERED = 1 << 21
UNKNOWN = "und"
#: Stands for a word's bounds: a control character, so in no word, and not 0, which would make a pair equal to its second character.
BOUND = 1


def _classes() -> np.ndarray:
    """By code point: 2 for a letter, 1 for a mark, which belongs to words too, 0 for all else."""
    kinds = {"L": 2, "M": 1}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def words_of(text: str) -> np.ndarray:
    """The lower-cased text's code points, with one BOUND for each run of what belongs to no word, and at both ends; empty without a letter."""
    classes = per_worker(("letters",), _classes)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes[codes]
    if not (kind == 2).any():
        return np.empty(0, np.int64)
    codes = np.concatenate(([BOUND], np.where(kind > 0, codes, BOUND), [BOUND])).astype(np.int64)
    return codes[np.concatenate(([True], (codes[1:] != BOUND) | (codes[:-1] != BOUND)))]


def grams_of(words: np.ndarray) -> np.ndarray:
    """All grams of one, two and three characters as longs; a bound counts as a character at either end, but not between two words."""
    pairs = (words[:-1] << 21) | words[1:]
    return np.concatenate((words[words != BOUND], pairs, ((pairs[:-1] << 21) | words[2:])[words[1:-1] != BOUND]))


def top(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams, of equally frequent ones the smaller first."""
    found, counts = np.unique(grams, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """All languages' ranked grams, by gram: places[starts[k]:starts[k + 1]] are the ranks of grams[k], in the languages at the same places of `of`.
    size is the penalty for a gram that a language's profile lacks."""

    def __init__(self, ranked: dict[str, list[int]], size: int = SIZE):
        self.languages, self.size = sorted(ranked), size
        every = np.array([g for language in self.languages for g in ranked[language]], np.int64)
        of = np.repeat(np.arange(len(self.languages)), [len(ranked[language]) for language in self.languages])
        places = np.concatenate([np.arange(len(ranked[language])) for language in self.languages] or [np.empty(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.grams, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))
        self.of, self.places = of[order].astype(np.int32), places[order].astype(np.int32)

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked grams to each language."""
        at = np.searchsorted(self.grams, own)
        mine = np.flatnonzero((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == own))
        first, n = self.starts[at[mine]], self.starts[at[mine] + 1] - self.starts[at[mine]]
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        saved = self.size - np.abs(self.places[entry] - np.repeat(mine, n))
        return len(own) * self.size - np.bincount(self.of[entry], saved, len(self.languages)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, of equally near ones the first by name, and 1 less the share of the largest possible distance."""
        words = words_of(text or "")
        if not len(words) or not self.languages:
            return UNKNOWN, 0.0
        own = top(grams_of(words), self.size)
        far = self.distances(own)
        best = int(np.argmin(far))
        return self.languages[best], 1.0 - float(far[best]) / (len(own) * self.size)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """labelled(lang, text), neither null -> (lang, gram, n) over all rows and whole texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted(lang: str, parts: list[np.ndarray]) -> pd.DataFrame:
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            return pd.DataFrame({"lang": lang, "gram": grams, "n": n})

        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(batch["lang"].tolist(), batch["text"].tolist(), strict=True):
                words = words_of(text)
                for k in range(0, len(words) - 1, GATHERED):  # parts overlap: by one for pairs, by two for threes
                    part = words[k : k + GATHERED + 2]
                    last = k + GATHERED + 2 >= len(words)
                    grams = grams_of(part) if last and k == 0 else _part(part, last)
                    held.setdefault(lang, []).append(grams)
                    sizes[lang] = sizes.get(lang, 0) + len(grams)
                    if sizes[lang] > GATHERED:
                        yield counted(lang, held.pop(lang))
                        del sizes[lang]
                    if last:
                        break
            for lang, parts in held.items():
                yield counted(lang, parts)

    return labelled.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _part(words: np.ndarray, last: bool) -> np.ndarray:
    """The grams that begin in a part; a part that isn't the last has two characters of the next behind it."""
    own = len(words) if last else len(words) - 2
    pairs = (words[:-1] << 21) | words[1:]
    threes = (pairs[:-1] << 21) | words[2:]
    single = words[:own]
    return np.concatenate((single[single != BOUND], pairs[:own], threes[:own][words[1 : 1 + min(own, len(threes))] != BOUND]))


def train(labelled: DataFrame, size: int = SIZE) -> Profiles:
    """Profiles of labelled(lang, text); rows with a null in either teach nothing. Without any, all texts are UNKNOWN. Raises ValueError beyond
    MOST_LANGUAGES, whose profiles the driver could not hold."""
    counts = gram_counts(labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).filter(F.col("place") <= size)
    ranked: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "gram", "place").toLocalIterator():  # size rows a language
        ranked.setdefault(r.lang, []).append((r.place, r.gram))
        if len(ranked) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Profiles({lang: [g for _, g in sorted(x)] for lang, x in ranked.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (UNKNOWN for a null text or one without a letter) and score (0 to 1; 0 for UNKNOWN). Only the text is looked at. Rows are
    neither dropped nor merged; columns of docs with these names are replaced, all others stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            yield pd.DataFrame([known.predict(t) for t in texts.tolist()], columns=["lang_pred", "score"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = docs.select(row.alias("row"), predict(F.col(text_col)).alias("got"))
    new = ("lang_pred", "score")
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *(F.col("got").getField(c).alias(c) for c in new))


def held_out(doc_id: Column) -> Column:
    """Whether a document is left for tests: a quarter of all, by the checksum of its id; a null id counts as no digits."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
