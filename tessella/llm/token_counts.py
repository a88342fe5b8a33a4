"""Token counts: Arrow batches in, lengths out.

Texts are cut at safe boundaries (see chunks), chunks not yet seen go to the library in batches balanced by bytes, and only
lengths leave the Python worker. No shuffle: the plan is scan -> Arrow -> project.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.chunks import LONG, MARKS, REMEMBERED, Memory, at_marks, balanced, head_and_words, load_tokenizer, per_worker

#: Bytes of new chunks that go to the library at once.
BATCH_BYTES = 1 << 16


class _Counter:
    def __init__(self, path: str):
        self.lengths = Memory(lambda chunk: self.count([chunk])[0], 3 * REMEMBERED)  # a head as it is, a later chunk without its space: a tab in front of the former tells them apart
        self.cut = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.split = lambda text: (text, [])  # normalisation there looks across spaces
            self.encode = lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
        else:
            model = load_tokenizer(path)
            self.cut = not any(set(MARKS) & set(t.content) for t in model.get_added_tokens_decoder().values())
            self.split = head_and_words
            self.encode = lambda batch: [len(x) for x in model.encode_batch_fast(batch, add_special_tokens=False)]

    def count(self, chunks: list[str]) -> list[int]:
        """Lengths of chunks, which go to the library in batches balanced by bytes; long ones in parts."""
        parts = [list(at_marks(c)) if self.cut and len(c) > LONG else [c] for c in chunks]
        lengths = iter([n for batch in balanced([p for x in parts for p in x], BATCH_BYTES) for n in self.encode(batch)])
        return [sum(next(lengths) for _ in x) for x in parts]

    def __call__(self, texts: list[str]) -> Iterator[int]:
        lengths = self.lengths
        for text in texts:
            head, words = self.split(text)
            known = dict.get
            found = [known(lengths, w) for w in words]
            if None in found:
                new = list({w: None for w, n in zip(words, found, strict=True) if n is None})
                made = dict(zip(new, self.count([" " + w for w in new]), strict=True))
                for w, n in made.items():
                    lengths.remember(w, n)
                found = [made[w] if n is None else n for w, n in zip(words, found, strict=True)]
            if (n := known(lengths, "\t" + head)) is None:
                n = self.count([head])[0]
                lengths.remember("\t" + head, n)
            yield sum(found) + n


def token_count(text: Column, tokenizer_path: str) -> Column:
    """The number of tokens of a text, as the library for tokenizer_path (.json: tokenizers, .model: sentencepiece) gives them
    without added, begin or end tokens. Null counts as the empty text. tokenizer_path must be readable on the executors."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = per_worker(("count", tokenizer_path), lambda: _Counter(tokenizer_path))
        for batch in texts:
            yield pd.Series(list(counter(batch.fillna("").tolist())), dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit). Null texts count as empty; rows are neither
    dropped nor merged; columns of docs with these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": token_count(text, tokenizer_path)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
