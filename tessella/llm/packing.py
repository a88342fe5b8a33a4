"""Concatenate and cut: documents' tokens end to end, in windows of a fixed length.

Pass 1 encodes each document once and writes its ids, with the offset that they have within their task, to the shared folder;
the files fix the order whatever executors are lost later. The tasks' totals - a row for each task - become prefix sums, and
with them every document has a global offset. Pass 2 cuts at multiples of the window; each task does its own documents, so
nothing is shuffled. Only the last sequence is shorter than the window.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.chunks import REMEMBERED, Memory, load_tokenizer, per_worker
from tessella.llm.scratch import written

#: Bytes of ids that a task holds before it hands them on.
HELD = 16 << 20
#: The printable characters by which byte-level models spell bytes: printable Latin-1 ones for themselves, all others from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _OWN]
SPELT = {b: 256 + k for k, b in enumerate(_OTHERS)}
#: A word and the ASCII marks after it, which every pre-tokenizer of this kind takes together.
_PIECE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


class WordIds:
    """Encodes texts with a tokenizer that drops white space and lower-cases: each chunk between spaces stands for itself, and a
    word and the marks after it are separate pieces. The ids are little-endian unsigned 32-bit bytes. A word of lower-case letters goes to the
    tokenizer's model at once, as its normalizer and pre-tokenizer leave it as it is but for the spelling of its bytes."""

    def __init__(self, path: str):
        tokenizer = load_tokenizer(path)
        self._whole = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        self._tokens = tokenizer.model.tokenize
        self.pieces = Memory(self._letters)
        self.stops = Memory(self._whole)
        self.chunks = Memory(self._chunk, 4 * REMEMBERED)

    def _letters(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(SPELT)
        ids = [t.id for t in self._tokens(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if m := _PIECE.fullmatch(chunk):
            return self.pieces[m[1].lower()] + (self.stops[m[2]] if m[2] else b"")
        return self._whole(chunk) if chunk else b""

    def __call__(self, text: str) -> bytes:
        if text.isascii() and "<|" not in text:  # fewer chunks to remember; added tokens are matched before lower-casing
            text = text.lower()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def token_runs(docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str, id_col: str) -> DataFrame:
    """Pass 1, written out: doc_id, part (the task), start (ids before it in the task), ids (with end_id)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = per_worker(("words", tokenizer_path), lambda: WordIds(tokenizer_path))
        end, part, start = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = words(text or "") + end
                rows.append((None if pd.isna(doc) else int(doc), part, start, ids))
                start += len(ids) // 4
                held += len(ids)
                if held > HELD:
                    yield _frame(rows, schema)
                    rows, held = [], 0
            yield _frame(rows, schema)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(plain.mapInPandas(encode, schema), "token-runs")


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=schema.names)
    return out.astype({f.name: "Int64" for f in schema.fields if isinstance(f.dataType, T.LongType)})


def global_offsets(runs: DataFrame) -> DataFrame:
    """part -> base: the ids in the parts before it. One row for each task of pass 1, so the window and broadcast stay small."""
    totals = runs.groupBy("part").agg(F.sum(F.length("ids") / 4).cast("long").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, doc_tokens, start (in the document), length, sequence_id, offset (in the sequence), ids
    (binary, little-endian unsigned 32-bit).

    A null text is empty: one piece that holds end_id. Repeated rows are packed as often as they stand. An empty table gives no
    rows. Columns other than id and text are ignored."""
    runs = token_runs(docs, tokenizer_path, end_id, text_col, id_col)
    placed = runs.join(F.broadcast(global_offsets(runs)), "part")
    at, n = F.col("base") + F.col("start"), (F.length("ids") / 4).cast("long")
    first, last = F.floor(at / window), F.floor((at + n - 1) / window)
    pieces = placed.select("doc_id", "ids", n.alias("doc_tokens"), at.alias("_at"), F.explode(F.sequence(first, last)).alias("sequence_id"))
    begin = F.greatest(F.col("sequence_id") * window, F.col("_at"))
    end = F.least((F.col("sequence_id") + 1) * window, F.col("_at") + F.col("doc_tokens"))
    start, length = begin - F.col("_at"), end - begin
    return pieces.select(
        "doc_id", "doc_tokens", start.alias("start"), length.alias("length"), "sequence_id", (begin - F.col("sequence_id") * window).alias("offset"),
        F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
    )


def crc32_of(ids: Column) -> Column:
    """Unsigned CRC-32 of a piece's bytes."""
    return F.crc32(ids)
