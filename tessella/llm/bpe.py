"""Byte-level BPE as an automaton over tokens.

The automaton starts with one state whose arcs are the single bytes. Each merge (u, v) -> uv, in order, applies one gadget:
wherever a u-arc leads to a state r that has a v-arc to s, a uv-arc to s is added and the u-arc is led to a copy of r that
lacks the v-arc. As all u-arcs lead to one state, that copy is the state "u was last" itself, less one arc; the uv-arc leaves
exactly the states that u's arc leaves, and its state starts as a copy of v's state as it was then. So a state is a token, with
(a) the state it was copied from and when and (b) the arcs taken from it and when; whether state x has an arc y follows from both
of them down to bytes, and then stands in a table of arcs.

A path of arcs that spells a word is its BPE encoding and there is only one. Arcs carry many bytes, so a second table, compiled
beforehand from the arcs' labels, takes one step for each byte: its nodes are the labels' beginnings, and each knows the longest label
that ends there. Encoding takes that step, then the longest such label that the state at its start has as an arc; the last arc of
each beginning of the word is kept by position, so that time and memory follow the length. Decoding emits arc labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.chunks import REMEMBERED, Memory, head_and_words, per_worker

#: Words as the byte-level pre-tokenizer cuts them (a fixed value of this family of tokenizers).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Arcs between tokens that a worker remembers before it starts anew.
TABLE = 500_000
_EVER = 1 << 60


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it prints, else the next code point from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    stand_ins = iter(range(256, 512))
    return {chr(b if b in prints else next(stand_ins)): b for b in range(256)}


class MergeAutomaton:
    """Built from a vocabulary {bytes: id} and ordered merges [(bytes, bytes)]."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = {i: t for t, i in vocab.items()}
        self.vocab = vocab
        # An arc is a number: bytes first, then merges in order. Of each: the merge that made it, its halves and its label.
        self.arcs = {bytes([b]): b for b in range(256)}
        self.born, self.halves, self.label = [-1] * 256, [(0, 0)] * 256, [bytes([b]) for b in range(256)]
        self.cut: dict[int, int] = {}  # state and arc -> the merge that took the arc from the state
        for k, (u, v) in enumerate(merges):
            self._gadget(k, u, v)
        self.table: dict[int, bool] = {}
        self.sizes = [len(t) for t in self.label]
        self.ids = [vocab.get(t, -1) for t in self.label]
        self._compile()

    def _gadget(self, k: int, u: bytes, v: bytes) -> None:
        x, y = self.arcs.get(u), self.arcs.get(v)
        if x is None or y is None or not self._has_arc(x, y, k):
            return  # no path has these arcs in a row, so the merge never applies
        self.cut[x << 32 | y] = k
        if u + v not in self.arcs:
            self.arcs[u + v] = len(self.label)
            self.label.append(u + v)
            self.born.append(k)
            self.halves.append((x, y))

    def _has_arc(self, state: int, arc: int, until: int) -> bool:
        """Whether, before merge `until`, the state "state was last" had the arc."""
        born, halves, cut = self.born, self.halves, self.cut
        while True:
            if cut.get(state << 32 | arc, until) < until:
                return False
            a, b = born[state], born[arc]
            if a < 0 and b < 0:
                return True
            if a > b:  # the state began as a copy of its right half's, with the arcs of then
                until, state = a, halves[state][1]
            else:  # the arc was added wherever its left half's arc was left; in runs (u = v) that merge itself cuts u's own
                until, arc = b + 1, halves[arc][0]

    def _compile(self) -> None:
        """The byte table: node and byte -> node for the beginnings of labels; of a node, the one to go on from if it has no such
        byte, and the longest label that ends there; of an arc, the longest shorter label that ends it."""
        self.step: dict[int, int] = {}
        depth, ends = [0], [-1]
        for arc, label in enumerate(self.label):
            node = 0
            for byte in label:
                key = node << 8 | byte
                if (new := self.step.get(key)) is None:
                    new = self.step[key] = len(depth)
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                node = new
            ends[node] = arc
        self.fall, self.longest, self.shorter = [0] * len(depth), list(ends), [-1] * len(self.label)
        for key, node in sorted(self.step.items(), key=lambda x: depth[x[1]]):
            parent, byte = key >> 8, key & 255
            if parent:
                at = self.fall[parent]
                while at and (at << 8 | byte) not in self.step:
                    at = self.fall[at]
                self.fall[node] = self.step.get(at << 8 | byte, 0)
            below = self.longest[self.fall[node]]
            if ends[node] < 0:
                self.longest[node] = below
            else:
                self.shorter[ends[node]] = below

    def follows(self, state: int, arc: int) -> bool:
        key = state << 32 | arc
        if (known := self.table.get(key)) is None:
            if len(self.table) >= TABLE:
                self.table.clear()
            known = self.table[key] = self._has_arc(state, arc, _EVER)
        return known

    def path(self, word: bytes) -> list[int]:
        """The arcs that spell word. The last arc of the path to each place stands in a list, so time and memory follow the length."""
        step, fall, longest, shorter, sizes, table = self.step.get, self.fall, self.longest, self.shorter, self.sizes, self.table.get
        last, node = [-1], 0
        for end, byte in enumerate(word, 1):
            while (new := step(node << 8 | byte)) is None:
                node = fall[node]
            node = new
            arc = longest[node]
            while start := end - sizes[arc]:
                allowed = table(last[start] << 32 | arc)
                if allowed or allowed is None and self.follows(last[start], arc):
                    break
                arc = shorter[arc]
            last.append(arc)
        out, end = [], len(word)
        while end:
            out.append(arc := last[end])
            end -= sizes[arc]
        return out[::-1]

    def encode(self, word: bytes) -> list[int]:
        return [self.ids[arc] for arc in self.path(word)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class ByteBpe:
    """A tokenizer file's automaton, its added tokens and a bounded memory of chunks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_of_symbol()
        raw = lambda t: bytes(symbol[c] for c in t)
        model = spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = MergeAutomaton({raw(t): i for t, i in model["vocab"].items() if t not in self.added}, [(raw(a), raw(b)) for a, b in pairs])
        self.automaton.labels |= {i: t.encode() for t, i in self.added.items()}
        self._words = regex.compile(WORDS)
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = Memory(lambda w: self.automaton.encode(w.encode()), REMEMBERED // 3)
        self.heads = Memory(self._chunk, REMEMBERED // 3)
        self.tails = Memory(lambda w: self._chunk(" " + w), 3 * REMEMBERED)

    def _chunk(self, chunk: str) -> tuple[str, int, bytes]:
        """Of a chunk: its ids, each followed by a comma; how many; the bytes they decode to."""
        ids: list[int] = []
        for k, part in enumerate(self._added.split(chunk) if self._added else [chunk]):
            if k % 2:
                ids.append(self.added[part])
            elif part:
                for word in self._words.findall(part):
                    ids += self.words[word]
        return "".join(f"{i}," for i in ids), len(ids), self.automaton.decode(ids)

    def round_trip(self, text: str) -> tuple[str, int, bytes]:
        head, words = head_and_words(text)
        a, n, b = self.heads[head]
        if not words:
            return a[:-1], n, b
        ids, counts, labels = zip(*map(self.tails.__getitem__, words), strict=True)
        return (a + "".join(ids))[:-1], n + sum(counts), b + b"".join(labels)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.round_trip(text)[0].split(",") if i]


def encode_text(text: Column, tokenizer_path: str) -> Column:
    """The ids of a text as array<int>; null encodes as the empty text."""

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = per_worker(("bpe", tokenizer_path), lambda: ByteBpe(tokenizer_path))
        for batch in texts:
            yield pd.Series([bpe.encode(t) for t in batch.fillna("")])

    return encode(text)


def decode_ids(ids: Column, tokenizer_path: str) -> Column:
    """The text that ids (array<int>) spell; invalid UTF-8 becomes replacement characters, null stays null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = per_worker(("bpe", tokenizer_path), lambda: ByteBpe(tokenizer_path))
        for batch in batches:
            yield pd.Series([None if x is None else bpe.automaton.decode(list(map(int, x))).decode("utf-8", "replace") for x in batch], dtype=object)

    return decode(ids)


def encode_digests(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """docs' rows with n_tokens, ids_sha256 and decoded_sha256, without moving ids or texts out of the worker.

    Null is the empty text (no tokens, both digests of the empty string); rows and other columns are left as they are, except
    that columns with these three names are replaced."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = per_worker(("bpe", tokenizer_path), lambda: ByteBpe(tokenizer_path))
        for batch in texts:
            rows = []
            for text in batch.fillna(""):
                ids, n, raw = bpe.round_trip(text)
                decoded = raw.decode("utf-8", "replace").encode()
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return docs.select(F.struct(*others).alias("row"), digest(F.col(f"`{text_col}`").cast("string")).alias("digest")).select("row.*", *(f"digest.{c}" for c in new))
