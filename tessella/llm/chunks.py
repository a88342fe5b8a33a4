"""Cutting texts where a tokenizer's result cannot depend on the cut, and remembering what each chunk gives.

Byte-level pre-tokenizers end a piece before a space that a non-space follows (a run of white space keeps all but its last
character), so a text may be cut before every such space. Pre-tokenizers that drop white space may be cut at any space.
Natural-language corpora repeat their chunks, so each worker encodes a chunk once and then looks it up; the memory is
bounded by its bytes, and emptied when full. Long chunks (texts without spaces) are not remembered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import regex

# A space whose successor is white space or the end of the text: the run goes on there.
_INSIDE_RUN = re.compile(r" (?=\s|\Z)")
_BEFORE_WORD = re.compile(r" (?=\S)")
#: Bytes of chunks and results that a worker remembers before it starts anew, and characters beyond which a chunk is not remembered.
REMEMBERED = 96 << 20
KEPT = 64
#: Characters from which a chunk without a space is cut between a letter and one of these marks (fixed values), where every
#: pre-tokenizer that parts letters from marks ends a piece.
LONG = 1 << 14
MARKS = "。，、！？；：,;!?"
_BEFORE_MARK = regex.compile(rf"(?<=\p{{L}})(?=[{MARKS}])")


def weight(chunk: str) -> int:
    """The bytes that a remembered chunk takes with its result, at most or nearly: its characters, and as many tokens as it has bytes."""
    return 350 + (8 if chunk.isascii() else 32) * len(chunk)


class Memory(dict):
    """chunk -> encode(chunk), computed when first asked for; long chunks are computed each time."""

    def __init__(self, encode: Callable, most: int = REMEMBERED):
        super().__init__()
        self.encode, self.most, self.held = encode, most, 0

    def __missing__(self, chunk):
        value = self.encode(chunk)
        size = len(chunk)
        if size <= KEPT:  # as remember() does, for speed
            self.held += 350 + (8 if chunk.isascii() else 32) * size
            if self.held > self.most:
                self.clear()
                self.held = weight(chunk)
            self[chunk] = value
        return value

    def remember(self, chunk: str, value) -> None:
        if len(chunk) <= KEPT:
            more = weight(chunk)
            if self.held + more > self.most:
                self.clear()
                self.held = 0
            self.held += more
            self[chunk] = value


def at_marks(chunk: str) -> Iterator[str]:
    """A chunk in parts of LONG characters or a little more, where it has marks to cut at."""
    at = 0
    while len(chunk) - at > LONG and (m := _BEFORE_MARK.search(chunk, at + LONG)):
        yield chunk[at : m.start()]
        at = m.start()
    yield chunk[at:]


def head_and_words(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the chunks after it without the space that each begins with."""
    parts = _BEFORE_WORD.split(text) if _INSIDE_RUN.search(text) else text.split(" ")
    return parts[0], parts[1:]


def balanced(chunks: list[str], most_bytes: int) -> Iterator[list[str]]:
    """chunks in batches of about most_bytes, so that no batch is much slower than another."""
    batch, total = [], 0
    for chunk in chunks:
        batch.append(chunk)
        total += len(chunk) if chunk.isascii() else len(chunk.encode("utf-8", "surrogatepass"))
        if total >= most_bytes:
            yield batch
            batch, total = [], 0
    if batch:
        yield batch


_LOADED: dict = {}


def per_worker(key: tuple, make: Callable):
    """make()'s value, kept for the life of the Python worker."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def load_tokenizer(path: str):
    """The tokenizers library's object for a .json file, without truncation or padding and single-threaded."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
