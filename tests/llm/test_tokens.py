"""Token counts, BPE round trips and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessella.llm")
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import bpe, chunks, packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "🙂", "'s", "'ll", "123", "!!", "the", "ing", "<|endoftext|>", " ", "\x1c", "ß", "A", "un", "​", "'", "\r\n", "Straße", "İ", "é", "　"]


def made(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]
    return texts + ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", " ", "a" * 500, "aaaa aaaaa aaa", "<|endoftext|>" * 3]


def test_automaton_is_the_library():
    library, own = Tokenizer.from_file(BYTE), bpe.ByteBpe(BYTE)
    for text in made(3000, 1):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.round_trip(text)[2].decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_automaton_of_few_merges():
    """Runs of one letter, and a merge that an earlier one makes impossible."""
    vocab = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"aaaa": 259}
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"b"), (b"aa", b"aa")]
    auto = bpe.MergeAutomaton(vocab, merges)

    def plain(word: bytes) -> list[bytes]:
        parts = [bytes([b]) for b in word]
        for u, v in merges:
            out = []
            for p in parts:
                if out and out[-1] == u and p == v:
                    out[-1] = u + v
                else:
                    out.append(p)
            parts = out
        return parts

    for n in range(7):
        for k in range(2**n):
            word = bytes(b"ab"[(k >> i) & 1] for i in range(n))
            assert [auto.label[arc] for arc in auto.path(word)] == plain(word), word


def test_counts_are_the_library():
    library, count = Tokenizer.from_file(BYTE), token_counts._Counter(BYTE)
    texts = made(3000, 2)
    assert list(count(texts)) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_word_ids_are_the_library():
    library, own = Tokenizer.from_file(WORD), packing.WordIds(WORD)
    for text in made(3000, 3) + ["Thorin, THORIN.\nThorin., It's <|STARTOFTEXT|> <|startoftext|>"]:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_sentencepiece_counts(spark, documents):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = token_counts.count_tokens(documents.limit(20), path).select("text", "n_tokens").collect()
    assert all(r.n_tokens == len(model.encode(r.text)) for r in out)


def test_odd_rows(odd, empty):
    library = Tokenizer.from_file(BYTE)
    out = token_counts.count_tokens(odd, BYTE).collect()
    assert len(out) == 9 and all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in out)
    for r in bpe.encode_digests(odd, BYTE).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert token_counts.count_tokens(empty, BYTE).count() == bpe.encode_digests(empty, BYTE).count() == packing.pack(empty, WORD).count() == 0


def test_encode_decode_columns(odd):
    out = odd.withColumn("ids", bpe.encode_text(odd.text, BYTE))
    assert all((r.text or "") == r.back for r in out.withColumn("back", bpe.decode_ids(out.ids, BYTE)).collect())


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_covers_every_id_once(odd, window):
    library = Tokenizer.from_file(WORD)
    docs = odd.repartition(3)
    expected = Counter((r.doc_id, zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in odd.collect())
    pieces = packing.pack(docs, WORD, window=window).collect()
    whole: dict = {}
    at = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0) and p.length > 0 and len(p.ids) == 4 * p.length
        at[p.sequence_id] = p.offset + p.length
        if p.start == 0:
            whole.setdefault(p.doc_id, []).append((bytearray(), p.doc_tokens))
        next(x for x in whole[p.doc_id][::-1] if len(x[0]) == 4 * p.start and x[1] == p.doc_tokens)[0].extend(p.ids)
    assert sorted(at) == list(range(len(at))) and all(n == window for s, n in at.items() if s < len(at) - 1)
    assert Counter((d, zlib.crc32(bytes(b))) for d, parts in whole.items() for b, _ in parts) == expected


@pytest.mark.parametrize("run", ["=", "a", "etaoin", "日"])
def test_a_long_run_takes_memory_by_its_length(run):
    import tracemalloc

    library, own = Tokenizer.from_file(BYTE), bpe.ByteBpe(BYTE)
    text = "see " + run * (20_000 // len(run))
    tracemalloc.start()
    try:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert tracemalloc.get_traced_memory()[1] < 40_000_000
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("run", ["=", "etaoinshrdlu"])
def test_a_run_of_1_000_000_characters(run):
    library, own = Tokenizer.from_file(BYTE), bpe.ByteBpe(BYTE)
    text = (run * (1_000_000 // len(run) + 1))[:1_000_000]
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_memories_are_bounded_by_bytes_on_texts_without_spaces():
    """Long chunks are not remembered, short ones up to a number of bytes; cuts at marks leave counts as they are."""
    r = random.Random(6)
    texts = ["".join(r.choice("日本語漢字文章。、！abc'") for _ in range(r.choice([30, 3000, 40_000]))) for _ in range(60)]
    library, count, own, words = Tokenizer.from_file(BYTE), token_counts._Counter(BYTE), bpe.ByteBpe(BYTE), packing.WordIds(WORD)
    count.lengths.most = own.tails.most = own.heads.most = own.words.most = words.chunks.most = words.pieces.most = 20_000
    for text, n in zip(texts, count(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert n == len(ids) and own.encode(text) == ids
        words(text)
    for memory in (count.lengths, own.heads, own.words, own.tails, words.chunks, words.pieces):
        assert memory.held <= 20_000 and all(len(c) <= chunks.KEPT for c in memory)
        assert sum(map(chunks.weight, memory)) <= memory.held


def test_a_word_leaves_no_beginnings_behind():
    """Encoding a word keeps arcs between tokens only, and its path spells it."""
    from tessella.llm import bpe

    made = bpe.MergeAutomaton({b"a": 0, b"b": 1, b"ab": 2, b"abab": 3}, [(b"a", b"b"), (b"ab", b"ab")])
    sizes = lambda: {k: len(v) for k, v in vars(made).items() if isinstance(v, dict) and k != "table"}
    before = sizes()
    assert made.encode(b"ababab") == [3, 2] and made.encode(b"ba") == [1, 0] and sizes() == before
