"""Vector codes against all distances, languages by held-out accuracy and a plain twin, fill-in-middle against token lists."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import pytest

pytest.importorskip("tessella.llm")
import duckdb
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import language, middle, queries, vectors

SF = "/root/testdata/sf0.001"


# --- vector codes


def codes_of(rows: list[tuple], parts: int, entries: int, rounds: int) -> dict:
    """(id, label, vector) rows -> everything, by plain loops over all entries."""
    width = max((len(v) for _, _, v in rows if v and all(x is not None and math.isfinite(x) for x in v)), default=0)
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) == width]
    length = -(-width // parts)
    good = [(i, l, v + [0] * (length * parts - width)) for i, l, v in good]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v, p: v[p * length : (p + 1) * length]
    books = [[cut(v, p) for _, _, v in good[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        homes = [[near(cut(v, p), books[p])[1] for _, _, v in good] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, _, v), h in zip(good, homes[p], strict=True) if h == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for i, l, v in good:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, l, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return {"rows": out, "sha": hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


VECTORS = "vec_id long, label int, embedding array<float>, code string, i string, _l int, error int"


def frame(spark, rows):
    return spark.createDataFrame([(i, l, v, "mine", "x", 7, 1) for i, l, v in rows], VECTORS)


@pytest.mark.parametrize("kind", ["random", "ties", "odd"])
def test_codes_are_those_of_all_distances(spark, kind):
    r = random.Random(5)
    if kind == "random":
        rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    elif kind == "ties":  # few distinct values: entries repeat and are equally near
        rows = [(i, None if i % 4 == 0 else i % 2, [r.choice([-1.0, 0.0, 1.0]) for _ in range(8)]) for i in range(200)]
    else:
        rows = [(1, 1, [1.0] * 7), (1, 1, [1.0] * 7), (None, None, [0.5] * 7), (2, 2, None), (3, 3, []), (4, 1, [1.0, None] + [0.0] * 5), (5, 1, [float("nan")] * 7), (6, 1, [float("inf")] * 7), (7, 5, [2.0] * 3), (1, 0, [-1.0] * 7), (9, 1, [-0.001] * 7)]
    expected = codes_of(rows, 4, 16, 2)
    table = frame(spark, rows).repartition(3)
    books = vectors.fit(table, parts=4, entries=16)
    out = vectors.encode(table, books)
    assert books.sha256() == expected["sha"]
    assert sorted(map(str, [(x.vec_id, x.label, x.code, x.error) for x in out.collect()])) == sorted(map(str, expected["rows"]))
    assert set(out.columns) == set(table.columns) and out.filter("i <> 'x' or _l <> 7").count() == 0
    sums = Counter()
    for _, l, _, e in expected["rows"]:
        sums[l] += e
    assert all(x.label_error == sums[x.label] for x in vectors.with_label_error(out.select("vec_id", "label", "code", "error")).collect())


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_LABELS", 3)
    rows = [(k, None if k % 9 == 0 else k % 9, k) for k in range(200)]
    out = vectors.with_label_error(spark.createDataFrame(rows, "vec_id long, label int, error long")).collect()
    sums = Counter()
    for _, l, e in rows:
        sums[l] += e
    assert len(out) == 200 and all(x.label_error == sums[x.label] for x in out)


def test_tree_is_exact():
    r = np.random.default_rng(3)
    for span in (2, 5, 1000):
        points, queries_ = r.integers(-span, span, (64, 4)), r.integers(-span, span, (500, 4))
        d = ((queries_[:, None] - points) ** 2).sum(2)
        at, far = vectors.KdTree(points).nearest(queries_)
        assert (at == d.argmin(1)).all() and (far == d.min(1)).all()


def test_no_vectors(spark):
    for rows in ([], [(1, 1, None)], [(2, 1, [])]):
        table = frame(spark, rows) if rows else spark.createDataFrame([], VECTORS)
        assert vectors.fit(table) is None and vectors.encode(table, None).count() == 0


def test_large_components_are_held(spark):
    rows = [(1, 1, [3e38] * 16), (2, 1, [-3e38] * 16), (3, 1, [0.0] * 16)]
    table = frame(spark, rows)
    assert {x.vec_id: x.error for x in vectors.encode(table, vectors.fit(table)).collect()} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_fill_in_middle"])
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    out = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(out.columns)
    assert sorted(map(str, (tuple(r) for r in out.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


# --- languages


def ranked(text: str, size: int = language.SIZE) -> list[str]:
    """A document's grams as strings, most frequent first; equally frequent ones by their characters read as numbers, shorter ones first."""
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split(" ")
    words = [w for w in words if w] if any(unicodedata.category(c)[0] == "L" for c in text.lower()) else []
    counts: Counter = Counter()
    for k, w in enumerate(words):
        padded = f"\1{w}\1"
        counts.update(w)
        counts.update(padded[j : j + 2] for j in range(len(padded) - 1))
        counts.update(padded[j : j + 3] for j in range(len(padded) - 2))
    packed = lambda g: sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], packed(x[0])))][:size]


def test_languages_as_by_plain_profiles(spark, documents):
    rows = [r for r in documents.select("doc_id", "text", "lang").collect()]
    profiles: dict[str, str] = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            profiles[r.lang] = profiles.get(r.lang, "") + " " + r.text
    places = {lang: {g: k for k, g in enumerate(ranked(text))} for lang, text in profiles.items()}
    out = {r.doc_id: r for r in queries.op12_language_id(spark, SF).collect()}
    assert len(out) == len(rows)
    for r in rows:
        own = ranked(r.text)
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not own:
            assert (out[r.doc_id].lang_pred, out[r.doc_id].score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(k - x[g]) if g in x else language.SIZE for k, g in enumerate(own)) for lang, x in places.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert out[r.doc_id].lang_pred == best and out[r.doc_id].score == pytest.approx(1 - far[best] / (len(own) * language.SIZE))


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op12_language_id(spark, sf).collect() if r.held_out and lang[r.doc_id]]
    assert len(held) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)


def test_odd_languages(spark, odd, empty):
    labelled = odd.select("text", F.lit("en").alias("lang"))
    profiles = language.train(labelled)
    docs = odd.withColumns({"row": F.lit("row"), "got": F.lit("got"), "score": F.lit("old")})
    out = language.identify(docs, profiles)
    assert out.count() == 9 and out.filter("row <> 'row' or got <> 'got'").count() == 0 and sorted(out.columns) == sorted([*docs.columns, "lang_pred"])
    assert {r.lang_pred for r in out.filter("text is null or trim(text) in ('', '\\n\\t')").collect()} <= {"und"}
    assert all(0 <= r.score <= 1 for r in out.collect())
    for nothing in (empty, odd.filter("text is null")):
        none = language.train(nothing.select("text", F.lit(None).cast("string").alias("lang")))
        assert none.languages == [] and {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(empty, profiles).count() == 0


def test_ties_between_languages(spark):
    profiles = language.train(spark.createDataFrame([("b", "same words here"), ("a", "same words here")], "lang string, text string"))
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([("words",), ("zzz",)], "text string"), profiles).collect()} == {"a"}


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    text = " ".join(f"wörd{i % 37}x ab" for i in range(300))
    df = spark.createDataFrame([("x", text), ("x", "Ende gut")], "lang string, text string")
    whole = {(r.gram, r.n) for r in language.gram_counts(df).collect()}
    found: Counter = Counter()
    for size in (1, 2, 3, 7, 50):
        words, parts = language.words_of(text), []
        for k in range(0, len(words) - 1, size):
            part = words[k : k + size + 2]
            last = k + size + 2 >= len(words)
            parts.append(language._part(part, last))
            if last:
                break
        grams, n = np.unique(np.concatenate(parts), return_counts=True)
        found = Counter(dict(zip(grams.tolist(), n.tolist(), strict=True)))
        plain, m = np.unique(language.grams_of(words), return_counts=True)
        assert found == Counter(dict(zip(plain.tolist(), m.tolist(), strict=True)))
    assert sum(n for _, n in whole) == len(language.grams_of(language.words_of(text))) + len(language.grams_of(language.words_of("Ende gut")))


# --- fill-in-middle

TOKEN = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")


def middle_of(doc_id, text: str) -> tuple:
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    w = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(w), "plain", None, None, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 80:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle(spark, odd, empty):
    r = random.Random(8)
    texts = ["".join(r.choice("ab \t\n\x0b\x0c\r é🙂<PSM>") for _ in range(r.randint(0, 30))) for _ in range(400)] + ["x <P> y", "<S>", "<", " ", "a", " a", "a ", "<S<S", "M>a<P"]
    df = spark.createDataFrame([(i, t, "row", "got") for i, t in enumerate(texts)], "doc_id long, text string, row string, got string")
    for docs in (df, odd, empty):
        out = middle.fill_in_middle(docs)
        rows = out.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
        for x in rows:
            assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == middle_of(x.doc_id, x.text or "")
            assert x.back == (x.text or "")
    assert {x.form for x in middle.fill_in_middle(df).select("form").distinct().collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["word", "char"])
def test_runs(unit):
    for text in ("", " ", "a", "ab  cd\n", "  ab", "é 🙂🙂  x"):
        units = TOKEN.findall(text) if unit == "word" else list(text)
        runs = middle.Runs(text, unit)
        assert runs.n == len(units)
        assert [runs.offset(k) for k in range(runs.n + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
    with pytest.raises(ValueError):
        middle.Runs("a", "line")
