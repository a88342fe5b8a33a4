"""Quality rules, Merkle fingerprints, SimHash groups and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

pytest.importorskip("tessella.llm")
import xxhash
from pyspark.sql import functions as F

from tessella.llm import components, keys, lines, merkle, quality, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_of(text: str) -> tuple:
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(k, k + 5))
    with_words = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(with_words) - len(set(with_words)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_counts(documents, odd):
    for docs, n in ((documents, 200), (odd, 9)):
        out = quality.judge(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert len(out) == n
        for r in out:
            assert tuple(r[1:7]) == quality_of(r.text or "")
            assert not (r.kept and r.base_failed)


def test_line_rules(spark):
    rule = {"Home | News | Sports | More": "navigation", "All rights reserved by the owner.": "boilerplate", "the### of*** and$$$": "noise", "This line has no end": "punctuation", "A title": None, "It ends well.": None}
    out = spark.createDataFrame([(x,) for x in rule], "x string").select("x", quality.failing_line(F.col("x")).alias("r")).collect()
    assert {r.x: r.r for r in out} == rule


def test_line_rules_in_each_language(spark):
    phrases = [
        "Tous droits réservés à l'éditeur.", "TOUS DROITS RÉSERVÉS à l'éditeur.", "Voir notre politique de confidentialité.", "Alle Rechte vorbehalten, auch die der Übersetzung.", "Es gilt die Datenschutzerklärung.",
        "Todos los derechos reservados por ley.", "Lea la POLÍTICA DE PRIVACIDAD antes.", "Acepte los términos de uso, por favor.", "See the Terms of Use first.", "COPYRIGHT (C) by the owner.",
    ]
    menus = ["Startseite", "  Zurück ", "ZURÜCK", "Accueil\r", "Précédent", "Iniciar sesión", " " * 40 + "Skip to content"]
    prose = ["La politique a changé depuis hier.", "Der Weg führte weiter und zurück.", "El término medio es mejor.", "Die Rechte der Kinder sind wichtig.", "They served tea and cookies to all.", "Zurück zur Natur"]
    cases = {**dict.fromkeys(phrases, "boilerplate"), **dict.fromkeys(menus, "navigation"), **dict.fromkeys(prose[:-1], None), prose[-1]: "punctuation"}
    out = spark.createDataFrame([(x,) for x in cases], "x string").select("x", quality.failing_line(F.col("x")).alias("r")).collect()
    assert {r.x: r.r for r in out} == cases


def test_every_phrase_has_its_hint():
    """The hints are a filter before the pattern: no alternative may be without one."""
    plain = re.sub(r"\[(.)[^\]]*\]", r"\1", quality.BOILERPLATE.removeprefix("(?i)(").removesuffix(")")).replace("\\", "")
    depth, parts = 0, [""]
    for ch in plain:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    assert len(parts) > 15 and all(any(hint in part for hint in quality.BOILERPLATE_HINTS) for part in (p.replace("(use|service)", "use") for p in parts))


def test_quality_keeps_good_labels(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = quality.judge(documents).join(labels, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert all(r.kept == (r.quality == 1) for r in out)


def test_successors_by_ranges(spark):
    r = random.Random(1)
    ids = [r.randint(-(10**6), 10**6) for _ in range(300)]
    out = merkle.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string"), ["text"], rows_a_bucket=10).collect()
    order = sorted(ids, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    assert all(x.next_text == f"t{after[x.doc_id]}" for x in out)


def test_merkle(documents, odd, empty):
    docs = {r.doc_id: r.text for r in documents.collect()}
    order = sorted(docs, reverse=True)
    out = {r.doc_id: r for r in merkle.compare_with_edit(documents).collect()}
    by_text: dict = {}
    for k, i in enumerate(order):
        text, after = docs[i], docs[order[(k + 1) % len(order)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(text)
        assert (out[i].fingerprint == out[i].edited_fingerprint) == (text == edited)
        assert 0 <= out[i].near_next <= 1 and 0 <= out[i].near_edited <= 1
        by_text.setdefault(text, set()).add(out[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    assert sum(r.near_edited for r in out.values()) > 0.5 * len(out) > 25 * sum(r.near_next for r in out.values())
    assert merkle.compare_with_edit(odd).count() == 9 and merkle.compare_with_edit(empty).count() == 0


def bag(text: str) -> Counter:
    """Sentences as the fingerprint cuts them, by hand: after a stop that white space follows."""
    return Counter(x for line in text.split("\n") for x in re.split(r"(?<=[.!?…;:])(?=\s)", line) if x)


def by_hand(a: str, b: str) -> float:
    x, y = bag(a), bag(b)
    size = lambda c: sum(len(k) * n for k, n in c.items())
    return 2 * size(x & y) / (size(x) + size(y)) if x or y else 1.0


def test_likeness_by_brute_force(spark, documents):
    """Bags of sentences by their lengths, on documents and on texts that repeat one sentence; branches hold what the text lacks."""
    docs = {r.doc_id: r.text for r in documents.collect()}
    for k, text in enumerate(["Same one. " * 200, "Same one.", "Same one. " * 7 + "x" * 70_000, "", "a\n" * 9]):
        docs[10_000 + k] = text
    order = sorted(docs, reverse=True)
    for r in merkle.compare_with_edit(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect():
        text, after = docs[r.doc_id], docs[order[(order.index(r.doc_id) + 1) % len(order)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert abs(r.near_next - by_hand(text, after)) < 1e-9 and abs(r.near_edited - by_hand(text, edited)) < 1e-9
        paragraphs = {tuple(re.split(r"(?<=[.!?…;:])(?=\s)", x)) for x in text.split("\n")}
        assert r.edited_paragraph_list == [i for i, x in enumerate(edited.split("\n")) if tuple(re.split(r"(?<=[.!?…;:])(?=\s)", x)) not in paragraphs]
        assert bool(r.edited_section_list) >= bool(r.edited_paragraph_list)


def test_merkle_locates_an_edit(spark):
    """A changed line is one paragraph of one section; a line put in at the top changes no section but the first."""
    a = "\n".join(f"Line {i} stays. It has two sentences." for i in range(60))
    for b, p in ((a.replace("Line 9 stays", "Line 9 goes"), [9]), ("New line.\n" + a, [0])):
        one = merkle.with_tree(merkle.with_tree(spark.createDataFrame([(a, b)], "a string, b string"), "a", "a_"), "b", "b_").withColumn("s", merkle.differing(F.col("a_sections"), F.col("b_sections")))
        got = one.select("s", F.size("b_sections").alias("n"), merkle.differing_paragraphs(F.col("s"), F.col("b_ends"), F.col("b_paragraphs"), F.col("a_paragraphs")).alias("p"), merkle.likeness(F.col("a_leaves"), F.col("b_leaves")).alias("l")).first()
        assert got.p == p and len(got.s) <= 2 < got.n and 0.9 < got.l < 1


def simple_fingerprint(text: str) -> int:
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(documents, odd, empty):
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    prints = {i: simple_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    for r in simhash.near_duplicates(documents).collect():
        assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == find(r.doc_id)
    assert simhash.near_duplicates(odd).count() == 9 and simhash.near_duplicates(empty).count() == 0
    assert simhash.near_copies(odd).count() == 8 and simhash.near_copies(empty).count() == 0
    assert simhash.keep_first(odd).columns == odd.columns


def test_links_do_not_broadcast_cells(spark):
    """The cells of points that are small enough to be broadcast are not: they are some thirty times as many."""
    points = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(points)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = [x for x in plan[k + 1 : k + 1 + next((i for i, x in enumerate(plan[k + 1 :]) if depth(x) <= depth(line)), len(plan))]]
            assert any("HashAggregate" in x for x in below), "only hot cells, which are counted, are broadcast"


@pytest.mark.parametrize(("block", "visited"), [(4, 16), (256, 16), (8, 1), (30, 1)])
def test_links_connect_as_all_pairs_do(spark, block, visited, monkeypatch):
    """Chains and balls around common centres; small blocks deal cells out, those of few homes and many visitors too."""
    monkeypatch.setattr(simhash, "VISITED", visited)
    r = random.Random(block)
    centres = [r.getrandbits(64) for _ in range(6)]
    points = set()
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(12)
            points.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(spark.createDataFrame([(signed(x),) for x in points], "fp long"), block=block).collect()
    edges = [(a, b) for a in points for b in points if a < b and (a ^ b).bit_count() <= 3]
    assert {(x.u % (1 << 64) ^ x.v % (1 << 64)).bit_count() <= 3 for x in found} <= {True}

    def groups(pairs):
        root = {p: p for p in points}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(p for p in points if find(p) == q) for q in {find(p) for p in points}}

    assert groups([(x.u % (1 << 64), x.v % (1 << 64)) for x in found]) == groups(edges)


def test_near_copies(spark, monkeypatch):
    """Planted near copies of short and long texts, groups of them, exact copies and a line that all share, against all pairs."""
    monkeypatch.setattr(keys, "BLOCK", 8)
    monkeypatch.setattr(keys, "LOOKED_AT", 1)
    monkeypatch.setattr(simhash, "COPIES", 3)
    r = random.Random(4)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 7)))
    rows = []
    for size in (1, 4, 6, 12, 30, 80, 150, 170, 300, 900, 3000):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, size // 120, size // 60, size // 40, size // 25):
                words = list(base)
                for _ in range(edits):
                    words[r.randrange(len(words))] = word()
                rows.append((len(rows), "this line stands in each of the texts " + " ".join(words)))
    r.shuffle(rows)
    rows += [(None, rows[0][1]), (5000, None), (5001, ""), (5002, " ")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if i is not None and (w := WORD.findall((t or "").lower()) or [""])}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += 1
                if find(i) != find(j):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs).collect()}
    assert links > 150 and got == {i: find(i) for i in sets}
    left = [x.doc_id for x in simhash.keep_first(docs).collect()]
    assert sorted(x for x in left if x is not None) == sorted({find(i) for i in sets}) and left.count(None) == 1


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(r: random.Random, text: str, k: int) -> str:
    s = list(text)
    for _ in range(k):
        at = r.randrange(len(s)) if s else 0
        match r.choice("isd"):
            case "i":
                s.insert(at, r.choice("abcé"))
            case "d" if s:
                s.pop(at)
            case "s" if s:
                s[at] = r.choice("abcé")
    return "".join(s)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    r = random.Random(most)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(400)]
    for x in spark.createDataFrame([(a, mutate(r, a, 4) if k % 2 else b) for k, (a, b) in enumerate(zip(texts, texts[1:]))], "a string, b string").select(
        "a", "b", lines.banded_distance(F.col("a"), F.col("b"), most, words=True).alias("d"), lines.word_distance(F.col("a"), F.col("b"), F.lit(most)).alias("e")
    ).collect():
        d = distance(x.a.split(" "), x.b.split(" "))
        assert x.e == (d if d <= most else None)
        assert x.d == x.e or min(x.a.count(" "), x.b.count(" ")) < most + 1
    pairs = [(a, mutate(r, a, r.randint(0, 5))) for a in ("".join(r.choice("abcé") for _ in range(r.randint(0, 30))) for _ in range(400))]
    for x in spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.banded_distance(F.col("a"), F.col("b"), most).alias("d")).collect():
        d = distance(x.a, x.b)
        assert x.d == (d if d <= most else None)


def alike(x: str, y: str, edits=lambda n: n // 20 if n >= 20 else 0) -> bool:
    """The rule of two different lines: by words if both have 13 or more, else by characters."""
    v, w = x.split(" "), y.split(" ")
    if min(len(v), len(w)) < 13:
        most = edits(min(len(x), len(y)))
        return abs(len(x) - len(y)) <= most and 0 < most and distance(x, y) <= most
    most = max(1, min(len(v), len(w)) // 20)
    return abs(len(v) - len(w)) <= most and distance(v, w) <= most


def held_against(got: dict, docs: list[tuple[int, str]], **rule) -> int:
    seen: dict[str, None] = {}
    total = 0
    for i, text in docs:
        left, equal, similar = [], 0, 0
        for line in text.split("\n"):
            key = line.strip()
            if len(key) < 20:
                left.append(line)
                continue
            before = list(seen)[: list(seen).index(key)] if key in seen else seen
            if any(alike(x, key, **rule) for x in before):
                similar += 1
            elif key in seen:
                equal += 1
            else:
                left.append(line)
            seen.setdefault(key)
        assert got[i] == ("\n".join(left), equal, similar), i
        total += similar
    return total


def test_line_dedup(spark):
    r = random.Random(3)
    base = ["".join(r.choice("etaoin bcd") for _ in range(r.randint(15, 70))).strip() for _ in range(50)]
    docs = [(i, "\n".join(mutate(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randint(0, 5)))) for i in range(120)]
    got = {x.doc_id: (x.text, x.n_equal, x.n_similar) for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), tolerance=((20, 1), (40, 2))).collect()}
    assert held_against(got, docs, edits=lambda n: 2 if n >= 40 else 1 if n >= 20 else 0) > 20


def test_no_table_is_left(spark, documents, tmp_path):
    """But for what the returned frames read."""
    import os

    from tessella.llm import scratch, secrets

    folder = scratch.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = lines.dedup_lines(documents)
    kept = simhash.keep_first(documents)
    secrets.train(spark)
    names = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if not os.path.isdir(f"{folder}/{x}") or "-" in x}
    named = {x for x in names if x in ("hot-keys", "copy-pairs", "copy-ends", "copy-sets", "forest", "line-pairs", "wanted-places", "wanted-lines", "similar-lines", "first-lines", "copy-classes", "copy-links")}
    assert not named and out.count() == 200 and kept.count() > 100


def test_line_dedup_across_the_rules(spark):
    """Lines of 9 to 18 words with typing errors, spaces put in and left out, and words left out: those of 13 words meet those of 12."""
    r = random.Random(12)
    texts = []
    for size in range(9, 17):
        for longest in (6, 12):
            base = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, longest))) for _ in range(size))
            for _ in range(7):
                line = list(base)
                for _ in range(r.randint(0, 4)):
                    at = r.randrange(1, len(line) - 1)
                    line[at : at + r.choice([0, 1, 1])] = r.choice([[" "], [" "], [], ["x"]])
                texts.append(" ".join("".join(line).split()))
            texts.append(base.rsplit(" ", 1)[0])
    docs = list(enumerate(texts))
    across = sum(alike(x, y) and (len(x.split(" ")) < 13) != (len(y.split(" ")) < 13) for i, x in enumerate(texts) for y in texts[:i])
    got = {x.doc_id: (x.text, x.n_equal, x.n_similar) for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert across > 10 and held_against(got, docs) > 20


@pytest.mark.parametrize("kind", ["prose", "few endings", "one word", "long words"])
def test_line_dedup_by_words(spark, kind, monkeypatch):
    """Lines of 12 to 130 words with up to 8 % of their words changed, put in or left out; keys of four lines and more are dealt out in blocks."""
    monkeypatch.setattr(keys, "BLOCK", 4)
    monkeypatch.setattr(keys, "LOOKED_AT", 1)
    r = random.Random(len(kind))
    letters = {"prose": "etaoinshrdlué,", "few endings": "aou", "one word": "x", "long words": "etaoinshrdlu"}[kind]
    word = lambda: "".join(r.choice(letters) for _ in range(1 if kind == "one word" else r.randint(11, 40) if kind == "long words" else r.randint(1, 6)))
    texts = []
    for size in (12, 13, 14, 19, 20, 25, 39, 40, 41, 59, 60, 79, 80, 81, 100, 130):
        base = [word() for _ in range(size)]
        for share in (0, 0, 0.02, 0.04, 0.05, 0.05, 0.06, 0.08):
            words = list(base)
            for _ in range(round(size * share)):
                at = r.randrange(len(words))
                words[at : at + r.choice([0, 1, 1])] = [word() for _ in range(r.choice([0, 1, 1]))]
            texts.append(" ".join(words))
    docs = list(enumerate(texts))
    got = {x.doc_id: (x.text, x.n_equal, x.n_similar) for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert held_against(got, docs) > 20


def test_line_dedup_of_odd_rows(odd, empty):
    out = lines.dedup_lines(odd)
    assert set(odd.columns) <= set(out.columns) and out.count() == 9 and lines.dedup_lines(empty).count() == 0
    twice = [r for r in out.collect() if r.doc_id == 1 and r.text.startswith("One")]
    assert [r.text for r in twice] == ["One fine day the fox met the hound in the wood."] * 2


def test_tolerance_follows_the_length(spark):
    """Near copies of lines of 20 to 900 characters and fewer than 13 words at up to 7 % edits, against all pairs at 5 %."""
    r = random.Random(8)
    word = lambda k: "".join(r.choice("etaoinshrdlué") for _ in range(k))
    docs = []
    for size in (20, 39, 40, 59, 60, 62, 79, 100, 199, 200, 205, 210, 380, 420, 640):
        for _ in range(2):
            line = " ".join(word(max(2, size // 9)) for _ in range(8))[:size].ljust(size, "e")
            docs += [line, *(mutate(r, line, round(size * share)).strip() for share in (0.02, 0.045, 0.05, 0.07))]
    docs = list(enumerate(docs))
    got = {x.doc_id: (x.text, x.n_equal, x.n_similar) for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert held_against(got, docs) > 60


def test_short_lines_of_the_query_and_the_pipeline(spark, tmp_path):
    """Equal lines go however short they are; lines without a word stay."""
    import corpus_pipeline
    from tessella.llm import queries

    docs = spark.createDataFrame([(1, "Head.\n\nOne."), (2, "Head.\n\nTwo."), (3, "Head.")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: (r.n_equal, r.n_chars_left) for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {1: (0, 11), 2: (1, 5), 3: (1, 0)}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1: "Head.\n\nOne.", 2: "\nTwo."}


def test_lines_beyond_the_tolerance_do_not_meet(spark, monkeypatch):
    """Lines of 100 words, each with four words of a common text replaced: eight edits lie between most, beyond the five allowed, so they must not be paired one and all."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7)))
    base, texts, met = [word() for _ in range(100)], [], []
    for _ in range(40):
        words = list(base)
        for at in r.sample(range(100), 4):
            words[at] = word()
        texts.append(" ".join(words))
    own = lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: met.append(own(df, name)) or met[-1].persist().count() and met[-1] if name == "line-pairs" else own(df, name))
    docs = list(enumerate(texts))
    got = {x.doc_id: (x.text, x.n_equal, x.n_similar) for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    held_against(got, docs)
    assert met[0].count() < 40 * 39 // 2 // 10


def test_a_group_of_near_copies_does_not_meet_one_and_all(spark, monkeypatch):
    """Copies of a line of 50 words with one word replaced, all within the tolerance of each other, in keys that are dealt out: each meets the earliest, not all others."""
    for name, value in (("BLOCK", 4), ("LOOKED_AT", 1)):
        monkeypatch.setattr(keys, name, value)
    monkeypatch.setattr(lines, "PIVOTS", 2)
    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7)))
    base, texts, met = [word() for _ in range(50)], [], {}
    for _ in range(60):
        words = list(base)
        words[r.randrange(50)] = word()
        texts.append(" ".join(words))
    own = lines.written

    def counted(df, name):
        table = own(df, name)
        met[name] = met.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(lines, "written", counted)
    docs = list(enumerate(texts))
    got = {x.doc_id: (x.text, x.n_equal, x.n_similar) for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert held_against(got, docs) > 50
    assert met.get("pivot-pairs", 0) + met["line-pairs"] < 60 * 59 // 2 // 3
