"""Secret scans: patterns propose candidates, a random forest rejects the false ones.

The forest sees a candidate's length, character transitions and dictionary coverage, the document's path and the neighbouring
words. pyspark.ml trains it on labelled findings (at most FINDINGS of them); its trees, a few thousand numbers, then go with the
scoring function, so a scan is one pass over the texts without a shuffle: scan -> Arrow -> project.

What is no candidate can't be found. Candidates are runs of 16 key-like characters or more; values of 8 characters or more that are assigned to a
secret's name, of which at most 40 characters may follow before the = or :; words of 8 or more after "bearer"; passwords of at most 200 characters
in URLs whose login has at most 200; and private key blocks of any length.
"""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.scratch import remove, shared_dir

#: Labelled findings that the forest is fitted on, at most.
FINDINGS = 4000
TREES, DEPTH, SEED = 25, 6, 11
PLACEHOLDER = "[secret]"

#: Runs of key-like characters, values that are assigned to a name, and private key blocks.
TOKENS = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}(?![A-Za-z0-9+/_\-])")
NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credential)s?"
ASSIGNED = re.compile(rf"(?i){NAME}[A-Za-z0-9_.\-]{{0,40}}[\"']?\s*[:=]\s*[\"']?(?:(?:bearer|basic)\s+)?([^\s\"',;]{{8,}})")
BEARER = re.compile(r"(?i)\bbearer\s+[\"']?([^\s\"',;]{8,})")
LOGIN = re.compile(r"://[^\s/:@\"'<>]{0,200}:([^\s/\"'<>]{1,200})@")
NAMED = re.compile(NAME, re.I)
BLOCKS = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----BEGIN).)*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)

# Names that secrets or harmless digests are given, prefixes that issuers use, paths of tests, frequent words.
NAMES = "token secret password passwd pwd passphrase apikey api_key api-key access_key accesskey auth authorization bearer credential credentials private key client_secret signing".split()
HARMLESS = "sha sha1 sha256 md5 checksum digest hash commit revision rev etag uuid guid id isbn doi integrity version url http https example sample dummy placeholder test phone card invoice order".split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "ya29.", "eyJ", "glpat-", "npm_", "SG.")
PATHS = ("test", "example", "sample", "mock", "fixture", "docs", "readme")
WORDS = (
    "about access account action address after again against all also and any application array back base before begin between block body book button call change character check class client code color command common component config connect content control copy count create "
    "current data date default define delete description device display document element end error event example extend false field file filter find first float font form format from function general get global group handle have header help home html icon image import index "
    "info input integer interface item label language last length level line link list local login long main make manager map menu message method model module more name network new next node none normal null number object option order other output page parent part path "
    "pattern person place point position process product program project property public query range read record request resource response result return right root sample save screen search section select server service session set settings show simple size software source "
    "start state static status step stop store string style system table target template test text that the this time title type under unit update user value variable version view web width window with word work world write your"
).split()
_BY_LENGTH: dict[int, frozenset[str]] = {n: frozenset(w for w in WORDS if len(w) == n) for n in range(4, 13)}

FEATURES = (
    "length", "entropy", "digits", "uppers", "symbols", "class_changes", "hex_only", "digits_only", "repeats", "vowels", "english_pairs", "dictionary", "known_prefix", "dashes_as_uuid", "quoted",
    "assigned", "named_secret", "named_harmless", "words_before", "prose_after", "test_path",
)
#: Letter pairs that are frequent in English (fixed values).
PAIRS = frozenset("th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur".split())
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")


def candidates(text: str) -> list[tuple[int, int]]:
    """Places, from start to end, that may hold a secret; they don't overlap and stand in the text's order."""
    found = [m.span() for m in BLOCKS.finditer(text)]
    found += [m.span(1) for pattern in (ASSIGNED, BEARER, LOGIN) for m in pattern.finditer(text)]
    found += [m.span() for m in TOKENS.finditer(text) if any(c.isdigit() for c in m[0]) or m[0].startswith(PREFIXES) or NAMED.search(text, max(0, m.start() - 40), m.start())]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def covered(value: str) -> float:
    """The share of a candidate's characters that dictionary words cover, longest first from each place."""
    low, n, at = value.lower(), 0, 0
    while at < len(low):
        size = next((k for k in range(12, 3, -1) if low[at : at + k] in _BY_LENGTH[k]), 0)
        n += size
        at += size or 1
    return n / max(1, len(low))


def features(value: str, before: str, after: str, path: str) -> list[float]:
    n = max(1, len(value))
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    shares = Counter(value)
    letters = [c for c in value.lower() if c.isalpha()]
    pairs = [a + b for a, b in zip(value.lower(), value.lower()[1:], strict=False)]
    names = re.findall(r"[a-z][a-z0-9_\-]*", before[-40:].lower())[-4:]
    return [
        float(len(value)),
        -sum(x / n * math.log2(x / n) for x in shares.values()),
        kind.count("d") / n,
        kind.count("u") / n,
        kind.count("s") / n,
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n,
        float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None),
        float(value.isdigit()),
        sum(a == b for a, b in zip(value, value[1:], strict=False)) / n,
        sum(c in "aeiou" for c in letters) / max(1, len(letters)),
        sum(p in PAIRS for p in pairs) / max(1, len(pairs)),
        covered(value),
        float(value.startswith(PREFIXES) or value.startswith("-----BEGIN")),
        float(_UUID.fullmatch(value) is not None),
        float(before[-1:] in ("\"", "'") and before[-1:] != ""),
        float(re.search(r"[:=]\s*[\"']?$", before) is not None),
        float(any(x in NAMES or x.endswith(("_key", "_token", "_secret", "_password")) for x in names)),
        float(any(x in HARMLESS for x in names)),
        float(len(names)),
        float(re.match(r"[\"']?[.,;)]?\s+[a-z]", after) is not None),
        float(any(p in path.lower() for p in PATHS)),
    ]


def seed_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, before, after, path, label) for a corpus that brings none, as reviewers label them: random keys that
    are assigned to secret names or carry an issuer's prefix are secrets; digests, ids, numbers, names in prose and
    placeholders are not."""
    r = random.Random(seed)
    alpha = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    make = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    prose = lambda k: " ".join(make("etaoinshrdlu", r.randint(2, 9)) for _ in range(k))
    words = lambda k, glue: glue.join(r.choice(WORDS) for _ in range(k))
    quote, sep = lambda: r.choice(["\"", "'", ""]), lambda: r.choice([" = ", "=", ": ", ":"])
    out = []
    for k in range(n):
        path = r.choice(["src", "app/config", "src7", "deploy/env", "lib"])
        q = quote()
        case = r.choice([str.lower, str.upper, str])
        if k % 2:
            name = r.choice(["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "passwd", "Bearer", "private_key"])
            value = r.choice([make("0123456789abcdef", r.choice([32, 40, 64])), make("0123456789ABCDEF", 40), make(alpha, r.randint(16, 64)), make(alpha + "+/", 40), r.choice(PREFIXES[:9]) + make(alpha, r.randint(20, 36)), make(alpha + "!@#$%", r.randint(8, 18))])
            out.append((value, f"{prose(r.randint(0, 6))} {case(name)}{sep()}{q}", f"{q} {prose(3)}", path, 1))
        else:
            value, name = r.choice([
                (make("0123456789abcdef", r.choice([32, 40, 64])), r.choice(["sha256", "md5", "commit", "checksum", "etag", "digest"])),
                ("-".join(make("0123456789abcdef", j) for j in (8, 4, 4, 4, 12)), r.choice(["id", "uuid", "guid", "request"])),
                (make("0123456789", r.choice([16, 18, 20])), r.choice(["", "card", "order", "phone", "id"])),
                (words(r.randint(2, 4), r.choice(["_", "-", "/", ""])) + make("0123456789", r.randint(1, 2)), r.choice(["", "see", "file", "token", "password"])),
                (prose(1) * 3 + make("0123456789", 2), ""),
                (r.choice(["your-api-key-here-0", "changeme123", "xxxxxxxxxxxxxxxx1", "example_password1", "1234567890123456", "0000000000000000"]), r.choice(["password", "token", "example", "api_key"])),
                (words(3, "/") + "/" + make("0123456789", 4), r.choice(["url", "path", "http"])),
            ])
            out.append((value, f"{prose(r.randint(0, 6))} {name}{sep() if name and r.random() < 0.7 else ' '}{q}", f"{q} {prose(3)}", r.choice([path, "tests/data", "docs/readme", path]), 0))
    return out


Tree = list[tuple[int, float, int, int, float]]  # (feature or -1, threshold, left, right, vote)


def _trees(spark: SparkSession, model) -> list[Tree]:
    """The trees of a fitted forest as tables of nodes, from the table that the model saves of itself; a node's number is its place."""
    path = f"{shared_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # a few thousand
    remove(spark, path)
    out: list[Tree] = [[] for _ in range(TREES)]
    for n in nodes:
        leaf = n.leftChild < 0
        out[n.treeID].append((-1, 0.0, 0, 0, n.prediction) if leaf else (n.split.featureIndex, n.split.leftCategoriesOrThreshold[0], n.leftChild, n.rightChild, 0.0))
    return out


def train(spark: SparkSession, findings: DataFrame | None = None, most: int = FINDINGS) -> list[Tree]:
    """A forest from labelled findings(value, before, after, path, label); without any, from seed_findings()."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = [tuple(r) for r in findings.select("value", "before", "after", "path", "label").orderBy(F.xxhash64("value", "before"), "value", "before", "after", "path", "label").limit(most).collect()] if findings is not None else seed_findings(most)
    data = spark.createDataFrame([(features(v or "", b or "", a or "", p or ""), float(y)) for v, b, a, p, y in rows], "x array<double>, label double")
    # Few cases and continuous features only: as many bins as keep the thresholds that reviewers would draw.
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, featuresCol="features").fit(data.select(array_to_vector("x").alias("features"), "label").coalesce(2))
    return _trees(spark, model)


def votes(forest: list[Tree], x: list[float]) -> float:
    """The share of trees that call it a secret."""
    n = 0.0
    for tree in forest:
        k = 0
        while tree[k][0] >= 0:
            k = tree[k][2] if x[tree[k][0]] <= tree[k][1] else tree[k][3]
        n += tree[k][4]
    return n / max(1, len(forest))


def scan_text(text: str, path: str, forest: list[Tree]) -> list[tuple[int, int, float]]:
    """(start, end, votes) of each candidate."""
    return [(a, b, votes(forest, features(text[a:b], text[max(0, a - 80) : a], text[b : b + 40], path))) for a, b in candidates(text)]


def scan(docs: DataFrame, forest: list[Tree], text_col: str = "text", path_col: str = "source", least: float = 0.5) -> DataFrame:
    """docs with n_candidates, secrets (array of start, length, votes: candidates with at least that share of votes) and redacted_text.

    A null text is scanned as empty and stays null; a null or missing path tells nothing. Rows are neither dropped nor merged.
    Columns of docs with the new names are replaced."""

    @F.pandas_udf("n_candidates int, secrets array<struct<start:int,length:int,votes:double>>, redacted_text string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, paths in batches:
            rows = []
            for text, path in zip(texts, paths, strict=True):
                found = scan_text(text, path or "", forest) if text else []
                bad = [(a, b, v) for a, b, v in found if v >= least]
                at, parts = 0, []
                for a, b, _ in bad:
                    parts += [text[at:a], PLACEHOLDER]
                    at = b
                rows.append((len(found), [{"start": a, "length": b - a, "votes": v} for a, b, v in bad], "".join([*parts, text[at:]]) if bad else text))
            yield pd.DataFrame(rows, columns=["n_candidates", "secrets", "redacted_text"]).astype({"n_candidates": np.int32})

    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    new = ("n_candidates", "secrets", "redacted_text")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    out = docs.select(F.struct(*others).alias("row"), run(F.col(f"`{text_col}`").cast("string"), F.coalesce(path, F.lit(""))).alias("scan"))
    return out.select("row.*", *(f"scan.{c}" for c in new))
