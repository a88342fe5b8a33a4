"""The pipeline's stages, one upon another, against plain Python where that is short."""

from __future__ import annotations

import pytest

pytest.importorskip("tessella.llm")
pytest.importorskip("corpus_pipeline")
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, tmp_path):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == documents.columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
            assert docs.filter("n_chars <> length(text)").count() == 0
    names, counts = zip(*kept, strict=True)
    assert names == ("quality rules", "line dedup", "SimHash near-dedup", "secret scan", "packing")
    assert 200 > counts[0] >= counts[1] >= counts[2] == counts[3] > 100
    whole = docs.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert len(whole) == counts[3] and all(r["sum(length)"] == r.doc_tokens for r in whole)


def test_clean_documents_stay(spark, documents):
    """Labelled good, of ten words and more, without copies: none is lost before near-dedup."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    unique = documents.groupBy("text").agg({"doc_id": "min", "*": "count"}).toDF("text", "doc_id", "n").filter("n = 1 and size(split(text, '\\\\s+')) >= 10")
    good = {r.doc_id for r in unique.join(labels, "doc_id").select("doc_id").collect()}
    out = corpus_pipeline.line_dedup(spark, corpus_pipeline.quality_rules(spark, documents, SF), SF)
    left = {r.doc_id for r in out.select("doc_id").collect()}
    assert len(good - left) <= 0.1 * len(good)


#: Names that operators use inside, or give to what they add.
NAMES = """row t d b hit gone at h1 h2 kept clean_text n_words _words _lines lost_chars n_lines n_equal n_similar first_docs scan digest secrets redacted_text n_candidates same fp keys root least first
component_id _next _bucket _tie _part _hot n_tokens ids_sha256 decoded_sha256 n_bytes over_limit line words k no key doc part start ids base word_chars base_failed""".split()


@pytest.fixture(scope="module")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.drop("_next", "n").select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce("source", F.lit("none"))).alias(c) for c in NAMES), F.length("text").cast("long").alias("n_chars"), F.lit("a").alias("a b.c"))


def test_columns_of_any_name(spark, clashing):
    """Operators keep what they don't replace, whatever it is called; what they replace their docstrings name."""
    import public_tokenizers

    from tessella.llm import bpe, lines, merkle, packing, quality, secrets, simhash, token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = clashing.drop("a b.c")
    made = {
        "quality": quality.judge(plain), "lines": lines.dedup_lines(plain), "scan": secrets.scan(plain, []), "bpe": bpe.encode_digests(plain, path), "counts": token_counts.count_tokens(plain, path), "near": simhash.keep_first(clashing),
    }
    added = {
        "quality": {"clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept"}, "lines": {"text", "n_lines", "n_equal", "n_similar", "first_docs"},
        "scan": {"n_candidates", "secrets", "redacted_text"}, "bpe": {"n_tokens", "ids_sha256", "decoded_sha256"}, "counts": {"n_bytes", "n_tokens", "over_limit"}, "near": set(),
    }
    for name, out in made.items():
        same = [c for c in plain.columns if c not in added[name]]
        rows = out.select(*same).collect()
        assert set(plain.columns) | added[name] <= set(out.columns), name
        assert name == "near" or sorted(map(str, rows)) == sorted(map(str, plain.select(*same).collect())), name
    assert merkle.compare_with_edit(clashing).count() == 9
    assert packing.pack(clashing, public_tokenizers.path("word_bpe_49k.json")).select("doc_id").count() >= 9


@pytest.mark.parametrize("kind", ["clashing", "odd", "empty"])
def test_stages_on_odd_tables(spark, request, kind, tmp_path):
    """Every stage takes the table that the one before left, whatever else it holds; none crashes on odd rows or on none."""
    docs = request.getfixturevalue(kind)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "packing" or docs.columns == columns
        if name == "quality rules" and kind == "clashing":
            assert docs.count() > 0 and docs.filter("kept not like 'kept of %' or `a b.c` <> 'a'").count() == 0
    assert docs.count() == 0 if kind == "empty" else docs.count() > 0
