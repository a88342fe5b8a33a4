"""Documents to packed sequences, stage by stage; each stage's result is written as Parquet and read by the next.

Every stage but the last takes and returns the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import lines, packing, quality, secrets, simhash
from tessella.llm.queries import tokenizer
from tessella.llm.scratch import discard, written


def _packed(docs: DataFrame) -> DataFrame:
    """The row in one struct beside text, source and doc_id, so that no column's name can clash with what an operator adds."""
    own = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    return docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _unpacked(docs: DataFrame, text: str) -> list[Column]:
    """The columns of docs from the packed row, with another text and its length."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines.

    A generator of one row or none takes the place of a filter: the optimizer would compute the rules once more to filter first."""
    judged = quality.judge(_packed(docs))
    return judged.select(F.inline(F.when(F.col("kept"), F.array(F.struct(*_unpacked(docs, "clean_text"))))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or an earlier place, has; a document goes once no word is left."""
    return lines.dedup_lines(_packed(docs), min_chars=1).filter(F.col("text").rlike(quality.WORD)).select(*_unpacked(docs, "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return simhash.keep_first(_packed(docs)).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder in place of each secret."""
    return secrets.scan(_packed(docs), secrets.train(spark)).select(*_unpacked(docs, "redacted_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("secret scan", secret_scan), ("packing", pack)]

#: The stages' forest, tokenizer and edit join have no SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)  # has written what it read
    discard(docs)
    return packed
