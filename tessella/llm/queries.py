"""One query per operator, over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import html

    return html.extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import merkle

    compared = merkle.compare_with_edit(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return compared.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_section_list", "edited_paragraph_list")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import packing

    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", packing.crc32_of(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import quality

    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import bpe

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, tokenizer("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import secrets

    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), secrets.train(spark))
    return found.select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), "secrets", F.sha2("redacted_text", 256).alias("redacted_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import token_counts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import chat

    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import lines

    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)
    return out.select("doc_id", "n_lines", "n_equal", "n_similar", "first_docs", F.length("text").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import vectors
    from tessella.llm.scratch import written

    table = _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = vectors.fit(table)
    coded = written(vectors.encode(table, books).drop("embedding"), "codes")  # the result reads it twice
    return vectors.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import language

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import middle

    made = middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_ALL = (op1_main_text, op2_merkle_fingerprints, op3_packing, op4_quality_rules, op5_bpe, op6_secret_scan, op7_simhash, op8_token_counts, op9_chat_format, op10_line_dedup, op11_vector_codes, op12_language_id, op13_fill_in_middle)
QUERIES = {f.__name__: f for f in _ALL}



def _quality_sql() -> str:
    """op4 in DuckDB's SQL, by the rules' own patterns."""
    from tessella.llm import quality as q

    text = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    gap, word = text(q.WORD_GAP), text(q.WORD)
    gaps = f"len(regexp_extract_all(l, {gap})) + 1"
    fails = (
        f"regexp_matches(l, {text(q.BOILERPLATE)}) OR len(regexp_extract_all(l, {text(q.NOISE)})) * 2 > {gaps} OR regexp_matches(l, {text(q.TRAIL)}) OR regexp_matches(l, {text(q.MENU)}) "
        f"OR (NOT regexp_matches(l, {text(q.CLOSED)}) AND {gaps} >= 3)"
    )
    chars = lambda x: f"length(regexp_replace({x}, {gap}, '', 'g'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, {gap}), lambda x: x <> '') AS w, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT k, i, w[i:i + 4] AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
v AS (SELECT k, count(DISTINCT p) AS n FROM r, unnest(range(i, i + 5)) AS u(p) GROUP BY k),
m AS (SELECT w.k, doc_id, len(w) AS n_words, {chars('t')} AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(ls, lambda l: regexp_matches(l, {word}))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, {word})))) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
  {chars(f"array_to_string(list_filter(ls, lambda l: NOT regexp_matches(l, {word}) OR NOT ({fails})), chr(10))")} AS left_chars FROM w LEFT JOIN v ON v.k = w.k),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars - left_chars <= 0.5 * word_chars AS kept FROM b"""


def _vectors_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """op11 in DuckDB's SQL: every part against every entry."""
    near = """{name} AS (SELECT k, p, arg_min(i, (d, i)) AS i, min(d) AS d FROM (SELECT x.k, x.p, b.i, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN {book} b ON x.p = b.p) GROUP BY 1, 2)"""
    steps = []
    for r in range(rounds):
        steps.append(near.format(name=f"n{r}", book=f"b{r}"))
        steps.append(
            f"""s{r} AS (SELECT p, i, list(m ORDER BY j) AS v FROM (SELECT p, i, j, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS m
  FROM (SELECT x.p, n.i, generate_subscripts(x.v, 1) AS j, unnest(x.v) AS c FROM x JOIN n{r} n ON x.k = n.k AND x.p = n.p) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS (SELECT b.p, b.i, coalesce(s.v, b.v) AS v FROM b{r} b LEFT JOIN s{r} s ON s.p = b.p AND s.i = b.i)"""
        )
    steps.append(near.format(name="last", book=f"b{rounds}"))
    return f"""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT k, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM e, unnest(range({parts})) AS u(p)),
b0 AS (SELECT p, k AS i, v FROM x WHERE k < {entries}),
{', '.join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) AS h FROM b{rounds}),
c AS (SELECT k, string_agg(format('{{:02x}}', i), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN e USING (k), h"""


def _middle_sql() -> str:
    """op13 in DuckDB's SQL: lists of tokens."""
    draw = lambda k: f"CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * k + 1}, 8) AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w, {', '.join(f'{draw(k)} AS h{k + 1}' for k in range(4))} FROM documents),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM d),
p AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


ORACLE_SQL: dict[str, str] = {"op4_quality_rules": _quality_sql(), "op11_vector_codes": _vectors_sql(), "op13_fill_in_middle": _middle_sql()}
