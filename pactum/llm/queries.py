"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import chat, langid, lattice, minhash, mtree, packing, pii, quality, sql, tokenfile, warc
from pactum.llm.common import materialize, table


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT page_id, payload, n, max(page_id) OVER (PARTITION BY payload) AS largest FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM g
"""

def byte_bpe() -> str:
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe(), end_id=0).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(langid.training_rows(docs))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM e AS q, e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: A conversation whose texts hold the template's own marks.
MARKED = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    formatted = materialize(chat.format_turns(rows.unionByName(marked), byte_bpe()), "formatted")
    return chat.read_back(formatted, byte_bpe())


def piece_bpe() -> str:
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_bpe())
    read = lattice.decode(encoded, piece_bpe())
    return read.select("doc_id", "sample", "n_pieces", "log_prob", "inclusion", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), n AS (
  SELECT *, len(regexp_extract_all(text, '###[ \t\r\n]*(?:System|User|Assistant|Tool|Role)|</turn>')) AS marks,
         len(regexp_extract_all(role, '###[ \t\r\n]*(?:System|User|Assistant|Tool|Role)|</turn>')) AS role_marks
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 WHEN 'tool' THEN 10
                ELSE 11 + length(role) + role_marks END + length(text) + marks + 9) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

QUERIES = {
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat_format": op4_chat_format,
    "op6_exact_top_k": op6_exact_top_k,
    "op5_pii": op5_pii,
    "op2_language_id": op2_language_id,
    "op9_minhash": op9_minhash,
    "op1_packing": op1_packing,
    "op10_token_file": op10_token_file, "op7_quality_rules": op7_quality_rules, "op8_warc": op8_warc}
SQL = {"op7_quality_rules": sql.OP7, "op9_minhash": sql.OP9, "op4_chat_format": OP4_SQL, "op6_exact_top_k": OP6_SQL, "op8_warc": OP8_SQL}
