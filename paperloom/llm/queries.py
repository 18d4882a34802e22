"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import byte_bpe, exact_dedup, golay, licenses, packing, pii, topk, toxicity, warc, wrappers
from paperloom.sources.tables import read_table, spread

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
#: A key for tables without personal data of real people; a deployment passes its own secret.
PSEUDONYM_KEY = "paperloom-demonstration-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, name))


def op1_external_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(_table(spark, sf_dir, "pages"), minimum_revisit_size=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "place", "history_no")


def op2_sentence_rule_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicate_groups(_table(spark, sf_dir, "documents"), width=4, most=4)


def op6_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), capacity=2048, end_id=0)


def op7_skew_safe_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonym_report(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op9_term_at_a_time_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", topk.floor_weights(F.col("embedding")).alias("weights"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, w FROM v WHERE vec_id % 50 = 0), s AS (
  SELECT q.vec_id AS query_id, q.w AS w, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, byte_bpe.LATIN_PATTERN, outputs=("ids_sha256", "decoded_sha256")
    )


QUERIES = {
    "op1_external_index_merge": op1_external_index_merge,
    "op2_sentence_rule_licenses": op2_sentence_rule_licenses,
    "op3_noisy_channel_toxicity": op3_noisy_channel_toxicity,
    "op4_wrapper_induction": op4_wrapper_induction,
    "op5_golay_simhash": op5_golay_simhash,
    "op6_exact_complement_packing": op6_exact_complement_packing,
    "op7_skew_safe_exact_dedup": op7_skew_safe_exact_dedup,
    "op8_feistel_pseudonyms": op8_feistel_pseudonyms,
    "op9_term_at_a_time_topk": op9_term_at_a_time_topk,
    "op10_byte_bpe_round_trip": op10_byte_bpe_round_trip,
}
ORACLE_SQL = {"op2_sentence_rule_licenses": licenses.report_sql(), "op7_skew_safe_exact_dedup": OP7_SQL, "op9_term_at_a_time_topk": OP9_SQL}
