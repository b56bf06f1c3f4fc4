"""The registered queries of these operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.alignment import align_tokenizers
from paperloom.llm.chat import conversation_digests
from paperloom.llm.mixing import mixed_sizes
from paperloom.llm.nearest import nearest_of_every
from paperloom.llm.packing import packed_documents
from paperloom.llm.passages import shared_passages
from paperloom.llm.pii import personal_data
from paperloom.llm.products import products_of_every
from paperloom.llm.quality import quality_verdicts
from paperloom.llm.repair import repaired_digests_of_damaged
from paperloom.llm.rollup import corpus_totals
from paperloom.llm.simhash import simhash_components
from paperloom.llm.storage import new_path
from paperloom.llm.toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rotated_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_of_every(_table(spark, sf_dir, "embeddings"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed_sizes(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first", "second")


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sizes GROUP BY source
), rates AS (
  SELECT *, 2 * source_size AS cap,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER earlier, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS rate
  FROM weighed
  WINDOW earlier AS (ORDER BY (2 * source_size) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * max(CASE WHEN rate * weight <= cap THEN rate END) OVER ()) AS target FROM rates
), queue AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS served,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - s.size AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, served - start)) + greatest(0, least(size, served - start - source_size)))::BIGINT AS taken,
  CASE WHEN target > 0 THEN (start + size)::DOUBLE / target END AS first,
  CASE WHEN target > 0 THEN (start + size + source_size)::DOUBLE / target END AS second
FROM queue
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text")
    )
    return conversation_digests(rows.unionByName(more))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_totals(_table(spark, sf_dir, "documents"), new_path(spark, "rollup"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"))[0]


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests_of_damaged(_table(spark, sf_dir, "conversations"))


def op13_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products_of_every(_table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || chr(1) || text, '[^\\]', '', 'g'))
    + length('<|im_start|>') + length('<|im_sep|>') + length('<|im_end|>')
    + len(regexp_extract_all(role || chr(1) || text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS chars
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  regexp_full_match(
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS LAST, role, text),
    's?ua(ua)*'
  ) AS valid
FROM marked GROUP BY conv_id
"""

QUERIES = {
    "op1_rotated_code_search": op1_rotated_code_search,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_personal_data": op9_personal_data,
    "op10_token_counts": op10_token_counts,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_norm_bucket_search": op13_norm_bucket_search,
}

ORACLE_SQL: dict[str, str] = {
    "op6_source_mixing": OP6_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op13_norm_bucket_search": OP13_SQL,
}
