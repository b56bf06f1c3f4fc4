"""Queries of prompts, citations and sources. A conversation's turns stand for contexts and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import context as C
from paperloom.operators import conversation
from paperloom.plans.registry import query, table


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("query_id"),
        (F.col("turn") + 1).alias("context_no"),
        F.concat("role", F.lit(".md")).alias("filename"),
        F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("section"),
        F.when(F.col("turn") > 0, F.col("turn")).alias("page_start"),
        (F.col("turn") + F.col("conv_id") % 2).alias("page_end"),
        "text",
    )


CONTEXTS_SQL = """contexts AS (
  SELECT conv_id, turn, '[' || (turn + 1) || '] (来源: ' || role || '.md' || CASE WHEN turn % 2 = 0 THEN ' | 章节: ' || role ELSE '' END
    || CASE WHEN turn > 0 THEN ' | 第' || turn || CASE WHEN conv_id % 2 = 1 THEN '-' || (turn + 1) ELSE '' END || '页' ELSE '' END || ')' || chr(10) || text AS line FROM conversations
), formatted AS (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS context FROM contexts GROUP BY conv_id)"""


@query(f"WITH {CONTEXTS_SQL} SELECT conv_id AS query_id, context FROM formatted")
def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.format_context(contexts(spark, sf_dir))


@query(f"""WITH {CONTEXTS_SQL}, recent AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12),
said AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS history FROM recent GROUP BY conv_id)
SELECT conv_id AS query_id, md5('system:S ' || context || '|' || history || '|user:?') AS messages_md5 FROM formatted JOIN said USING (conv_id)""")
def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = conversation.history_window(table(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "query_id")
    requests = C.format_context(contexts(spark, sf_dir)).join(history, "query_id").withColumn("query", F.lit("?"))
    line = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return C.build_messages(requests, "S {context}").select("query_id", F.md5(line).alias("messages_md5"))


@query("""WITH answers AS (SELECT conv_id, '[' || (conv_id % 5 + 1) || '] [99] [' || (conv_id % 3) || '] [' || (conv_id % 5 + 1) || ']' AS answer FROM conversations GROUP BY conv_id),
cites AS (SELECT conv_id, conv_id % 5 + 1 AS source_no, 0 AS place FROM answers UNION ALL SELECT conv_id, conv_id % 3, 2 FROM answers WHERE conv_id % 3 <> conv_id % 5 + 1),
hit AS (SELECT c.conv_id, t.turn + 1 AS source_no, place FROM cites c JOIN conversations t ON t.conv_id = c.conv_id AND t.turn + 1 = c.source_no)
SELECT conv_id AS query_id, source_no, place::BIGINT AS place FROM hit
UNION ALL SELECT conv_id, turn + 1, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM hit)""")
def select_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = lambda k, plus: F.concat(F.lit("["), (F.col("conv_id") % k + plus).cast("string"), F.lit("]"))
    answers = c.select(
        F.col("conv_id").alias("query_id"), F.concat_ws(" ", n(5, 1), F.lit("[99]"), n(3, 0), n(5, 1)).alias("answer")
    ).distinct()
    sources = c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("source_no"), "role")
    return C.select_sources(answers, sources).select("query_id", "source_no", F.col("place").cast("long").alias("place"))


@query(
    "SELECT doc_id AS query_id, '未知来源' AS filename, doc_id AS chunk_index, '' AS section, n_chars AS page_start, n_chars AS page_end, '' AS parent_id, text AS content FROM documents"
)
def source_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.source_payload(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("query_id"), F.col("doc_id").alias("chunk_index"), F.col("n_chars").alias("page"), "text"
        )
    )


def web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the bodies of two kinds of search responses."""
    p = table(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("T"), F.col("page_id").cast("string")))
    one = F.struct(title.alias("name"), "url", F.col("html").alias("snippet"))
    other = F.struct(title.alias("title"), "url", F.col("html").alias("content"))
    empty = F.struct(title.alias("title"), F.lit("").alias("url"), F.lit("x").alias("content"))
    nested = F.to_json(F.struct(F.struct(F.struct(F.array(one).alias("value")).alias("webPages")).alias("data")))
    flat = F.to_json(F.struct(F.array(empty, other).alias("results")))
    body = F.when(F.col("page_id") % 2 == 0, nested).otherwise(flat)
    return C.normalize_search_results(p.select(F.col("page_id").alias("response_id"), body.alias("body")))


@query(
    """SELECT page_id AS response_id, 0 AS result_no, CASE WHEN page_id % 3 = 0 THEN url ELSE 'T' || page_id END AS title, url, html AS content FROM pages"""
)
def normalize_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_results(spark, sf_dir)


@query("""SELECT page_id AS response_id, '1. ' || CASE WHEN page_id % 3 = 0 THEN url ELSE 'T' || page_id END || chr(10) || substr(html, 1, 200) || chr(10) || url AS summary
FROM pages""")
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search_summary(web_results(spark, sf_dir))


@query("SELECT source AS query_id, min(doc_id) AS source_no FROM documents GROUP BY source, substr(text, 1, 100)")
def dedupe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("source_no"), F.col("text").alias("content")
    )
    return C.dedupe_sources(d).select("query_id", "source_no")
