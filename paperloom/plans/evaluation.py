"""Queries of test sets, cached answers and evaluation figures. Labels stand for scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import evaluation as E
from paperloom.plans.registry import query, table

METRICS = ("faithfulness", "answer_relevancy")


@query(
    """SELECT conv_id AS set_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS q_no, text AS question, CASE WHEN turn % 3 = 0 THEN ' ' ELSE role END AS reference, turn % 3 = 0 AS skipped FROM conversations"""
)
def testset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.groupBy(F.col("conv_id").alias("set_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("r")
    )
    truths = F.transform("r", lambda m: F.array(F.when(m["turn"] % 3 == 0, " ").otherwise(m["role"]), F.lit("other")))
    return E.testset_rows(
        rows.select("set_id", F.transform("r", lambda m: m["text"]).alias("questions"), truths.alias("ground_truths"))
    )


@query("""WITH cache AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN ' ' ELSE 'r' || item_id END AS response, item_id % 5 AS n, CASE WHEN item_id % 3 = 0 THEN 'old' ELSE 'now' END AS fingerprint FROM benchmark)
SELECT item_id, CASE WHEN item_id % 4 > 0 AND n > 0 AND fingerprint = 'now' THEN response END AS response, item_id % 4 > 0 AND n > 0 AND fingerprint = 'now' AS hit FROM cache""")
def eval_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    item = F.col("item_id")
    cache = b.select(
        F.concat(item.cast("string"), F.lit("?")).alias("question"), F.when(item % 4 == 0, " ").otherwise(
            F.concat(F.lit("r"), item.cast("string"))
        ).alias("response"),
        F.array_repeat(
            F.lit("c"), (item % 5).cast("int")
        ).alias("contexts"), F.when(item % 3 == 0, "old").otherwise("now").alias("fingerprint"), F.lit(E.CACHE_VERSION).alias("version"),
    )
    samples = b.select("item_id", F.concat(item.cast("string"), F.lit("?")).alias("question"))
    return E.eval_cache_join(samples, cache, "now").select("item_id", "response", "hit")


@query("""WITH parts AS (
  SELECT n_chars, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT AS one, ('0x' || substr(sha256(doc_id::VARCHAR), 16, 15))::BIGINT AS two FROM documents
), whole AS (
  SELECT count(*) AS chunk_count, max(n_chars) AS max_upload_time, sha256(sum(one)::HUGEINT || ',' || sum(two)::HUGEINT) AS pk_digest FROM parts
)
SELECT *, sha256('{"a": 1, "model": "m"}' || chr(10) || chunk_count || chr(10) || max_upload_time || chr(10) || pk_digest) AS fingerprint FROM whole""")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), F.col("n_chars").alias("upload_time"))
    return E.corpus_manifest(d, {"model": "m", "a": 1})


@query("""WITH stacked AS (SELECT 'price' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT 'customer', o_custkey::DOUBLE FROM orders WHERE o_custkey % 7 > 0)
SELECT metric, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM stacked GROUP BY metric""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.when(F.col("o_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_custkey").cast("double"))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    o = table(spark, sf_dir, "orders").select(price.cast("double").alias("price"), customer.alias("customer"))
    return E.run_metrics(o, ("price", "customer"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its quality label, and a number from its length that some lack."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    relevancy = F.when(F.col("n_chars") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") % 64 / 64.0)
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("q_no"),
        F.col("text").alias("question"),
        F.col("quality").cast("double").alias("faithfulness"),
        relevancy.alias("answer_relevancy"),
    )


SCORES_SQL = """scores AS (
  SELECT doc_id AS q_no, text AS question, quality::DOUBLE AS faithfulness, CASE WHEN n_chars % 5 > 0 THEN n_chars % 64 / 64.0::DOUBLE END AS answer_relevancy FROM documents LEFT JOIN labels USING (doc_id)
)"""


@query(
    f"""WITH {SCORES_SQL} SELECT 'faithfulness' AS metric, count(*) FILTER (faithfulness IS NULL) AS n_nan FROM scores UNION ALL SELECT 'answer_relevancy', count(*) FILTER (answer_relevancy IS NULL) FROM scores"""
)
def metric_nan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metric_nan_counts(scores(spark, sf_dir), METRICS)


@query(f"""WITH {SCORES_SQL} SELECT 'zero' AS policy, q_no, coalesce(faithfulness, 0) AS faithfulness, coalesce(answer_relevancy, 0) AS answer_relevancy FROM scores
UNION ALL SELECT 'drop', q_no, faithfulness, answer_relevancy FROM scores WHERE faithfulness IS NOT NULL AND answer_relevancy IS NOT NULL""")
def nan_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = scores(spark, sf_dir)
    one = lambda p: E.nan_policy(given, p, METRICS).select(F.lit(p).alias("policy"), "q_no", *METRICS)
    return one("zero").unionByName(one("drop"))


@query(f"""WITH {SCORES_SQL}, stacked AS (SELECT 'faithfulness' AS metric, faithfulness AS v FROM scores UNION ALL SELECT 'answer_relevancy', answer_relevancy FROM scores),
each AS (SELECT metric, avg(v) AS mean, min(v) AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max FROM stacked GROUP BY metric)
SELECT metric, round(mean, 4) AS mean, round(min, 4) AS min, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(max, 4) AS max FROM each
UNION ALL SELECT 'overall', round(avg(mean), 4), NULL, NULL, NULL, NULL, NULL FROM each""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metric_summary(scores(spark, sf_dir), METRICS)


@query(
    f"""WITH {SCORES_SQL} SELECT q_no, CASE WHEN length(question) > 50 THEN substr(question, 1, 50) || '…' ELSE question END AS question, round(faithfulness, 4) AS faithfulness, round(answer_relevancy, 4) AS answer_relevancy FROM scores"""
)
def metric_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metric_details(scores(spark, sf_dir), METRICS)


@query("""WITH v AS (SELECT conv_id AS q_no, turn, (length(text) % 2)::BIGINT AS relevant FROM conversations),
ranked AS (SELECT *, sum(relevant) OVER (PARTITION BY q_no ORDER BY turn) / (count(*) OVER (PARTITION BY q_no ORDER BY turn))::DOUBLE AS p FROM v),
prec AS (SELECT q_no, coalesce(sum(p * relevant) / nullif(sum(relevant), 0), 0) AS p FROM ranked GROUP BY q_no),
rec AS (SELECT conv_id AS q_no, avg((role = 'user')::INTEGER) AS r FROM conversations GROUP BY conv_id)
SELECT q_no, round(p, 6) AS context_precision, round(r, 6) AS context_recall FROM prec JOIN rec USING (q_no)""")
def context_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "q_no")
    verdicts = c.select("q_no", F.col("turn").alias("rank"), (F.length("text") % 2).cast("long").alias("relevant"))
    return E.context_metrics(verdicts, c.select("q_no", (F.col("role") == "user").cast("int").alias("covered")))


@query("SELECT doc_id AS pk, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "pk")
    return E.sample_chunks(d, 100).select("pk", "source")


ENTITY = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9][0-9.:-]{2,}"


@query(rf"""WITH own AS (SELECT doc_id AS pk, list_distinct(regexp_extract_all(text, '{ENTITY}')) AS e FROM documents),
met AS (
  SELECT DISTINCT l.pk AS left_pk, r.pk AS right_pk
  FROM (SELECT pk, unnest(e) AS x FROM own) l JOIN (SELECT pk, unnest(e) AS x FROM own) r ON l.x = r.x AND l.pk < r.pk
), scored AS (
  SELECT left_pk, right_pk, len(list_intersect(l.e, r.e)) / len(list_distinct(list_concat(l.e, r.e)))::DOUBLE AS score
  FROM met JOIN own l ON l.pk = left_pk JOIN own r ON r.pk = right_pk
)
SELECT left_pk, right_pk, round(score, 6) AS score FROM scored WHERE score >= 0.01""")
def overlap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share addresses or numbers."""
    found = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    return E.overlap_edges(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), found.alias("entities")))
