"""Queries of histories, jobs and answer streams. A user's events stand for the updates of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import conversation as C
from paperloom.plans.registry import query, table


@query("""SELECT conv_id, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS history_md5
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return C.history_window(
        table(spark, sf_dir, "conversations"), turns=2
    ).select("conv_id", F.md5(said).alias("history_md5"))


@query(
    "SELECT conv_id, turn FROM (SELECT lang AS conv_id, doc_id AS turn FROM documents) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 100"
)
def memory_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("n_chars").alias("created_at")
    )
    return C.memory_retention(d).select("conv_id", "turn")


@query(r"""WITH recent AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 500) AS line FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6
) SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM recent GROUP BY conv_id""")
def format_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.format_history(table(spark, sf_dir, "conversations"))


def job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(
            F.col("event_type") != "view", F.col("event_type")
        ).alias("status"),
        F.when(
            F.col("event_type") == "view", F.floor("value").cast("int")
        ).alias("progress"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.col("ts").alias("updated_at"),
    )


JOBS_SQL = """jobs AS (
  SELECT user_id AS job_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS status, arg_max(floor(value)::INTEGER, event_id) FILTER (event_type = 'view') AS progress,
    arg_max(props, event_id) FILTER (event_type = 'error') AS error, arg_min(ts, event_id) AS created_at, arg_max(ts, event_id) AS updated_at FROM events GROUP BY user_id
)"""


@query(
    f"WITH {JOBS_SQL} SELECT job_id, status, progress, error, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM jobs"
)
def jobs_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = C.jobs_latest_state(job_updates(spark, sf_dir))
    return jobs.select(
        "job_id",
        "status",
        "progress",
        "error",
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"),
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"),
    )


@query(f"WITH {JOBS_SQL} SELECT job_id, status FROM jobs ORDER BY created_at DESC, job_id LIMIT 50")
def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.jobs_recent(C.jobs_latest_state(job_updates(spark, sf_dir))).select("job_id", "status")


@query(f"WITH {JOBS_SQL} SELECT job_id FROM jobs WHERE created_at >= TIMESTAMP '2024-01-02 06:00:00' - INTERVAL 29 HOUR")
def jobs_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.jobs_expire(
        C.jobs_latest_state(job_updates(spark, sf_dir)), F.to_timestamp(F.lit("2024-01-02 06:00:00")), 29
    ).select("job_id")


@query("""WITH said AS (SELECT *, max(turn) FILTER (turn % 4 = 3) OVER (PARTITION BY conv_id) AS whole FROM conversations)
SELECT conv_id AS request_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (whole IS NULL OR turn >= whole), '') AS answer, coalesce('["' || max(turn) || '"]', '') AS sources FROM said GROUP BY conv_id""")
def sse_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    delta, whole = F.to_json(F.struct(F.col("text").alias("delta"))), F.to_json(F.struct(F.col("text").alias("answer")))
    sources = F.to_json(F.struct(F.array(F.col("turn").cast("string")).alias("sources")))
    lines = F.array(
        F.concat(F.lit("data: "), F.when(F.col("turn") % 4 == 3, whole).otherwise(delta)),
        F.concat(F.lit("data: "), sources),
        F.lit("data: {broken"),
        F.lit(": ping"),
        F.lit("data: [DONE]"),
    )
    events = c.select(F.col("conv_id").alias("request_id"), "turn", F.posexplode(lines).alias("i", "line"))
    return C.sse_fold(events.select("request_id", (F.col("turn") * 10 + F.col("i")).alias("seq"), "line"))
