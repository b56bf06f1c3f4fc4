"""Queries of the streaming operators: tables read as streams, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.registry import query, table
from paperloom.sources.scratch import scratch_path
from paperloom.streaming import state as S


def files_a_batch(rows: DataFrame, batches: int) -> int:
    return max(1, -(-rows.rdd.getNumPartitions() // batches))


def streamed(spark: SparkSession, sf_dir: str, name: str, batches: int = 4) -> DataFrame:
    """A table as a stream of a few micro-batches, from a copy in several files: as many a batch as follow from its size."""
    rows = table(spark, sf_dir, name)
    path = scratch_path(spark, name)
    per_batch = files_a_batch(rows, batches)
    rows.repartitionByRange(batches * per_batch, rows.columns[0]).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def state_partitions(spark: SparkSession, sf_dir: str, name: str, batches: int = 4) -> int:
    """Over how many partitions a table's state is dealt: two for each core and for each file of a batch, the session's number at most.

    They follow the table's size then. A partition has a task, a worker and a commit in every batch, which is most of
    the time where it has few rows.
    """
    most = int(spark.conf.get(S.SHUFFLE))
    return min(most, 2 * max(spark.sparkContext.defaultParallelism, files_a_batch(table(spark, sf_dir, name), batches)))


@query("SELECT DISTINCT sha256(text) AS file_hash FROM documents")
def stream_dedupe_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = streamed(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("file_hash"), "doc_id")
    return S.stream_dedupe_ingest(files, scratch_path(spark, "ingested")).select("file_hash")


JOBS_SQL = """SELECT user_id AS job_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS status, arg_max(floor(value)::INTEGER, event_id) FILTER (event_type = 'view') AS progress,
  arg_max(props, event_id) FILTER (event_type = 'error') AS error, max(event_id) AS seq FROM events GROUP BY user_id"""


def job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return streamed(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(kind != "view", kind).alias("status"), F.when(
            kind == "view", F.floor("value").cast("int")
        ).alias("progress"), F.when(kind == "error", F.col("props")).alias("error")
    )


@query(JOBS_SQL)
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_to_table(S.stream_job_state(job_updates(spark, sf_dir)), scratch_path(spark, "jobs"), "update", ("job_id",))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = S.stream_memory(streamed(spark, sf_dir, "conversations"), 5)
    parts = state_partitions(spark, sf_dir, "conversations")
    kept = S.run_to_table(newest, scratch_path(spark, "memory"), "update", ("conv_id",), parts)
    return kept.select("conv_id", F.inline("messages"))
