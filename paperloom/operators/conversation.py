"""Message histories, job states and answer streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import joined, stripped

#: Labels of roles, and what stands for no history.
ROLES = {"user": "用户"}
ASSISTANT, NONE = "助手", "（无）"


def newest(messages: DataFrame, most: int, order: str) -> DataFrame:
    """The newest messages of each conversation; a bounded number leaves each task."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(order)))
    return messages.withColumn("back", back).where(F.col("back") <= most)


def history_window(messages: DataFrame, turns: int = 6) -> DataFrame:
    """(conv_id, history): the last turns, two messages each, oldest first."""
    kept = newest(messages, 2 * turns, "turn")
    return kept.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")),
        ).alias("history")
    )


def memory_retention(messages: DataFrame, most: int = 100) -> DataFrame:
    """The newest `most` messages of each conversation by turn, in the order of (created_at, turn)."""
    return newest(messages, most, "turn").drop("back").orderBy("conv_id", "created_at", "turn")


def format_history(messages: DataFrame, most: int = 6, longest: int = 500) -> DataFrame:
    """(conv_id, history): the last messages as labelled lines; blank ones are left out of these."""
    text = F.substring(stripped(F.coalesce("text", F.lit(""))), 1, longest)
    label = F.when(F.col("role") == "user", ROLES["user"]).otherwise(ASSISTANT)
    line = F.when(text != "", F.concat(label, F.lit(": "), text))
    lines = newest(messages, most, "turn").select("conv_id", "turn", line.alias("text"))
    said = F.filter(F.collect_list(F.struct("turn", "text")), lambda m: m["text"].isNotNull())
    whole = joined(said, "\n")
    return lines.groupBy("conv_id").agg(F.when(whole == "", NONE).otherwise(whole).alias("history"))


def jobs_latest_state(
    updates: DataFrame, fields: tuple[str, ...] = ("filename", "status", "progress", "message", "result", "error")
) -> DataFrame:
    """One row per job: the last value that was set of each field, created_at of its first update and
    updated_at of its last. Updates are ordered by seq."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return updates.groupBy("job_id").agg(
        *(last(c) for c in fields if c in updates.columns),
        F.min_by("updated_at", "seq").alias("created_at"),
        F.max_by("updated_at", "seq").alias("updated_at"),
    )


def jobs_recent(jobs: DataFrame, most: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(most)


def jobs_expire(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The jobs that were created in the last `hours` before `now`."""
    return jobs.where(F.col("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))


def sse_fold(lines: DataFrame) -> DataFrame:
    """(request_id, answer, sources) of event lines (request_id, seq, line).

    Deltas are appended, an answer replaces what there is, and the last sources stay. Lines that
    aren't data, [DONE] and broken JSON are passed over.
    """
    body = F.when(F.startswith("line", F.lit("data: ")), F.substr("line", F.lit(7)))
    event = F.from_json(F.when(body != "[DONE]", body), "delta string, answer string, sources string")
    events = lines.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", event.alias("e")))).alias("events"))
    start = F.struct(F.lit("").alias("answer"), F.lit(None).cast("string").alias("sources"))
    step = lambda acc, x: F.struct(
        F.concat(F.coalesce(x["e"]["answer"], acc["answer"]), F.coalesce(x["e"]["delta"], F.lit(""))).alias("answer"),
        F.coalesce(x["e"]["sources"], acc["sources"]).alias("sources"),
    )
    return events.select(
        "request_id", F.aggregate("events", start, step).alias("s")
    ).select("request_id", "s.answer", "s.sources")
