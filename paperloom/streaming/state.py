"""Streams of files, job updates and messages, with the state that their batch forms work out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from paperloom.streaming.hashes import HashStore


def stream_dedupe_ingest(files: DataFrame, path: str, parts: int = 64, expected: int = 1 << 20) -> DataFrame:
    """Runs a stream of arriving files into a table at a path and reads it: each hash once, the first that came.

    The table is the memory (`HashStore`): a batch takes the hashes that no earlier batch has stored, however long
    ago, and writes its own folders, so one that is run again gives the same. It opens the parts alone whose
    hashes may have come again. Files without a hash are left out. A later run of the stream goes on where
    the last one ended, with the same `parts` and `expected`.
    """
    store = HashStore(files.sparkSession, path, files.schema, parts, expected)
    sink = files.writeStream.foreachBatch(store.add).option("checkpointLocation", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return store.read()


def stream_job_state(updates: DataFrame, fields: tuple[str, ...] = ("status", "progress", "error")) -> DataFrame:
    """The latest value that was set of each field of each job, for update or complete output."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return updates.groupBy("job_id").agg(*map(last, fields), F.max("seq").alias("seq"))


class _Jobs(StatefulProcessor):
    """The latest values of a job's fields, which go by a timer."""

    def __init__(self, fields: tuple[str, ...], state: str, keep_ms: int):
        self.fields, self.state, self.keep_ms = fields, state, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("job", self.state)

    def _row(self, key: tuple, seq: int | None, values: tuple, expired: bool) -> pd.DataFrame:
        out = {"job_id": [key[0]], **{f: [v] for f, v in zip(self.fields, values, strict=True)}, "seq": [seq], "expired": [expired]}
        return pd.DataFrame(out, dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        if self.held.exists():
            seq, *held = self.held.get()
        else:
            seq, held = None, [None] * (2 * len(self.fields))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        values, at = held[::2], held[1::2]
        for b in rows:
            for r in b.itertuples(index=False):
                seq = int(r.seq) if seq is None else max(seq, int(r.seq))
                for i, f in enumerate(self.fields):
                    x = getattr(r, f)
                    if not pd.isna(x) and (at[i] is None or r.seq >= at[i]):
                        values[i], at[i] = x.item() if hasattr(x, "item") else x, int(r.seq)
        values = [int(v) if isinstance(v, float) and v.is_integer() and f in self.whole else v for f, v in zip(self.fields, values, strict=True)]
        self.held.update((seq, *(x for pair in zip(values, at, strict=True) for x in pair)))
        yield self._row(key, seq, tuple(values), False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        self.held.clear()
        yield self._row(key, None, (None,) * len(self.fields), True)

    def close(self) -> None:
        pass

    #: Fields of whole numbers, which pandas may hand over as floats.
    whole: tuple[str, ...] = ()


def stream_job_expiry(
    updates: DataFrame, fields: tuple[str, ...] = ("status", "progress", "error"), keep_ms: int = 24 * 3_600_000
) -> DataFrame:
    """`stream_job_state` with an end: a job goes `keep_ms` after it was first seen, and a row with `expired` says so.

    So the state has the jobs of that time alone, whatever comes in. The clock is that of the stream's batches; an
    update of a job that has gone begins it anew. A stream with timers runs until it is stopped, also when
    it is started for what is available. The session's streams keep their state in RocksDB from then on.
    """
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = {f: updates.schema[f].dataType for f in fields}
    state = "seq long, " + ", ".join(f"{f} {k.simpleString()}, {f}_seq long" for f, k in kinds.items())
    job = _Jobs(fields, state, keep_ms)
    job.whole = tuple(f for f, k in kinds.items() if isinstance(k, T.IntegralType))
    out = f"job_id {updates.schema['job_id'].dataType.simpleString()}, " + "".join(f"{f} {k.simpleString()}, " for f, k in kinds.items())
    jobs = updates.select("job_id", "seq", *fields).groupBy("job_id")
    return jobs.transformWithStateInPandas(job, f"{out}seq long, expired boolean", "Update", "ProcessingTime")


#: What a conversation's state holds for each message.
MESSAGE = "turn long, role string, text string"
FIELDS = ("turn", "role", "text")
SHUFFLE = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _order(message: tuple) -> tuple:
    """Of messages of one turn that come at once, the largest by role and text stands, null being the largest."""
    return tuple((x is None, x or "") for x in message[1:])


class _Memory(StatefulProcessor):
    """The newest messages of a conversation, as a list in its state."""

    def __init__(self, most: int, keep_ms: int | None):
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("messages", MESSAGE, self.keep_ms)

    def _newest(self, held: dict[int, tuple]) -> dict[int, tuple]:
        return {t: held[t] for t in sorted(held)[-self.most :]}

    def _add(self, messages: Iterable[tuple]) -> list[tuple]:
        """Puts a batch's messages into the state, by one read and one write of it."""
        new: dict[int, tuple] = {}
        for m in messages:
            if m[0] is not None and (m[0] not in new or _order(new[m[0]]) < _order(m)):
                new[m[0]] = m
                if len(new) > 2 * self.most:
                    new = self._newest(new)
        held = {m[0]: m for m in self.held.get()}
        if not new:
            return list(held.values())
        kept = list(self._newest(held | new).values())
        self.held.put(kept)
        return kept

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:  # noqa: N802,N803
        self._add(tuple(m[f] for f in FIELDS) for m in initialState.messages)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802,N803
        kept = self._add((r.turn, r.role, r.text) for r in rows)
        yield Row(conv_id=key[0], messages=[dict(zip(FIELDS, m, strict=True)) for m in kept])

    def close(self) -> None:
        pass


def _stored_messages(stored: DataFrame, most: int) -> DataFrame:
    """(conv_id, messages): the newest messages of each conversation of a table, as one row that goes into the state at once."""
    turn = Window.partitionBy("conv_id", "turn").orderBy(F.desc_nulls_first("role"), F.desc_nulls_first("text"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    one = stored.where("turn IS NOT NULL").withColumn("at", F.row_number().over(turn)).where("at = 1")
    kept = one.withColumn("at", F.row_number().over(newest)).where(F.col("at") <= most)
    return kept.groupBy("conv_id").agg(F.collect_list(F.struct(*FIELDS)).alias("messages"))


def stream_memory(
    messages: DataFrame, most: int = 100, stored: DataFrame | None = None, keep_ms: int | None = None
) -> DataFrame:
    """(conv_id, messages): the newest `most` messages of each conversation that got some, oldest first.

    A message is (turn, role, text). The state of a conversation is that list, so it is bounded
    whatever comes in. A turn that comes again stands for the one before, late turns go to
    their place, and messages without a turn are left out. `stored` has messages that are there before
    the stream begins, as a table of the same columns; it is read by the first run alone. With `keep_ms` a
    conversation's messages go that long after it last got some; such a stream runs until it is stopped, also
    when it is started for what is available. The session's streams keep their state in RocksDB from then on,
    which this kind of state needs.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return messages.select("conv_id", *FIELDS).groupBy("conv_id").transformWithState(
        _Memory(most, keep_ms), f"conv_id long, messages array<struct<{MESSAGE.replace(' ', ': ').replace(',: ', ', ')}>>", "Update",
        "None" if keep_ms is None else "ProcessingTime", None if stored is None else _stored_messages(stored, most).groupBy("conv_id"),
    )


def run_to_table(
    stream: DataFrame, path: str, mode: str = "append", latest: tuple[str, ...] = (), partitions: int | None = None
) -> DataFrame:
    """Runs a stream over all that is there into a table of its batches and reads what it says last.

    A batch writes its own folder, so one that is run again overwrites itself. With `latest`, rows
    of a later batch stand for earlier ones of the same key. A stream's state is dealt over as many `partitions`
    from its first run on, or else over the session's shuffle partitions; each costs a task and a commit a batch.
    """
    spark: SparkSession = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    sink: Callable = stream.writeStream.foreachBatch(write).outputMode(mode).option(
        "checkpointLocation", f"{path}/checkpoint"
    )
    shuffled = spark.conf.get(SHUFFLE)
    spark.conf.set(SHUFFLE, str(partitions or shuffled))
    try:
        run = sink.trigger(availableNow=True).start()  # takes a copy of the session's settings
    finally:
        spark.conf.set(SHUFFLE, shuffled)
    run.awaitTermination()
    rows = spark.read.schema(
        T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())])
    ).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if not latest:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in latest]
    return rows.groupBy(*latest).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*latest, "r.*")
