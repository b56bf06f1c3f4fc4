"""Readers and the chunk sink on real files, and streams in several micro-batches."""

from __future__ import annotations

import hashlib
import time

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import chunking
from paperloom.schemas import CHUNK
from paperloom.sources import files
from paperloom.sources.chunk_table import ChunkTable
from paperloom.streaming import hashes, state
from paperloom.streaming.hashes import BITS, CELL, HashStore, sketched


def test_files_are_read_validated_and_named(spark, tmp_path):
    (tmp_path / "A.TXT").write_bytes("héllo".encode())
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "noext").write_bytes(b"y")
    found = files.read_files(spark, str(tmp_path)).withColumn("split_mode", F.when(F.col("filename") == "A.TXT", "odd"))
    rows = {r.filename: r for r in files.upload_validate(files.file_fingerprint(found)).collect()}
    digest = hashlib.sha256("héllo".encode()).hexdigest()
    assert (rows["A.TXT"].reason, rows["A.TXT"].stored_name, rows["A.TXT"].size_bytes) == ("split_mode", f"{digest}.txt", 6)
    assert rows["b.exe"].reason == "extension" and rows["noext"].stored_name.endswith(".bin")
    limit = spark.createDataFrame(
        [("a.md", 20 * 2**20, None), ("b.md", 20 * 2**20 + 1, "auto")],
        "filename string, size_bytes long, split_mode string",
    )
    assert [r.accepted for r in files.upload_validate(limit).orderBy("filename").collect()] == [True, False]


def test_text_files_become_chunks_in_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.md").write_text("# Head\n\nfirst text\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    (tmp_path / "in/two.txt").write_text("second text")
    units = files.read_text_units(spark, str(tmp_path / "in"))
    chunks = chunking.parent_child_chunks(units, one_unit=True)
    assert set(chunks.columns) | {"pk", "upload_time"} == {f.name for f in T.StructType.fromDDL(CHUNK)}
    assert files.write_chunk_table(chunks, str(tmp_path / "out")) == 2
    again = chunks.where("filename = 'two.txt'")
    assert files.write_chunk_table(
        again.unionByName(again.withColumn("chunk_index", F.lit(7).cast("long"))), str(tmp_path / "out")
    ) == 1  # what was added
    kept = ChunkTable(spark, str(tmp_path / "out")).read()
    assert kept.count() == kept.select("pk").distinct().count() == 3  # the same chunk has the same key and is there once
    assert {
        (r.filename, r.content_type, r.section) for r in kept.collect()
    } == {("one.md", "mixed", "Head"), ("two.txt", "text", "")}


def test_text_files_are_units_by_bytes_and_name(spark, tmp_path):
    texts = {"a b+c%.txt": "héllo\n", "deep/é.md": "\ufeffwith a mark", "empty.txt": "", "many.txt": "line\n" * 50_000}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "other.bin").write_bytes(b"x")
    found = {r.filename: r for r in files.read_text_units(spark, str(tmp_path), "*.{txt,md}").collect()}
    assert texts.pop("empty.txt") == ""  # Spark passes over empty files
    assert {n: r.text for n, r in found.items()} == {n.split("/")[-1]: t.removeprefix("\ufeff") for n, t in texts.items()}
    assert {r.file_hash for r in found.values()} == {hashlib.sha256(t.encode()).hexdigest() for t in texts.values()}


def test_arriving_files_are_units_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for run in range(2):
        for i in range(3):
            (tmp_path / f"in/{run}{i}.txt").write_text(f"text {i * (1 + run)}")
        units = files.read_text_units(spark, str(tmp_path / "in"), per_batch=2)
        kept = state.stream_dedupe_ingest(units.select("file_hash", "filename", "text"), str(tmp_path / "out"), parts=2)
    assert sorted(r.text for r in kept.collect()) == ["text 0", "text 1", "text 2", "text 4"]


def test_tables(spark):
    cells = spark.createDataFrame(
        [("s", 0, 0, "a|b"), ("s", 0, 1, "c\nd"), ("s", 1, 0, " e\r "), ("t", 0, 0, None)],
        "sheet string, row_no int, col_no int, value string",
    )
    found = {r.sheet: r.text for r in files.table_to_markdown(cells).collect()}
    assert found == {"s": "# Sheet: s\n\n| a\\|b | c<br>d |\n| --- | --- |\n| e |  |", "t": "# Sheet: t\n\n|  |\n| --- |"}
    rows = spark.createDataFrame([("1", " "), (None, None)], "a string, b string")
    assert [r.text for r in files.rows_to_kv_docs(rows, ["a", "b"]).collect()] == ["a: 1"]


def test_csv_files_become_tables(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes("\ufeffname,note\r\nx,\"one, two\"\r\ny,\"line\nend\"\r\nz\r\n".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/empty.CSV").write_text("")
    (tmp_path / "other.txt").write_text("a,b")
    cells = files.read_csv_tables(spark, str(tmp_path))
    found = {r.sheet: r.text for r in files.table_to_markdown(cells, "CSV").collect()}
    assert found == {
        "a b.csv": "# CSV: a b.csv\n\n| name | note |\n| --- | --- |\n| x | one, two |\n| y | line<br>end |\n| z |  |"
    }


def test_csv_cells_may_be_long(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x," + "y" * 300_000)
    cells = files.read_csv_tables(spark, str(tmp_path)).collect()
    assert [(c.col_no, len(c.value)) for c in cells] == [(0, 1), (1, 300_000)]


def stream_of(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet"
    ).parquet(folder)


MESSAGES = "conv_id long, turn long, role string, text string"


def message(conv: int, turn: int | None, text: str = "") -> tuple:
    return (conv, turn, "user" if (turn or 0) % 2 else "assistant", text or f"{conv}.{turn}")


def memory_of(stream, out, **kwargs):
    kept = state.run_to_table(state.stream_memory(stream, 4, **kwargs), out, "update", ("conv_id",))
    return {r.conv_id: [(m.turn, m.role, m.text) for m in r.messages] for r in kept.collect()}


def test_stream_keeps_the_newest_messages_over_restarts_repeats_and_late_turns(spark, tmp_path):
    batches = [
        [message(1, t) for t in range(5)],
        [message(1, t) for t in range(3, 7)] + [message(2, 1), message(1, None)],
        [message(1, 20), message(2, 1), message(2, 0), message(1, 2)],  # repeats and late turns
        [message(3, 9), message(1, 10), message(2, 1, "said anew")],
    ]
    out, seen = str(tmp_path / "out"), []
    for upto in range(1, 5):  # every run is a restart of the stream
        for i in range(upto - 1, upto):
            spark.createDataFrame(batches[i], MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(MESSAGES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
        got = memory_of(stream, out)
        seen += batches[upto - 1]
        want: dict[int, dict] = {}
        for conv, turn, role, text in seen:
            if turn is not None:
                want.setdefault(conv, {})[turn] = (turn, role, text)
        assert got == {c: [m[t] for t in sorted(m)[-4:]] for c, m in want.items()}


def test_stream_memory_goes_on_from_a_stored_table(spark, tmp_path):
    stored = spark.createDataFrame([message(1, t) for t in range(8)] + [message(2, 5)], MESSAGES)
    stream = stream_of(spark, str(tmp_path / "in"), [[message(1, 6, "anew"), message(1, 9)], [message(3, 1)]], MESSAGES)
    got = memory_of(stream, str(tmp_path / "out"), stored=stored)
    assert got == {1: [(5, "user", "1.5"), (6, "assistant", "anew"), (7, "user", "1.7"), (9, "user", "1.9")], 3: [(1, "user", "3.1")]}


def test_a_conversation_costs_one_read_and_one_write_of_its_state_a_batch():
    """However many messages it gets; a call to the state goes to the JVM and back, and frames for few rows cost more than that."""
    calls: list[str] = []

    class Held:
        messages: list[tuple] = []

        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (setattr(self, "messages", a[0]) if a else iter(self.messages))

    memory = state._Memory(4, None)
    memory.held = Held()
    said = Row("conv_id", "turn", "role", "text")
    for turns in (range(40), (38, None, 50, 3), (None,)):
        (out,) = memory.handleInputRows((1,), iter([said(*message(1, t)) for t in turns]), None)
    assert [m["turn"] for m in out.messages] == [37, 38, 39, 50] == [m[0] for m in memory.held.messages]
    assert calls == ["get", "put", "get", "put", "get"]


def test_stream_keeps_long_turns_whole_beside_messages_without_one_and_takes_the_largest_of_equal_ones(spark, tmp_path):
    """In both orders of arrival, and from a stored table; a null is the largest."""
    far = 2**53 + 1
    rows = [(1, far, "user", "a"), (1, None, "user", "b"), (1, 7, "user", "x"), (1, 7, "user", "y"), (1, 7, "assistant", "z"), (1, 8, "user", None), (1, 8, "user", "q")]
    rows += [(None, 1, "user", "c"), (None, None, None, None), (2, None, "user", "d")]
    want = [(7, "user", "y"), (8, "user", None), (far, "user", "a")]
    for name, given in (("a", rows), ("b", rows[::-1])):
        assert memory_of(stream_of(spark, f"{tmp_path}/{name}", [given], MESSAGES), f"{tmp_path}/out-{name}") == {1: want, None: [(1, "user", "c")], 2: []}
    stream = stream_of(spark, f"{tmp_path}/c", [[(1, 6, "user", "late")]], MESSAGES)
    stored = spark.createDataFrame(rows, MESSAGES)
    assert memory_of(stream, f"{tmp_path}/out-c", stored=stored) == {1: [(6, "user", "late"), *want]}


def test_stream_takes_each_hash_once_over_batches(spark, tmp_path):
    """However late a copy comes, and also if a batch is run again."""
    batches = [[("a", 1), ("b", 2), ("b", 2)], [("a", 99_999_999), ("c", 0), (None, 1)], [("c", 5), ("d", 6)]]
    stream = stream_of(spark, str(tmp_path / "in"), batches, "file_hash string, at long")
    found = state.stream_dedupe_ingest(stream, str(tmp_path / "out"))
    assert sorted((r.file_hash, r.at) for r in found.collect()) == [("a", 1), ("b", 2), ("c", 0), ("d", 6)]
    assert state.stream_dedupe_ingest(stream, str(tmp_path / "out")).count() == 4


def test_a_batch_opens_only_the_parts_that_may_hold_its_hashes(spark, tmp_path, monkeypatch):
    schema = T.StructType.fromDDL("file_hash string, at long")
    store = HashStore(spark, str(tmp_path / "out"), schema, parts=8, expected=1000)
    opened, read = [], HashStore.stored
    monkeypatch.setattr(HashStore, "stored", lambda self, parts, before: (opened.append(parts), read(self, parts, before))[1])
    batches = [[(f"{b}.{i}", b) for i in range(20)] for b in range(8)] + [[("3.7", 99), ("new", 99)]]
    want = {}
    for number, rows in enumerate(batches):
        store.add(spark.createDataFrame(rows, schema), number)
        want |= {h: at for h, at in rows if h not in want}
    store.add(spark.createDataFrame(batches[-1], schema), len(batches) - 1)  # run again
    assert {r.file_hash: r.at for r in store.read().collect()} == want and store.read().count() == len(want)
    assert [len(p) for p in opened] == [1, 1]  # new hashes open nothing, a copy opens its part
    sizes = [sum(f.stat().st_size for f in (tmp_path / f"out/sketches/{i}").glob("*.parquet")) for i in (0, 1)]
    assert max(sizes) < CELL * BITS / 8 + 20_000


def test_sketches_lose_nothing_and_mistake_few():
    rng = np.random.default_rng(1)
    one, other = rng.integers(-(2**63), 2**63, size=(2, 40_000))
    maybe, held = sketched(None, one[:20_000], other[:20_000], 20_000 * BITS)
    assert not maybe.any()
    maybe, held = sketched(held, one, other, 20_000 * BITS)
    assert maybe[:20_000].all() and maybe[20_000:].mean() < 0.02
    assert sketched(held, one[:0], other[:0], 20_000 * BITS)[1] == held


def test_more_hashes_than_expected_and_rows_of_hashes_alone(spark, tmp_path, monkeypatch):
    """A full sketch says maybe to all; the rows are right all the same."""
    monkeypatch.setattr(hashes, "CELL", 8)
    store = HashStore(spark, str(tmp_path / "out"), T.StructType.fromDDL("file_hash string"), parts=3, expected=10)
    for number in range(4):
        store.add(spark.createDataFrame([(str(i),) for i in range(40 * number, 40 * number + 60)] + [(None,)], "file_hash string"), number)
    assert sorted(int(r.file_hash) for r in store.read().collect()) == list(range(180))


JOBS = "job_id string, seq long, status string, progress int, error string"


def run_until(stream, folder, done):
    """Runs a stream that doesn't end by itself until its rows are as they should be, or a minute has gone."""
    rows = []
    sink = stream.writeStream.foreachBatch(lambda batch, _: rows.extend(batch.collect())).outputMode("update")
    query = sink.option("checkpointLocation", folder).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if done(list(rows)):
                return rows
        raise AssertionError(rows)
    finally:
        query.stop()


def test_jobs_keep_their_latest_values_and_go_by_their_timers(spark, tmp_path):
    batches = [
        [("a", 1, "new", None, None), ("a", 3, None, 5, None), ("b", 2, "new", 1, None)],
        [("a", 2, "late", 3, None), ("c", 4, "new", None, "e")],
    ]
    stream = stream_of(spark, str(tmp_path / "in"), batches, JOBS)
    ended = lambda rows: {r.job_id for r in rows if r.expired} == {"a", "b", "c"}
    rows = run_until(state.stream_job_expiry(stream, keep_ms=8_000), str(tmp_path / "c"), ended)
    last = {r.job_id: (r.status, r.progress, r.error, r.seq) for r in rows if not r.expired}
    assert last == {"a": ("late", 5, None, 3), "b": ("new", 1, None, 2), "c": ("new", None, "e", 4)}


def test_messages_go_after_their_time(spark, tmp_path):
    stream = stream_of(spark, str(tmp_path / "in"), [[message(1, 1)]], MESSAGES)
    memory = state.stream_memory(stream, 4, keep_ms=1)
    run_until(memory, str(tmp_path / "c"), lambda rows: len(rows) == 1)
    spark.createDataFrame([message(1, 2)], MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    rows = run_until(memory, str(tmp_path / "c"), lambda rows: len(rows) == 1)
    assert [m.turn for m in rows[0].messages] == [2]


def test_written_text_files_lie_under_a_bounded_number_of_folders(spark, small, tmp_path, monkeypatch):
    from paperloom.plans import sources as plans

    monkeypatch.setattr(plans, "scratch_path", lambda _, name: str(tmp_path / name))
    units = plans.read_text_units(spark, small)
    top = [p for p in (tmp_path / "texts").iterdir() if p.is_dir()]
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert units.select("filename").distinct().count() == units.count() == docs
    assert 32 < len(top) <= plans.TEXT_FOLDERS and len(list((tmp_path / "texts").glob("*/*/*.txt"))) == docs


def test_tasks_make_local_text_files_and_rows_of_one_name_stay_apart(spark, tmp_path):
    rows = [("a/b+c %=é:.TXT", "x\r\ny"), ("same", "one"), ("same", "two"), ("same", "two"), ("empty", ""), (None, "no name")]
    files.write_text_files(spark.createDataFrame(rows, "filename string, text string"), str(tmp_path / "out"), 3)
    units = files.read_text_units(spark, str(tmp_path / "out"), "*.txt", files.written_name())
    assert sorted((str(r.filename), r.text) for r in units.collect()) == sorted((str(n), f"{t}\n") for n, t in rows)
    assert not list((tmp_path / "out").rglob("*.crc"))  # Hadoop's, which starts processes for each file


def test_other_stores_get_text_files_by_the_writer(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.texts.link./t", f"file://{tmp_path}")
    rows = [("a/b+c %.TXT", "x"), ("same", "one"), ("same", "two"), (None, "no name")]
    files.write_text_files(spark.createDataFrame(rows, "filename string, text string"), "viewfs://texts/t/out", 3)
    units = files.read_text_units(spark, "viewfs://texts/t/out", "*.txt", files.written_name())
    assert sorted((str(r.filename), r.text) for r in units.collect()) == sorted((str(n), f"{t}\n") for n, t in rows)


def test_many_small_text_files_share_tasks(spark, tmp_path, monkeypatch):
    for i in range(60):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    bytes_a_task = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # one file each
    try:
        units = files.read_text_units(spark, str(tmp_path))
        assert units.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted((r.filename, r.text) for r in units.collect()) == sorted((f"{i}.txt", f"text {i}") for i in range(60))
        monkeypatch.setattr(files, "TASK_BYTES", 1)  # as if they were large
        assert files.read_text_units(spark, str(tmp_path)).rdd.getNumPartitions() == 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_task)
