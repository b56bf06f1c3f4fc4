"""The chunk table's versions and the stored word index."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.operators import retrieval as R
from paperloom.operators import word_index as W
from paperloom.operators.word_index import WordIndex
from paperloom.sources import files as S
from paperloom.sources.chunk_table import ChunkTable
from paperloom.sources.scratch import scratch_path
from paperloom.sources.versions import Conflict, Versions

CHUNK = "file_hash string, filename string, chunk_index long, text string"


def chunks_of(spark, *files: tuple[str, list[str]]):
    """Chunks of (filename, texts); a file's hash starts with the name's first letter."""
    rows = [(f"{name[0]}{i:063d}", name, i_text, text) for i, (name, texts) in enumerate(files) for i_text, text in enumerate(texts)]
    rows = [(h[0] + f"{sum(map(ord, n)):063d}", n, i, t) for h, n, i, t in rows]
    return spark.createDataFrame(rows, CHUNK)


def held(table: ChunkTable, version: int | None = None) -> set[tuple]:
    return {(r.filename, r.chunk_index, r.text) for r in table.read(version).collect()}


def data_files(table: ChunkTable) -> dict[str, set[str]]:
    """The files of each partition of the current version."""
    _, state = table.versions.state()
    return {
        p: {str(f) for folder in folders for f in Path(f"{table.path}/{folder}/hash_prefix={p}").glob("*.parquet")}
        for p, folders in state["parts"].items()
    }


@pytest.fixture
def stored(spark) -> ChunkTable:
    table = ChunkTable(spark, scratch_path(spark, "table"))
    assert table.append(chunks_of(spark, ("a1", ["x", "y"]), ("a2", ["z"]), ("b1", ["u", "v", "w"]), ("c1", ["k"]))) == 7
    return table


def test_append_adds_what_is_new_and_repeats_change_nothing(spark, stored):
    before = data_files(stored)
    assert stored.append(chunks_of(spark, ("a1", ["x", "y"]), ("b1", ["u"]))) == 0
    assert stored.versions.numbers() == [0]
    assert stored.append(chunks_of(spark, ("b1", ["u", "v", "w", "new"]))) == 1
    after = data_files(stored)
    assert before["a"] == after["a"] and before["b"] < after["b"] and before["c"] == after["c"]
    assert len(held(stored)) == 8 and len(held(stored, 0)) == 7


def test_append_takes_a_repeated_key_once_and_no_rows_make_an_empty_table(spark):
    table = ChunkTable(spark, scratch_path(spark, "table"))
    none = spark.createDataFrame([], CHUNK)
    assert table.append(none) == 0 and table.read().count() == 0
    twice = chunks_of(spark, ("a", ["x"])).unionAll(chunks_of(spark, ("a", ["x"])))
    assert table.append(twice) == 1 and held(table) == {("a", 0, "x")}


def test_replace_rewrites_the_touched_partitions_alone(spark, stored):
    before = data_files(stored)
    new = chunks_of(spark, ("a1", ["only"]), ("d1", ["fresh"]))
    assert stored.replace(new) == 1
    after = data_files(stored)
    assert before["b"] == after["b"] and before["c"] == after["c"] and not before["a"] & after["a"]
    assert {(f, t) for f, _, t in held(stored)} == {("a1", "only"), ("a2", "z"), ("b1", "u"), ("b1", "v"), ("b1", "w"), ("c1", "k"), ("d1", "fresh")}
    assert stored.replace(new) == 1 and stored.versions.numbers() == [0, 1]  # the same again is no new version
    assert stored.replace(new.withColumn("text", F.lit("other"))) == 2


def test_replace_can_widen_the_table(spark, stored):
    stored.replace(chunks_of(spark, ("a1", ["only"])).withColumn("page", F.lit(3).cast("long")))
    assert {(r.filename, r.page) for r in stored.read().where("filename like 'a%'").collect()} == {("a1", 3), ("a2", None)}
    assert "page" not in stored.read(0).columns


def test_delete_rewrites_the_file_s_partition_alone(spark, stored):
    before = data_files(stored)
    assert stored.delete("a1") == 2
    after = data_files(stored)
    assert before["b"] == after["b"] and before["c"] == after["c"]
    assert {f for f, _, _ in held(stored)} == {"a2", "b1", "c1"}
    assert stored.delete("a1") == 0 and stored.delete("nothing") == 0 and stored.versions.numbers() == [0, 1]
    assert stored.delete("c1") == 1 and "c" not in data_files(stored)


@pytest.mark.parametrize("step", ["_write", "commit"])
@pytest.mark.parametrize("change", ["append", "replace", "delete"])
def test_a_crash_at_any_step_leaves_the_old_version(spark, stored, monkeypatch, step, change):
    new = chunks_of(spark, ("a1", ["changed", "y", "more"]))
    run = {"append": lambda: stored.append(new), "replace": lambda: stored.replace(new), "delete": lambda: stored.delete("a1")}[change]
    before = held(stored)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "_write":  # the data is written and the writer dies
            write = ChunkTable._write
            m.setattr(ChunkTable, "_write", lambda self, rows: (write(self, rows), crash()))
        else:
            m.setattr(Versions, "commit", crash)
        with pytest.raises(OSError, match="lost"):
            run()
    assert held(stored) == before and stored.versions.numbers() == [0]
    run()
    own = {(i, t) for f, i, t in held(stored) if f == "a1"}
    assert own == {"append": {(0, "x"), (1, "y"), (2, "more")}, "replace": {(0, "changed"), (1, "y"), (2, "more")}, "delete": set()}[change]


def test_a_second_writer_of_a_version_gets_a_conflict(spark, stored):
    number, state = stored.versions.state()
    stored.versions.commit(number, state)
    with pytest.raises(Conflict):
        stored.versions.commit(number, {"parts": {}})
    assert stored.versions.state() == (1, state)


def test_vacuum_keeps_what_the_last_versions_have(spark, stored):
    stored.delete("a1")
    stored.replace(chunks_of(spark, ("a2", ["other"])))
    rows = held(stored), held(stored, 1)
    assert stored.vacuum(keep=2) == 0
    assert (held(stored), held(stored, 1)) == rows
    assert stored.vacuum() > 0 and held(stored) == rows[0] and stored.versions.numbers() == [2]


def test_write_chunk_table_says_what_it_added(spark):
    path = scratch_path(spark, "table")
    assert S.write_chunk_table(chunks_of(spark, ("a", ["x"])), path) == 1
    assert S.write_chunk_table(chunks_of(spark, ("a", ["x", "y"])), path) == 1


# --- word index

TEXTS = [
    "the cat sat on the mat", "the dog", "a cat and a dog and the cat", "", "rare word", "the the the the", "mat", "on on the mat cat", "dog dog rare",
    "the end of the day", "Über die Katze", "the mat", "the cat", "cat", "the word of the day",
]


def tokenized(spark, texts, start: int = 0):
    rows = spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "chunk_id long, text string")
    return rows.withColumn("tokens", R.tokens(F.col("text"))).drop("text")


def asked_of(spark, queries):
    rows = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    return rows.withColumn("tokens", R.tokens(F.col("text"))).drop("text")


def plain_bm25(texts: list[list[str]], queries: list[list[str]], k: int) -> list[tuple]:
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = Counter(t for x in texts for t in set(x))
    weight = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    often = 0.25 * sum(weight.values()) / len(weight)
    weight = {t: w if w >= 0 else often for t, w in weight.items()}
    out = []
    for q, query in enumerate(queries):
        scores = []
        for i, x in enumerate(texts):
            tf = Counter(x)
            score = round(sum(weight[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(x) / mean)) for t in query if tf[t]), 4)
            scores += [(-score, i)] if score > 0 else []
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


QUERIES = ["cat", "the mat", "rare dog cat", "nothing here", "", "the", "the the day end", "on"]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_index_equals_plain_scores(spark, k):
    index = WordIndex(spark, scratch_path(spark, "index"))
    index.rebuild(tokenized(spark, TEXTS).repartition(3))
    got = sorted(tuple(r) for r in index.search(asked_of(spark, QUERIES), k).collect())
    want = plain_bm25([t.split() for t in TEXTS], [q.split() for q in QUERIES], k)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in sorted(want)]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)], abs=2e-4)


def test_appended_chunks_are_found_and_weights_follow(spark):
    index = WordIndex(spark, scratch_path(spark, "index"), buckets=4)
    for at in range(0, len(TEXTS), 5):
        index.append(tokenized(spark, TEXTS[at : at + 5], at))
    whole = WordIndex(spark, scratch_path(spark, "index"))
    whole.rebuild(tokenized(spark, TEXTS))
    asked = asked_of(spark, QUERIES)
    rows = lambda i: sorted(tuple(r) for r in i.search(asked, 4).collect())
    assert rows(index) == rows(whole)
    whole.rebuild(tokenized(spark, ["cat", "x", "y", "dog", "z"]))
    assert {r[1] for r in rows(whole)} == {0, 3}


def test_index_of_no_chunks_and_of_chunks_without_words(spark):
    index = WordIndex(spark, scratch_path(spark, "index"))
    assert index.search(asked_of(spark, QUERIES)).collect() == []
    index.append(tokenized(spark, []))
    index.append(tokenized(spark, ["", " "]))
    assert index.search(asked_of(spark, QUERIES)).collect() == []
    index.append(tokenized(spark, ["cat", "dog", "x"], 2))
    got = [(r.query_id, r.chunk_id) for r in index.search(asked_of(spark, ["cat"])).collect()]
    assert got == [(0, 2)]  # weights count the empty chunks too


def test_search_reads_the_index_and_not_the_chunks(spark, small, monkeypatch):
    d = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), R.tokens(F.col("text")).alias("tokens"))
    index = WordIndex(spark, scratch_path(spark, "index"))
    index.rebuild(d)
    read, files, plans = W.written, [], []

    def note(df, name):
        files.extend(df.inputFiles())
        plans.append(df._jdf.queryExecution().toString())
        return read(df, name)

    monkeypatch.setattr(W, "written", note)
    found = index.search(asked_of(spark, ["the of and"]))
    assert found.count() and files and not any("documents.parquet" in f for f in files)
    filters = {f for p in plans for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", p) if "bucket" in f}
    assert filters and all(1 <= len(re.findall(r"\d+", f.split("IN")[-1])) <= 4 for f in filters)  # the buckets of three tokens


def test_pruning_scores_a_fifth_of_the_pairs(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    d = d.select(F.col("doc_id").alias("chunk_id"), R.tokens(F.col("text")).alias("tokens"))
    b = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    b = b.select(F.col("item_id").alias("query_id"), R.tokens(F.col("text")).alias("tokens"))
    index = WordIndex(spark, scratch_path(spark, "index"))
    index.rebuild(d)
    found, scored = index.search_counted(b, 20, ("query_id",))
    each = d.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("token"))
    pairs = each.join(b.select("query_id", F.explode("tokens").alias("token")), "token").select("query_id", "chunk_id").distinct()
    assert found.count() == 20 * b.count()
    assert 5 * scored.count() <= pairs.count()


def test_rows_to_be_stored_are_shuffled_once(spark, tmp_path):
    """Taking each key once and dealing rows over partitions is one shuffle."""
    rows = spark.range(1000).select(F.sha2((F.col("id") % 7).cast("string"), 256).alias("file_hash"), (F.col("id") % 500).alias("chunk_index"), F.lit("x").alias("text"))
    table = ChunkTable(spark, str(tmp_path / "t"))
    once = table._once(rows)
    assert once._jdf.queryExecution().sparkPlan().toString() and once._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    keys = rows.distinct().count()
    assert table.append(rows) == keys and table.read().count() == keys == table.read().select("pk").distinct().count()
    assert "cell" not in table.read().columns and "hash_prefix" not in table.read().columns


def test_a_replaced_file_meets_held_rows_whatever_their_number(spark, tmp_path, monkeypatch):
    import paperloom.sources.chunk_table as module

    rows = spark.range(60).select((F.col("id") % 6).cast("string").alias("file_hash"), F.col("id").alias("chunk_index"), F.lit("old").alias("text"))
    for most in (0, 100):
        monkeypatch.setattr(module, "FEW_FILES", most)
        table = ChunkTable(spark, str(tmp_path / f"t{most}"))
        table.append(rows)
        table.replace(rows.where("file_hash < '2' AND chunk_index < 30").withColumn("text", F.lit("new")))
        got = {tuple(r) for r in table.read().groupBy("file_hash", "text").count().collect()}
        assert got == {("0", "new", 5), ("1", "new", 5), *((str(i), "old", 10) for i in range(2, 6))}


def test_a_larger_table_is_streamed_from_more_files(spark, small, tmp_path, monkeypatch):
    from paperloom.plans import streaming

    monkeypatch.setattr(streaming, "scratch_path", lambda _, name: str(tmp_path / name))
    for most, cost in (("128m", "4m"), ("48k", "1k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        parts = spark.read.parquet(f"{small}/documents.parquet").rdd.getNumPartitions()
        monkeypatch.setattr(streaming, "scratch_path", lambda _, name, most=most: str(tmp_path / f"{name}-{most}"))
        streaming.streamed(spark, small, "documents")
        files = list((tmp_path / f"documents-{most}").glob("*.parquet"))
        assert len(files) <= 4 * -(-parts // 4) and (most == "128m" or len(files) > 4)
        assert spark.read.parquet(str(tmp_path / f"documents-{most}")).count() == spark.read.parquet(f"{small}/documents.parquet").count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_the_state_of_messages_is_dealt_by_their_table_and_not_by_the_sessions_partitions(spark, small, tmp_path, monkeypatch):
    """Each partition costs a task, a worker and a commit a batch."""
    from paperloom.plans import streaming

    monkeypatch.setattr(streaming, "scratch_path", lambda _, name: str(tmp_path / name))
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        kept = streaming.stream_memory(spark, small)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
        newest = spark.read.parquet(f"{small}/conversations.parquet").groupBy("conv_id").count()
        assert kept.count() == newest.select(F.sum(F.least("count", F.lit(5)))).first()[0]
        dealt = [p for p in (tmp_path / "memory/checkpoint/state/0").iterdir() if p.name.isdigit()]
        assert len(dealt) == 2 * spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", "3")  # what a session asks for is the most
        assert streaming.state_partitions(spark, small, "conversations") == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)


def test_texts_below_the_first_han_character_are_cut_without_looking_up_scripts(spark):
    low = spark.createDataFrame([("".join(chr(i) for i in range(1, 0x2E80)),), ("né 漢字語 a_1",), ("ab漢c",), ("日本 \U00020000\U00020001x",)], "text string")
    assert low.where(F.col("text").rlike(r"\p{IsHan}")).count() == 3
    got = [r[0] for r in low.select(R.tokens(F.col("text"))).collect()]
    assert got[1:] == [["né", "漢字", "字語", "a_1"], ["ab", "漢", "c"], ["日本", "\U00020000\U00020001", "x"]]
    assert "IsHan" not in str(low.select(R.tokens(F.col("text")))._jdf.queryExecution().analyzed()).split("ELSE")[-1]


def test_searches_in_passes_give_the_same_hits_and_leave_nothing_but_them(spark, monkeypatch, tmp_path):
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame([(i, [words[(i * j) % 30] for j in range(1, 8)]) for i in range(200)], "chunk_id long, tokens array<string>")
    queries = spark.createDataFrame([(i, [words[i], words[(7 * i) % 30]]) for i in range(20)], "query_id long, tokens array<string>")
    from paperloom.sources import scratch

    for m in (scratch, W):
        monkeypatch.setattr(m, "scratch_path", lambda _, name: f"{tmp_path}/{name}-{len(list(tmp_path.rglob('*')))}")
    index = WordIndex(spark, str(tmp_path / "index"))
    index.rebuild(chunks)
    whole = sorted(map(tuple, index.search(queries, 5).collect()))
    monkeypatch.setattr(W, "PASS_PAIRS", 1_000)
    assert sorted(map(tuple, index.search(queries, 5).collect())) == whole and whole
    left = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert left == {"index", "hits"} and len(list(tmp_path.glob("hits-*"))) == 5
