"""Rules of single operators on hand-made rows."""

from __future__ import annotations

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import markdown
from paperloom.functions.text import folded
from paperloom.operators import catalog, chunking, cleaning, context, conversation, evaluation, planning, retrieval
from paperloom.operators import quantiles as Q
from paperloom.operators.lexicon import best_path, tokenize_by_lexicon
from paperloom.operators.quantiles import exact_quantiles
from paperloom.plans import chunking as chunk_plans


def hits(spark, *lists):
    rows = [(1, no, rank, pk, "same text") for no, pks in enumerate(lists) for rank, pk in enumerate(pks, 1)]
    return spark.createDataFrame(rows, "query_id long, list_no int, rank int, pk long, text string")


@pytest.mark.parametrize(("lists", "order"), [(([1, 2], [2, 3]), [2, 1, 3]), (([1, 1], [2]), [1, 2])])
def test_fusion_order(spark, lists, order):
    assert [r.pk for r in retrieval.rrf_fusion(hits(spark, *lists)).orderBy("fused_rank").collect()] == order


def test_candidate_k(spark):
    modes = spark.createDataFrame([("fast",), ("balanced",), ("quality",)], "mode string")
    assert [r[0] for r in modes.select(planning.candidate_k(F.col("mode"), F.lit(9))).collect()] == [8, 12, 20]


def test_rerank_fallbacks(spark):
    rows = spark.createDataFrame(
        [(1, "quality", i, s) for i, s in ((1, 0.1), (2, None), (3, 0.9))],
        "query_id long, mode string, fused_rank int, relevance_score double",
    )
    order = lambda **k: [r.fused_rank for r in retrieval.rerank_topn(rows, 2, **k).orderBy("rank").collect()]
    assert order() == [3, 1]
    assert order(failed=F.lit(True)) == [1, 2]
    assert order(enabled=False) == [1, 2, 3]


def test_gate(spark):
    rows = spark.createDataFrame(
        [(1, 0.1), (1, 0.05), (2, None), (3, float("nan")), (4, 0.3), (4, 0.0)], "query_id long, relevance_score double"
    )
    assert sorted(r.query_id for r in retrieval.answerability_gate(rows, 0.2).collect()) == [2, 3, 4, 4]


def test_bm25(spark):
    none = retrieval.tokenize_chunks(spark.createDataFrame([], "chunk_id long, text string, raw_text string"))
    ask = spark.createDataFrame([(7, ["pear", "pear"])], "query_id long, tokens array<string>")
    assert retrieval.bm25_search(none, ask).count() == 0
    rows = [(1, "[章节: pear]\nplum fig", "plum fig"), (2, "pear cake", "pear cake"), (3, "oat milk", ""), (4, "东京大学", "东京大学")]
    held = retrieval.tokenize_chunks(spark.createDataFrame(rows, "chunk_id long, text string, raw_text string"))
    assert [(r.chunk_id, r["rank"], r.score > 0) for r in retrieval.bm25_search(held, ask).collect()] == [(2, 1, True)]
    assert held.where("chunk_id = 4").first().tokens == ["东京", "京大", "大学"]
    assert held.where("chunk_id = 3").first().tokens == ["oat", "milk"]


def test_dense_search_by_each_metric(spark):
    v = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [9.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "chunk_id long, vector array<double>"
    )
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    first = lambda m: retrieval.dense_search(v, q, 1, m).first().chunk_id
    assert (first("cosine"), first("dot"), first("l2")) == (1, 2, 1)
    cut = retrieval.dense_search(v, q, 2, slab_rows=1, block_rows=1)
    assert sorted(map(tuple, cut.collect())) == sorted(
        map(tuple, retrieval.dense_search(v, q, 2).collect())
    ) and cut.count() == 2


def chunk_rows(spark):
    rows = [(f"p{p}", c, 10 * p + c, f"text {p}{c}", c + 1, c + 1) for p in (1, 2) for c in range(5)]
    return spark.createDataFrame(
        rows, "parent_id string, child_index long, chunk_index long, raw_text string, page_start long, page_end long"
    ).withColumns({"filename": F.lit("f"), "section": F.lit("s")})


def test_parent_context(spark):
    chunks = chunk_rows(spark)
    picked = spark.createDataFrame([(1, 1, 12), (1, 2, 10), (1, 3, 24)], "query_id long, rank int, chunk_index long")
    found = retrieval.parent_context(picked.join(chunks, "chunk_index"), chunks).orderBy("context_no").collect()
    assert [
        (r.parent_id, r.matched_chunk_index, r.window_start, r.window_end, r.page_start, r.page_end) for r in found
    ] == [("p1", 12, 1, 3, 2, 4), ("p2", 24, 3, 4, 4, 5)]
    assert found[0].text == "text 11\n\ntext 12\n\ntext 13"
    whole = retrieval.parent_context(picked.join(chunks, "chunk_index"), chunks, radius=-1, max_chars=40).collect()
    assert [(r.parent_id, r.child_count) for r in whole] == [("p1", 5)]  # the second would pass the limit
    alone = retrieval.parent_context(
        picked.join(chunks, "chunk_index"), chunks.where("parent_id = 'none'")
    ).orderBy("context_no").collect()
    assert [r.text for r in alone] == ["text 12", "text 24"]


def test_query_plan_lists(spark):
    rows = [
        (1, " q ", "quality", "r", "h"),
        (2, "PT-001 是什么问题呢请说明白一点", "quality", "r", "h"),
        (3, "它呢", "balanced", None, "h"),
        (4, "它呢", "fast", "r", "h"),
    ]
    made = planning.enhancement_policy(
        spark.createDataFrame(rows, "query_id long, query string, mode string, rewrite string, hyde string")
    )
    lists = {
        i: [
            (r.kind, r.text) for r in sorted(
                planning.query_plan(made).where(f"query_id = {i}").collect(), key=lambda r: r.list_no
            )
        ] for i in (1, 2, 3, 4)
    }
    assert lists[1] == [("dense", "q"), ("sparse", "q"), ("dense", "r"), ("dense", "h"), ("sparse", "r")]
    assert all(len(lists[i]) == 2 for i in (2, 3, 4))


def test_repeated_lines(spark):
    rows = [
        ("f", p, f"Report 2024 page {p}\nbody {'abcde'[p]} text\n| kept |") for p in range(4)
    ] + [("g", 1, "a line\nb"), ("g", 2, "a line\nc"), ("f", None, "Report 2024 page 9")]
    found = cleaning.strip_repeated_lines(spark.createDataFrame(rows, "file string, page long, text string")).collect()
    texts = {(r.file, r.page): r.text for r in found}
    assert texts["f", 0] == "body a text\n| kept |" and texts["g", 1] == "a line\nb" and texts["f", None] == "Report 2024 page 9"


def test_exactly_the_share_is_no_noise(spark):
    rows = [("f", p, "footer" if p < 2 else f"own {'abcde'[p]}x") for p in range(5)]
    assert cleaning.strip_repeated_lines(
        spark.createDataFrame(rows, "file string, page long, text string")
    ).where("text = 'footer'").count() == 2


def test_image_budget_over_jobs(spark):
    schema = "job string, task string, seq long, content string"
    cache = spark.createDataFrame([], "task string, image_hash string")
    first = cleaning.image_budget(
        spark.createDataFrame([("1", "ocr", 1, "a"), ("1", "ocr", 2, "b"), ("1", "ocr", 3, "a")], schema), cache, 1
    )
    assert [r.seq for r in first.collect()] == [1]
    assert cleaning.image_budget(spark.createDataFrame([("2", "ocr", 1, "a")], schema), first, 1).count() == 0


def test_semantic_chunks(spark):
    units = spark.createDataFrame([(1, "甲乙丙。" * 3), (2, "only one")], "doc_id long, text string")
    none = chunking.semantic_chunks(units, ["doc_id"], embed=lambda t: F.array(F.lit(0.0)))  # zero vectors: no breaks
    assert sorted((r.doc_id, r.text) for r in none.collect()) == [(1, "甲乙丙。" * 3), (2, "only one")]
    text = "".join(f"{'a' * 30}{i}。" for i in range(9)) + "zz。"
    away = chunking.semantic_chunks(
        spark.createDataFrame([(1, text)], "doc_id long, text string"),
        ["doc_id"],
        embed=lambda t: F.when(
            F.startswith(t, F.lit("zz")), F.array(F.lit(0.0), F.lit(1.0))
        ).otherwise(F.array(F.lit(1.0), F.lit(0.0))),
    )
    assert away.orderBy("part").collect()[-1].text == "zz。"  # a short tail is a text of its own


def test_partitions_make_no_difference(spark):
    rows = [(f"h{f}", f"f{f}", u, u + 1, f"# S{u}\n\n" + "word and word. " * 60) for f in range(3) for u in range(3)]
    units = spark.createDataFrame(rows, "file_hash string, filename string, unit_no long, page long, text string")
    made = [sorted(map(tuple, chunking.parent_child_chunks(units.repartition(n)).collect()), key=repr) for n in (1, 4, 16)]
    assert made[0] == made[1] == made[2] and len(made[0]) > 9


def test_schema_violations_and_listing(spark):
    rows = spark.createDataFrame([(1, "a" * 40, None), (2, "b", [1.0])], "pk long, chunk_type string, vector array<float>")
    assert {(r.rule, r.rows) for r in catalog.schema_violations(rows, dim=2).collect()} == {
        ("chunk_type longer than 32", 1), ("vector is null", 1), ("vector size is not 2", 1)
    }
    files = spark.createDataFrame(
        [(1, "b", None, "h"), (2, "a", None, "h"), (3, "c", 5, "h")],
        "pk long, filename string, upload_time long, file_hash string",
    )
    assert [r.filename for r in catalog.list_documents(files).collect()] == ["c", "a", "b"]


def test_replace_ingest(spark):
    old = spark.createDataFrame([("x", 1), ("y", 2)], "file_hash string, pk long")
    new = spark.createDataFrame([("x", 3), ("x", 4)], "file_hash string, pk long")
    assert sorted(r.pk for r in catalog.replace_ingest(old, new).collect()) == [2, 3, 4]


def test_citations(spark):
    sources = spark.createDataFrame(
        [(q, n, f"{'ab'[n - 1]}.md") for q in (1, 2) for n in (1, 2)], "query_id long, source_no int, filename string"
    )
    answers = spark.createDataFrame([(1, "see [2], [2] and [7]"), (2, "nothing")], "query_id long, answer string")
    assert sorted(
        (r.query_id, r.filename, r.citation_index) for r in context.select_sources(answers, sources).collect()
    ) == [(1, "b.md", 2), (2, "a.md", 1), (2, "b.md", 2)]


def test_memory_keeps_the_newest_hundred(spark):
    rows = spark.range(101).selectExpr("1 AS conv_id", "id AS turn", "100 - id AS created_at")
    kept = [r.turn for r in conversation.memory_retention(rows).collect()]
    assert len(kept) == 100 and 0 not in kept and kept[0] == 100


def test_history_labels(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", " 你好 "), (1, 1, "assistant", " "), (2, 0, "system", " ")],
        "conv_id long, turn long, role string, text string",
    )
    assert {r.conv_id: r.history for r in conversation.format_history(rows).collect()} == {1: "用户: 你好", 2: "（无）"}


def test_cache_and_manifest(spark):
    samples = spark.createDataFrame([("q",)], "question string")
    stored = lambda print_, version=evaluation.CACHE_VERSION: spark.createDataFrame(
        [("q", "a", ["c"], print_, version)],
        "question string, response string, contexts array<string>, fingerprint string, version int",
    )
    hit = lambda cache: evaluation.eval_cache_join(samples, cache, "f").first().hit
    assert (hit(stored("f")), hit(stored("g")), hit(stored("f", 1))) == (True, False, False)
    keys = spark.createDataFrame([(i, i % 3) for i in range(50)], "pk long, upload_time long")
    prints = {
        evaluation.corpus_manifest(k, {"b": 1, "a": 2}).first().fingerprint for k in (
            keys, keys.orderBy(F.desc("pk")).repartition(7)
        )
    }
    assert len(prints) == 1 and evaluation.corpus_manifest(keys, {"a": 2, "b": 1}).first().fingerprint in prints


def test_uneven_test_set_is_an_error(spark):
    rows = spark.createDataFrame(
        [(1, ["q"], [["a"], ["b"]])], "set_id long, questions array<string>, ground_truths array<array<string>>"
    )
    with pytest.raises(Exception, match="differ in number"):
        evaluation.testset_rows(rows).collect()


def test_context_metrics(spark):
    verdicts = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1)], "q_no int, rank int, relevant int")
    statements = spark.createDataFrame([(1, 1), (1, 0)], "q_no int, covered int")
    row = evaluation.context_metrics(verdicts, statements).first()
    assert (row.context_precision, row.context_recall) == (round((1 + 2 / 3) / 2, 6), 0.5)


def jaccard(a, b):
    a, b = set(a) - {None}, set(b) - {None}
    return len(a & b) / len(a | b) if a or b else 0


@pytest.mark.parametrize("most", [3, 2_000])
@pytest.mark.parametrize("threshold", [0.01, 0.3, 0.6, 1.0])
def test_overlap_edges_against_all_pairs(spark, threshold, most):
    rng = random.Random(2)
    sets = [["all", *(f"e{rng.randrange(12)}" for _ in range(rng.randrange(8)))] for _ in range(40)] + [[], ["all", "all"], None, [None], [None, "all"]]
    found = evaluation.overlap_edges(spark.createDataFrame(list(enumerate(sets)), "pk long, entities array<string>"), threshold, most).collect()
    assert sorted((r.left_pk, r.right_pk, r.score) for r in found) == [
        (i, j, round(jaccard(sets[i], sets[j]), 6)) for i, j in combinations(range(len(sets)), 2)
        if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= threshold
    ]


def test_classes_stand_for_groups_of_copies(spark):
    """A group of copies is compared once, and an entity that all chunks have meets by parts."""
    made = spark.range(30_000).select(
        F.col("id").alias("pk"),
        F.when(F.col("id") < 20_000, F.array(F.lit("hot"), F.lit("copy"))).otherwise(
            F.array(F.lit("hot"), F.concat(F.lit("own"), F.col("id")), F.concat(F.lit("two"), (F.col("id") / 2).cast("long")))
        ).alias("entities"),
    )
    pairs, members = evaluation.overlap_classes(made, 0.5, most=500)
    want = {(i, i + 1, 0.5) for i in range(20_000, 30_000, 2)}
    assert {(r.left, r.right, r.score) for r in pairs.collect()} == want
    groups = members.groupBy("class").count().collect()
    assert len(groups) == 10_001 and {r["class"]: r["count"] for r in groups}[0] == 20_000


def test_sets_of_a_hot_entity_are_dealt_over_cells(spark):
    """All sets share one entity and nothing else: the pairs of parts hold about a part's sets a side."""
    made = spark.range(3_000).select(F.col("id").alias("pk"), F.array(F.lit("hot"), F.col("id").cast("string")).alias("entities"))
    pairs, _ = evaluation.overlap_classes(made, 0.3, most=200)
    assert pairs.agg(F.count("*"), F.min("score"), F.max("score")).first() == (3_000 * 2_999 // 2, 1 / 3, 1 / 3)


def plain_semantic(text, spread=1.5, least=40, most=1000):
    """Semantic chunks of one text, sentence by sentence; longer ones are left whole."""
    cut = re.sub("([。！？!?；;])", r"\1\n", text).split("\n")
    s = [x.strip() for x in cut if x.strip()]
    v = [np.array([len(x) - len(x.lower().replace(c, "")) for c in "aeiounst"], dtype=float) for x in s]
    near = [a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) if a.any() and b.any() else None for a, b in zip(v, v[1:], strict=False)]
    breaks = [False] * len(s)
    if near and None not in near:
        low = np.mean(near) - spread * np.std(near)
        breaks = [x < low for x in near] + [False]
    out, held = [], ""
    for x, b in zip(s, breaks, strict=True):
        held += x
        if b and len(held) >= least:
            out.append(held)
            held = ""
    return out + [held] * bool(held)


def test_semantic_chunks_of_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {}
    for r in sorted(chunking.semantic_chunks(docs, ["doc_id"]).collect(), key=lambda r: (r.doc_id, r.part, r.cut)):
        found.setdefault((r.doc_id, r.part), []).append(r.text)
    expected = {(r.doc_id, i): t for r in docs.collect() for i, t in enumerate(plain_semantic(r.text))}
    assert set(found) == set(expected) and len(expected) > docs.count()
    for key, text in expected.items():
        assert found[key] == ([text] if len(text) <= 1000 else markdown.fixed_pieces(text, 500, 50))


def test_chunks_of_the_tables(spark, small):
    """Children keep their sizes and order, and hold every word of their file but for headings and repeated table heads."""
    units = chunk_plans.marked_units(spark, small)
    text = {r.filename: r.text for r in units.collect()}
    rows = {}
    for r in chunking.parent_child_chunks(units, one_unit=True).collect():
        rows.setdefault(r.filename, []).append(r)
    assert set(rows) <= set(text)
    for name, own in rows.items():
        own.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in own] == list(range(len(own)))
        assert [(r.parent_index, r.child_index) for r in own] == sorted((r.parent_index, r.child_index) for r in own)
        plain = [b for b in markdown.markdown_blocks([(text[name], None)])]
        letters = lambda s: re.sub(r"\s", "", s)
        body = letters("".join(r.raw_text for r in own if r.content_type == "text"))
        assert all(
            p in letters("".join(b.text for b in plain)) for p in [
                letters(r.raw_text) for r in own if r.content_type == "text"
            ]
        )
        assert len(body) <= len(letters(text[name])) and {r.section for r in own} <= {b.section for b in plain}
        assert all(len(r.raw_text) <= 450 + 120 + 2 * r.raw_text.count("\n\n") for r in own if r.content_type == "text")
        assert all(r.text == (f"[章节: {r.section}]\n{r.raw_text}" if r.section else r.raw_text) for r in own)
    for r in chunking.markdown_section_chunks(units).collect():
        prefix = f"[章节: {r.section}]\n"
        assert r.text.startswith(prefix) and len(r.text) - len(prefix) <= max(500 - len(prefix), 100) if r.content_type == "text" else r.text.startswith(f"{prefix}| ")


def test_a_question_that_is_cached_twice_is_one_sample(spark):
    samples = spark.createDataFrame([(1, "q"), (2, "r")], "q_no int, question string")
    rows = [("q", "old", ["c"], 1), ("q", "new", ["d"], 5), ("q", "", ["e"], 9), ("r", "b", ["c"], 1), ("r", "a", ["c"], 1)]
    cache = spark.createDataFrame([(*r, 2, "f") for r in rows], "question string, response string, contexts array<string>, stored_at int, version int, fingerprint string")
    got = {r.q_no: (r.response, r.contexts) for r in evaluation.eval_cache_join(samples, cache, "f").collect()}
    assert got == {1: ("new", ["d"]), 2: ("b", ["c"])}
    assert evaluation.eval_cache_join(samples, cache.drop("stored_at"), "f").count() == 2


def test_first_arrival_of_each_hash_is_stored(spark):
    rows = [("a", 3), ("a", 1), ("b", 2), ("a", 2), ("k", 1), (None, 2), (None, 1)]
    found = catalog.dedupe_ingest(spark.createDataFrame(rows, "file_hash string, arrival int"), spark.createDataFrame([("k",)], "file_hash string"))
    assert sorted((r.file_hash or "", r.arrival) for r in found.where("status = 'stored'").collect()) == [("", 1), ("a", 1), ("b", 2)]
    assert found.count() == len(rows)


def quantiles_of(spark, rows, at, **kwargs):
    df = spark.createDataFrame(rows, "metric string, value double").repartition(4)
    return {r.metric: r.quantiles for r in exact_quantiles(df, at, **kwargs).collect()}


@pytest.mark.parametrize("most", [5, 100_000])
def test_quantiles_equal_those_of_sorted_values(spark, most):
    rng = np.random.default_rng(0)
    given = {
        "even": rng.random(3_000), "steep": rng.lognormal(0, 8, 3_000), "few": rng.integers(0, 3, 2_000).astype(float),
        "heavy": np.concatenate([np.full(5_000, 1.5), rng.random(500) * 3]), "one": np.array([7.0]), "two": np.array([1.0, 2.0]),
        "same": np.full(4_000, -2.0),
    }
    rows = [(m, float(v)) for m, vs in given.items() for v in vs] + [("even", None), ("none", None)]
    at = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = quantiles_of(spark, rows, at, most=most, cells=8)
    assert got.keys() == given.keys()
    for m, vs in given.items():
        assert got[m] == pytest.approx(np.quantile(vs, at).tolist(), rel=1e-12)


def test_quantiles_of_no_rows(spark):
    assert quantiles_of(spark, [], (0.5,)) == {} == quantiles_of(spark, [("a", None)], (0.5,))


def test_quantiles_of_ten_million_values_sort_few_in_a_task(spark, monkeypatch):
    n, seen = 10_000_000, []
    rows = spark.range(n).select(F.lit("m").alias("metric"), ((F.col("id") * 7_919) % n).cast("double").alias("value"))
    ranked = Q._ranked
    monkeypatch.setattr(Q, "_ranked", lambda held, ranges: seen.extend(ranges) or ranked(held, ranges))
    got = exact_quantiles(rows, (0.5, 0.95)).first().quantiles
    assert got == pytest.approx([(n - 1) * 0.5, (n - 1) * 0.95])
    assert seen and sum(r.inside for r in seen) <= 2 * Q.SORTED


def one_file(spark, *pages: str):
    rows = [("0123456789abcdef" * 4, "f.md", i, i + 1, text) for i, text in enumerate(pages)]
    return spark.createDataFrame(rows, "file_hash string, filename string, unit_no long, page long, text string")


def test_rows_of_parents_and_children(spark):
    units = one_file(
        spark,
        "# A\nOne. Two.\n\n| h |\n| --- |\n| r1 |",
        "## B\nThree is here. Four.\n# C\nAaaa bbbb. Cccc dddd. Ee.",
        "# D\nXxxx yyyy zzzz wwww. Q.\n\nGoes",
        "on",
    )
    expected = [  # section, content, parent, child, raw text, first and last page
        ("A", "text", 0, 0, "One. Two.", 1, 1),
        ("A", "table", 0, 1, "| h |\n| --- |\n| r1 |", 1, 1),
        ("A > B", "text", 1, 0, "Three is here. Four.", 2, 2),
        ("C", "text", 2, 0, "Aaaa bbbb.", 2, 2),
        ("C", "text", 2, 1, "Cccc dddd. Ee.", 2, 2),
        ("D", "text", 3, 0, "Xxxx yyyy zzzz wwww.", 3, 3),
        ("D", "text", 3, 1, "Q.\n\nGoes\non", 3, 4),
    ]
    rows = chunking.parent_child_chunks(units, parent_size=60, child_size=20, least=5).orderBy("chunk_index").collect()
    assert [tuple(r[c] for c in ("section", "content_type", "parent_index", "child_index", "raw_text", "page_start", "page_end")) for r in rows] == expected
    for i, (r, (section, _, parent, _, raw, first, _)) in enumerate(zip(rows, expected, strict=True)):
        assert (r.chunk_index, r.filename, r.file_hash, r.chunk_type, r.page) == (i, "f.md", "0123456789abcdef" * 4, "parent_child", first)
        assert (r.text, r.parent_id) == (f"[章节: {section}]\n{raw}", f"0123456789abcdef-p{parent:05d}")
    short = chunking.parent_child_chunks(one_file(spark, "Xxxx yyyy zzzz wwww. Q."), parent_size=60, child_size=20, least=5)
    assert [(r.raw_text, r.text, r.section) for r in short.collect()] == [("Xxxx yyyy zzzz wwww.\n\nQ.",) * 2 + ("",)]  # too short to be alone


def test_rows_of_fixed_pieces_and_sections(spark):
    fixed = chunking.fixed_chunks(one_file(spark, "aa bb cc dd ee", "one\n\ntwo"), size=5, overlap=2).orderBy("unit_no", "piece").collect()
    assert [(r.unit_no, r.piece, r.page, r.chunk_type, r.section, r.content_type, r.text) for r in fixed] == [
        (0, i, 1, "fixed", "", "text", t) for i, t in enumerate(["aa bb", "bb cc", "cc dd", "dd ee"])
    ] + [(1, i, 2, "fixed", "", "text", t) for i, t in enumerate(["one", "two"])]
    text = "# A\nA text that is long enough.\n| h |\n| --- |\n| r |\n# B\nshort\n## C\nAnother text that is long enough."
    sections = chunking.markdown_section_chunks(one_file(spark, text)).orderBy("piece").collect()
    assert [(r.piece, r.section, r.content_type, r.text) for r in sections] == [
        (0, "A", "text", "[章节: A]\nA text that is long enough."),
        (1, "A", "table", "[章节: A]\n| h |\n| --- |\n| r |"),
        (2, "B > C", "text", "[章节: B > C]\nAnother text that is long enough."),
    ]


def test_folding_is_that_of_all_letters(spark):
    """Characters of any case form the groups that full case folding forms."""
    cased = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x1F000)]) if c.isprintable() and len({c, c.lower(), c.upper(), c.casefold()}) > 1]
    got, want = {}, {}
    for r in spark.createDataFrame([(c,) for c in cased], "c string").select("c", folded(F.col("c")).alias("f")).collect():
        got.setdefault(r.f, set()).add(r.c)
        want.setdefault(r.c.casefold(), set()).add(r.c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_requests_that_differ_in_case_alone_are_one(spark):
    asked = ["Straße", " STRASSE\n", "strasse", "ΟΔΟΣ", "οδος", "οδοσ", "ıx", "ix", "IX", "１", "1", "\u212a", "k", None]
    rows = [(i, "c", q, 4, ["h"], "m", "s") for i, q in enumerate(asked)]
    schema = "request_id int, collection string, query string, top_k int, history array<string>, model string, switches string"
    once, members = planning.request_dedupe(spark.createDataFrame(rows, schema))
    assert sorted(r.request_id for r in once.collect()) == [0, 3, 6, 7, 9, 10, 11, 13]
    assert members.count() == len(asked)


def every_cut(run):
    if not run:
        yield []
    for i in range(1, len(run) + 1):
        for rest in every_cut(run[i:]):
            yield [run[:i], *rest]


def test_best_path_is_the_likeliest_of_all_cuts(spark):
    rng = random.Random(4)
    letters = "天地人大小中"
    lexicon = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.randint(1, 9) for _ in range(25)}
    total = sum(lexicon.values())
    runs = ["".join(rng.choices(letters, k=n)) for n in range(1, 10) for _ in range(6)]
    texts = [f"a1 {r}, x_y{r[:1]} -- é" for r in runs] + ["plain words", "", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "pk int, text string").withColumn("raw_text", F.lit(" "))
    words = spark.createDataFrame([*lexicon.items(), ("", 5), ("不", 0), (None, 3)], "word string, count long")
    found = {r.pk: r.tokens for r in tokenize_by_lexicon(chunks, words).collect()}
    for i, run in enumerate(runs):
        def weight(cut):
            return sum(math.log(lexicon.get(w, 1) / total) for w in cut)
        cuts = [c for c in every_cut(run) if all(w in lexicon or len(w) == 1 for w in c)]
        got = found[i]
        assert got[0] == "a1" and got[-1] == "é" and got[-3:-1] == ["x_y", run[0]]
        assert "".join(got[1:-3]) == run and got[1:-3] in cuts
        assert weight(got[1:-3]) == pytest.approx(max(map(weight, cuts)), abs=1e-9)
    assert found[len(runs)] == ["plain", "words"] and found[len(runs) + 1] == [] and found[len(runs) + 2] is None
    with pytest.raises(ValueError, match="more than 3"):
        tokenize_by_lexicon(chunks, words, most_words=3)


def test_of_equal_cuts_the_longest_first_word_counts_and_no_lexicon_means_characters(spark):
    assert best_path("天地人", {"天地": -1.0, "地人": -1.0, "天": -1.0, "人": -1.0}, 2, -9.0) == ["天地", "人"]
    assert best_path("天地", {}, 1, 0.0) == ["天", "地"]


def test_searches_find_words_of_a_lexicon(spark):
    chunks = spark.createDataFrame([(0, "北京大学生活"), (1, "大学"), (2, "生活"), (3, "x")], "chunk_id long, text string").withColumn("raw_text", F.col("text"))
    words = spark.createDataFrame([("北京", 9), ("大学", 9), ("学生", 3), ("生活", 9), ("北京大学", 5)], "word string, count long")
    asked = spark.createDataFrame([(0, "北京大学")], "query_id long, text string").withColumn("raw_text", F.col("text"))
    found = retrieval.bm25_search(tokenize_by_lexicon(chunks, words), tokenize_by_lexicon(asked, words), 5)
    assert [r.chunk_id for r in found.collect()] == [0]
