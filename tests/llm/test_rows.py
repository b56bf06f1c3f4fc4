"""Row-wise operators, rollups, mixing, packing and the pipeline against brute force."""

from __future__ import annotations

import random
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import chat, mixing, packing, pii, quality, queries, rollup, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "two words"), (6, "a b c a b c"), (7, "Ä ß x " * 4000)
]


def odd(spark, *clashing):
    return spark.createDataFrame(
        [(i, t, "en", None if i == 3 else f"s{i % 2}" if i else "s1", 0) for i, t in ODD], DOCS
    ).withColumns({c: F.lit("x") for c in clashing})


# packing


@pytest.fixture(scope="module")
def whole_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == list(
            np.cumsum([0] + [n for _, n in places])[:-1]
        ) and sum(n for _, n in places) <= capacity
    return len(by)


def test_packed_documents(spark, small, whole_tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.packed_documents(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for doc_id in text:
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = np.array([*whole_tokenizer.encode(text[doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert [r.start for r in own] == list(
            np.cumsum([0] + [r.length for r in own])[:-1]
        ) and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
        assert all(r.length == 2048 for r in own[1:]) and (len(own) == 1 or len(ids) > 2048)
    assert check_layout(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_packing_odd_rows(spark, whole_tokenizer):
    docs = odd(spark, "length", "piece", "ids", "row", "len", "share")
    pieces = packing.tokenize_pieces(docs, capacity=16)
    rows = packing.pack_best_fit(pieces, 16).collect()
    check_layout(rows, 16)
    assert Counter(r.doc_id for r in rows if r.doc_id != 7) == Counter([1, 2, 3, 4, 4, None, 6])
    assert {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    done = packing.packed_sequences(packing.pack_best_fit(pieces, 16)).collect()
    assert all(len(r.ids) == 4 * r.length for r in done) and sum(r.length for r in done) == sum(r.length for r in rows)
    assert packing.packed_documents(docs.where("doc_id > 99")).count() == 0


def test_long_white_space_takes_the_whole_tokenizer(whole_tokenizer):
    text = "a" + " " * 1_000_000 + "b"
    assert packing.encoder(packing.RANKS, packing.FULL)(text).tolist() == whole_tokenizer.encode(
        text, add_special_tokens=False
    ).ids


@pytest.mark.parametrize(
    "text",
    [
        "a<|endoftext|>b",
        "<|endoftext|>",
        " <|endoftext|> \n<|endoftext|><|endoftext|>x",
        "<|endoftext",
        "|><|endoftext|>é 漢",
        "a" + " " * 600_000 + "<|endoftext|> b",
    ],
)
def test_added_tokens_are_tokens(spark, whole_tokenizer, text):
    ids = whole_tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.encoder(packing.RANKS, packing.FULL)(text).tolist() == ids
    if len(text) < 100:
        row = packing.packed_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert row.ids_crc32 == zlib.crc32(np.array([*ids, 0], dtype="<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_is_best_fit(counts):
    slots, used = packing.plan_best_fit(counts, 40)
    room, places = {}, {}
    for length, lo, hi, first, each, offset in slots:
        for rank in range(lo, hi):
            places.setdefault(length, set()).add(rank)
            room.setdefault(first + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
    assert {n: set(range(c)) for n, c in counts.items()} == places and len(room) == used
    for items in room.values():
        items.sort()
        assert [o for o, _ in items] == list(np.cumsum([0] + [n for _, n in items])[:-1]) and sum(n for _, n in items) <= 40
    free = []  # best-fit decreasing, document by document
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        i = min(fits, key=lambda i: free[i]) if fits else len(free)
        free[i:i] = [] if fits else [40]
        free[i] -= length
    assert used == len(free)


# mixing


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    found = queries.QUERIES[name](spark, small)
    expected = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    pick = lambda r: repr(tuple(r[c] for c in sorted(columns)))
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(pick, (r.asDict() for r in found.collect()))) == sorted(
        pick(dict(zip(columns, r, strict=True))) for r in expected.fetchall()
    )


def test_mixing_odd_rows(spark):
    docs = odd(spark, "size", "target", "taken", "place", "share", "name")
    rows = mixing.mixed_sizes(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns and copies.count() <= sum(r.taken // r.size for r in rows if r.size)
    assert mixing.mixed_sizes(docs.where("doc_id > 99")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mix_stays_within_its_budget(spark, sf):
    """Every source ends within a word of its target, by whole documents but for the one in service at the cut."""
    rows = mixing.mixed_sizes(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    total = sum(r.size for r in rows)
    taken, target, parts = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        parts[r.source] += bool(r.size) and r.taken % r.size > 0
    assert all(0 <= target[s] - taken[s] < 1 for s in target) and max(parts.values()) <= 1
    assert 1.5 * total - len(target) <= sum(taken.values()) <= 1.5 * total


def test_the_mix_is_cut_in_the_order_of_finish_times_over_all_sources(spark, small):
    rows = mixing.mixed_sizes(spark.read.parquet(f"{small}/documents.parquet")).collect()
    queue = sorted((f, r.size) for r in rows for f in (r["first"], r["second"]) if r.size)
    whole = [size for f, size in queue if f <= 1]
    assert len({r.source for r in rows}) > 1 and 0 < sum(whole) <= 1.5 * sum(r.size for r in rows) and len(whole) < len(queue)
    for r in rows:
        done = (r["first"] <= 1) + (r["second"] <= 1)
        assert done * r.size <= r.taken <= min(2, done + 1) * r.size


def test_one_document_of_most_words_is_served_in_part(spark):
    rows = [(i, "w " * (40_000 if i == 3 else 5), "en", "a" if i < 20 else "b", 0) for i in range(200)]
    got = mixing.mixed_sizes(spark.createDataFrame(rows, DOCS)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert 0 <= own[0].target - sum(r.taken for r in own) < 1 and all(r.taken <= 2 * r.size for r in own)


def test_equal_rows_of_one_id_stay_within_the_budget(spark):
    rows = [(1, "a b c", "en", "s", 0)] * 40 + [(None, "d e", "en", "s", 0)] * 30 + [(2, "f", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert (mixing.mix_documents(docs).selectExpr("sum(size(split(text, ' ')))").first()[0] or 0) <= 1.5 * 181


def test_targets_are_shared_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    limit, weight = {"a": 200, "b": 2000, "c": 2000, None: 100}, {"a": 3, "b": 1, "c": 2, None: 3}
    share, fixed = {}, {}
    while True:
        left, rest = 1.5 * 2150 - sum(fixed.values()), [s for s in limit if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > limit[s]]
        if not over:
            break
        fixed |= {s: limit[s] for s in over}
    assert got == pytest.approx(fixed | share)


def test_reruns_and_partitions_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    runs = [sorted(map(tuple, mixing.mixed_sizes(d).collect())) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]


# quality


def brute_measures(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(
        re.findall(r"[#*$%&|<>]", text or "")
    ), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(
        odd(spark).select("doc_id", "text")
    )
    found = quality.quality_verdicts(
        docs.withColumns({c: F.lit("x") for c in ("words", "lines", "n_words", "quality")})
    ).collect()
    given_ = Counter((r.doc_id, brute_measures(r.text)) for r in docs.collect())
    assert Counter(
        (r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in found
    ) == given_
    assert all(
        r.base_failed == (
            r.n_words < 50 or 2 * r.n_repeat_words > r.n_words
        ) and not (r.base_failed and r.kept) for r in found
    )
    assert quality.quality_verdicts(docs.where("doc_id > 9999999")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_verdicts_agree_with_labels(spark, sf):
    folder = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet")).join(
        labels.withColumnRenamed("quality", "label"), "doc_id"
    ).where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.label == 1], [r.kept for r in rows if r.label == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_rule_fit_against_plain_em(spark):
    rules = quality.RULES[:2]
    rows = [(1, 1)] * 600 + [(-1, 1)] * 80 + [(-1, -1)] * 9 + [(1, -1)] * 30 + [(0, 1)] * 50 + [(1, 0)] * 20
    voted = spark.createDataFrame(rows, "vote_symbols int, vote_lines int")
    first = [0.9, 0.05, 0.05], [[0.97, 0.97], [0.1, 0.8], [0.8, 0.1]]
    shares, rates = [list(x) for x in first]
    for _ in range(40):
        likely = []
        for row in rows:
            p = [
                s * np.prod(
                    [{1: r, -1: 1 - r, 0: 1}[v] for v, r in zip(row, rate, strict=True)]
                ) for s, rate in zip(shares, rates, strict=True)
            ]
            likely.append([x / sum(p) for x in p])
        shares = [(sum(p[c] for p in likely) + 200 * first[0][c]) / (len(rows) + 200) for c in range(3)]
        rates = [
            [
                (sum(p[c] for p, v in zip(likely, rows, strict=True) if v[j] == 1) + 200 * first[1][c][j])
                / (sum(p[c] for p, v in zip(likely, rows, strict=True) if v[j]) + 200)
                for j in range(2)
            ]
            for c in range(3)
        ]
        rates = [[min(0.99, max(0.01, x)) for x in r] for r in rates]
    model = quality.fit_rules(voted, rules)
    assert (*model.shares, *sum(model.rates, ())) == pytest.approx((*shares, *sum(rates, [])), abs=0.02)
    got = voted.distinct().withColumn("p", model.posterior(rules)).collect()
    for r in got:
        p = [
            s * np.prod(
                [{1: x, -1: 1 - x, 0: 1}[v] for v, x in zip(r[:2], rate, strict=True)]
            ) for s, rate in zip(model.shares, model.rates, strict=True)
        ]
        assert r.p == pytest.approx([x / sum(p) for x in p])


# chat


def test_chat_states_are_those_of_the_machine_turn_by_turn(spark):
    """Whatever the number of turns, before, at and after the end of a block."""
    rng = random.Random(3)
    roles = [[rng.choice(["system", "user", "assistant", "user", "tool", ""]) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 129)]
    roles += [["user", "assistant"] * n for n in (32, 100)] + [["system", *["user", "assistant"] * 70, "tool", "user"]]
    rows = spark.createDataFrame([(i, [(r,) for r in own]) for i, own in enumerate(roles)], "i int, turns array<struct<role:string>>")
    for r in rows.select("i", chat.CHAT.states(F.col("turns")).alias("states")).collect():
        state, want = "start", []
        for role in roles[r.i]:
            state = chat.MOVES.get((state, role), chat.WRONG + role)
            want.append(state)
        assert r.states == want


def test_chat_round_trip(spark):
    said = [
        "</s>[INST] ok [/INST]",
        "back\\slash <|im_end|> \\<|im_start|>",
        "<|im_<|im_sep|>sep|>",
        "",
        None,
        "\\",
        "<<SYS>>\n<</SYS>> <\\s>",
    ]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(said)] + [
        (1, 0, "user", said[0]), (2, None, "odd <|im_sep|>\n", "x"), (2, 5, None, "y"), (None, 1, "assistant", "z")
    ]
    frame = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"
    ).withColumns({c: F.lit(1) for c in ("turns", "segments", "valid")})
    order = lambda c: [
        (r or "", t or "") for _, n, r, t in sorted(
            (x for x in rows if x[0] == c), key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or "")
        )
    ]
    made = {
        r.conv_id: r for r in chat.format_conversations(frame).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn(
            "learned", chat.learned_text(F.col("segments"))
        ).collect()
    }
    for c in (1, 2, None):
        assert [(t.role, t.text) for t in made[c].back] == order(c)
        assert made[c].learned == "".join(t for r, t in order(c) if r == "assistant")
        assert made[c].formatted.count("<|im_start|>") == len(order(c)) and made[c].formatted.count("</s>") == 0
    assert chat.conversation_digests(frame.where("conv_id = 99")).count() == 0


@pytest.mark.parametrize(
    ("roles", "valid"),
    [
        ("sua", True),
        ("ua", True),
        ("uaua", True),
        ("u", False),
        ("a", False),
        ("uu", False),
        ("uaa", False),
        ("us", False),
        ("x", False),
    ],
)
def test_turn_order(spark, roles, valid):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    frame = spark.createDataFrame(
        [(1, i, names[r], "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string"
    )
    row = chat.format_conversations(frame).first()
    assert row.valid is valid
    # bad orders are written all the same, and their learned texts are marked
    assert [s.loss for s in row.segments] == [x for r in roles for x in (False, r == "a", False)]


def test_digests_tell_bad_orders_and_take_very_long_texts(spark):
    rows = [
        (1, 0, "user", "x<|im_end|>" * 200_000),
        (1, 1, "assistant", "\\" * 1_000_000),
        (2, 0, "assistant", "y"),
        (2, 1, "assistant", "z"),
        (3, 0, None, None),
    ]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3000)]
    found = {
        r.conv_id: r for r in chat.conversation_digests(
            spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        ).collect()
    }
    assert {i: r.valid for i, r in found.items()} == {1: True, 2: False, 3: False, 4: True}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in found:
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert found[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in own))
        assert found[c].loss_sha256 == sha("".join(t for r, t in own if r == "assistant"))


# personal data

KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_spans(text):
    def passes(kind, s):
        d = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(
                x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))
            ) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [
        (i, *m.span()) for i, (kind, pattern) in enumerate(KINDS) for m in re.finditer(pattern, text) if passes(kind, m.group())
    ]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ ()1259é_", max_size=60))
def test_base_spans(text):
    assert pii.scan(text)[0] == brute_spans(text)


def test_personal_data(spark):
    texts = [
        "mail me at a.b@c.org, card 4111 1111 1111 1111.",
        "call (826) 555-4081 or +1 (826) 555-4081",
        "order 4111 1111 1111 1112 at 10.0.0.256",
        "write to jane at example dot com now",
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("spans", "base", "n_email")}
    )
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    listed = lambda s: ",".join(f"{KINDS[k][0]}:{a}:{b}" for k, a, b in s)
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest() and rows[i].n_card == sum(
            k == 2 for k, _, _ in base
        )
        assert set(listed(base).split(",")) - {""} <= set(rows[i].spans.split(","))
    assert "phone:5:19" in rows[1].spans and rows[2].spans == ""
    clean = {r.doc_id: r.text for r in pii.without_personal_data(docs).collect()}
    assert clean[0] == "mail me at [EMAIL], card [CARD]." and clean[2] == texts[2] and clean[4] is None
    assert pii.personal_data(docs.where("doc_id > 99")).count() == 0


def test_personal_data_odd_rows(spark):
    long = "words of no kind " * 100_000 + "a.b@c.org " + "1 " * 200_000
    more = [(8, long, "en", "s", 0), (None, "x@y.de", "en", "s", 0), (None, "x@y.de", "en", "s", 0)]
    docs = odd(spark).unionByName(spark.createDataFrame(more, DOCS)).withColumns(
        {c: F.lit("x") for c in ("spans", "base", "others", "kind", "n_ip")}
    )
    rows = pii.personal_data(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter([*(i for i, _ in ODD), 8, None, None])
    at = long.index("a.b@")
    assert next(r.spans for r in rows if r.doc_id == 8).split(",")[0] == f"email:{at}:{at + 9}"
    assert [r.spans for r in rows if r.doc_id is None].count("email:0:6") == 2
    clean = pii.without_personal_data(docs)
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in rows)


def test_reliabilities_against_plain_em():
    rng = np.random.default_rng(3)
    votes = np.array([[rng.choice([1, -1, 0]) for _ in pii.LABELERS] for _ in range(30)])
    n = rng.integers(1, 40, 30).astype(float)
    start = list(pii.TRUST.values())
    prior, t, f = 0.5, list(start), [1 - x for x in start]
    for _ in range(50):
        p = []
        for row in votes:
            x, y = prior, 1 - prior
            for j, v in enumerate(row):
                x *= {1: t[j], -1: 1 - t[j], 0: 1}[v]
                y *= {1: f[j], -1: 1 - f[j], 0: 1}[v]
            p.append(x / (x + y))
        prior = (sum(a * b for a, b in zip(n, p, strict=True)) + 25) / (n.sum() + 50)
        for j, s in enumerate(start):
            for side, q, mean in ((t, p, s), (f, [1 - x for x in p], 1 - s)):
                cast = sum(c * x for c, x, r in zip(n, q, votes, strict=True) if r[j])
                good = sum(c * x for c, x, r in zip(n, q, votes, strict=True) if r[j] == 1)
                side[j] = min(0.99, max(0.01, (good + 50 * mean) / (cast + 50)))
    got = pii.reliabilities(votes, n)
    assert (got.prior, *got.on_true, *got.on_false) == pytest.approx((prior, *t, *f), abs=1e-9)


def test_added_spans_of_the_tables(spark):
    """Candidates that fail their test stay out, and numbers that only run into others are found."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    added = []
    for r in pii.personal_data(docs).collect():
        base = {f"{KINDS[k][0]}:{a}:{b}" for k, a, b in brute_spans(text[r.doc_id] or "")}
        added += [(r.doc_id, *s.split(":")) for s in r.spans.split(",") if s and s not in base]
    found = [(kind, text[i][int(a) : int(b)]) for i, kind, a, b in added]
    assert found and all(kind == "phone" and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", s) for kind, s in found), found


# toxicity


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.02


def biased(spark, term="women"):
    """Labelled texts in which a group's name goes with the label; every fifth or so is held out."""
    rows, marks = [], []
    for i in range(900):
        toxic = i % 3 == 0
        group = term if toxic and i % 2 == 0 else "neighbours"
        rows.append(
            (
                i,
                f"Some words{i % 7} first. The {group} next door are {'rotten scum' if toxic else 'kind people'} word{i % 50}.",
            )
        )
        marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_neutral_mentions_keep_their_scores(spark):
    """The gap between mentions of groups in clean sentences shrinks, and the label is still learned."""
    docs, labels = biased(spark)
    free, held = (toxicity.fit_toxicity(docs, labels, swap_weight=w) for w in (0.0, 10.0))
    texts = [f"the {g} next door are kind people word{k}" for k in range(50) for g in ("women", "men", "girls")]

    def gap(model):
        scores = np.log(1 / (1 / model.scores(pd.Series(texts), {}) - 1)).reshape(-1, 3)
        return np.abs(scores - scores[:, 2:]).max()

    assert held.pairs > 500 and gap(free) > 0.5 and gap(held) < 0.2 * gap(free)
    assert held.weights["scum"] > 0.5 and held.scores(
        pd.Series(["kind people", "rotten scum"]), {}
    ).round().tolist() == [0, 1]


def test_counterfactuals():
    kinds = (("cat", "dog"), ("red", "blue", "green"))
    found = toxicity.counterfactuals("A cat sat. No more! The red dog ran", 0, kinds)
    assert found == [
        ({"a", "cat", "sat"}, {"a", "dog", "sat"}), ({"the", "red", "dog", "ran"}, {"the", "blue", "cat", "ran"})
    ]
    for text in (None, "", "Plain words. Nothing else."):
        plain, other = toxicity.counterfactuals(text, 5, kinds)
        assert plain[1] == other[0] and len(plain[1] - plain[0]) == 1 and len(other[0] ^ other[1]) == 2
    assert toxicity.counterfactuals("a", 1, ()) == []


def test_pairs_on_the_tables(spark):
    """Texts that name no group still give pairs, so the penalty is never empty."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.training_rows(docs, labels, 10_000, "doc_id", "text").collect()
    assert len(rows) > 50 and all(any(p.minus or p.plus for p in r.pairs) for r in rows)


def test_fit_against_a_dense_one():
    """The loss is that of gradient descent over dense matrices, to its end."""
    rng = np.random.default_rng(2)
    x = (rng.random((300, 12)) < 0.3).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(0, 2, 12) - 1)))).astype(float)
    pairs = [([0], [1, 2], 5), ([], [3], 1), ([4, 5], [6], 2)]
    change = np.zeros((3, 12))
    for k, (minus, plus, _) in enumerate(pairs):
        change[k, minus], change[k, plus] = -1, 1
    often = np.array([5, 1, 2]) / 8

    def loss(b, w):
        z = x @ w + b
        return np.mean(
            np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z
        ) + 0.5e-3 * w @ w + 10 * often @ (change @ w) ** 2

    b, w = 0.0, np.zeros(12)
    for _ in range(40_000):
        off = (1 / (1 + np.exp(-(x @ w + b))) - y) / 300
        b, w = b - 0.05 * off.sum(), w - 0.05 * (x.T @ off + 1e-3 * w + 20 * change.T @ (often * (change @ w)))
    got = toxicity._fit([np.flatnonzero(r).tolist() for r in x], y, pairs, 12, 0.0, 10.0, 1e-3)
    assert loss(*got) <= loss(b, w) * 1.001 and np.abs(got[1] - w).max() < 0.1


def test_toxicity_odd_rows(spark):
    docs = odd(spark, "score", "predicted", "words")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (99, 1), (6, 7)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity_scores(docs.where("doc_id > 99"), labels).count() == 0


def test_the_sample_bounds_rows_and_not_ids(spark):
    docs = spark.createDataFrame([(n % 2 + 1, f"text {n}") for n in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, 10, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in rows) == sorted({r.doc_id for r in rows})
    assert toxicity.training_rows(docs, labels, 1, "doc_id", "text").count() <= 1


# rollups


@pytest.mark.parametrize("compact_every", [1, 2, 16])
def test_rollup_batches(spark, tmp_path, compact_every):
    schema = "doc_id long, version string, op string, source string, lang string, tokens long, seq long"
    batches = [
        [
            (1, "v", "insert", "a", "en", 10, 0),
            (2, "v", "insert", "a", None, None, 0),
            (3, "v", "insert", "b", "en", 7, 0),
            (3, "v", "insert", "b", "en", 8, 1),
            (None, "v", "insert", "a", "en", 5, 0),
        ],
        [(1, "v", "delete", "zz", "zz", 99, 0), (9, "v", "delete", "a", "en", 1, 0), (2, "v", "revise", "a", "fr", 4, 0)],
        [(1, "v", "insert", "a", "en", 3, 0), (3, "w", "insert", "b", "en", 2, 0)],
    ]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    totals = lambda r: {(x.source, x.lang, x.version): (x.docs, x.tokens) for x in r.totals().collect()}
    kept = rollup.TokenRollup(spark, str(tmp_path / "one"), compact_every)
    assert totals(kept) == {}
    assert kept.commit(0, frames[0])
    assert totals(kept) == {("a", "en", "v"): (1, 10), ("a", None, "v"): (1, 0), ("b", "en", "v"): (1, 8)}
    assert [kept.commit(1, frames[1]), kept.commit(1, frames[1]), kept.commit(2, frames[2])] == [True, False, True]
    assert not any(kept.commit(again, frames[again]) for again in (0, 2, 1))
    assert totals(kept) == {
        ("a", "en", "v"): (1, 3), ("a", "fr", "v"): (1, 4), ("b", "en", "v"): (1, 8), ("b", "en", "w"): (1, 2)
    }
    assert {
        (r.doc_id, r.version): r.tokens for r in kept.counts().collect()
    } == {(1, "v"): 3, (2, "v"): 4, (3, "v"): 8, (3, "w"): 2}


CHANGE = "doc_id long, version string, op string, source string, lang string, tokens long"


def test_a_late_batch_is_an_error_and_not_passed_over(spark, tmp_path):
    kept = rollup.TokenRollup(spark, str(tmp_path / "one"), 2)
    batch = lambda n: spark.createDataFrame([(n, "v", "insert", "a", "en", n)], CHANGE)
    for n in (1, 3, 4):
        assert kept.commit(n, batch(n))
    assert not kept.commit(3, batch(3))  # applied, although a snapshot stands for it
    for n in (0, 2):
        with pytest.raises(ValueError, match="comes after"):
            kept.commit(n, batch(n))
    assert [r.tokens for r in kept.totals().collect()] == [8]


def test_a_batch_reads_the_partitions_of_its_keys(spark, tmp_path):
    import re

    kept = rollup.TokenRollup(spark, str(tmp_path / "one"))
    kept.commit(0, spark.createDataFrame([(n, "v", "insert", "a", "en", n) for n in range(200)], CHANGE))
    found = kept.counts(spark.createDataFrame([(7, "v"), (7, "w")], "doc_id long, version string"))
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = \d+\)?\]", plan)
    assert [(r.doc_id, r.tokens) for r in found.collect()] == [(7, 7)]


@pytest.mark.parametrize("broken", ["ledger", "deltas"])
def test_a_commit_that_fails_leaves_nothing(spark, tmp_path, monkeypatch, broken):
    from pyspark.sql.readwriter import DataFrameWriter

    change = lambda n: spark.createDataFrame(
        [(1, "v", "insert", "a", "en", n)],
        "doc_id long, version string, op string, source string, lang string, tokens long",
    )
    kept = rollup.TokenRollup(spark, str(tmp_path / "one"))
    kept.commit(0, change(5))
    plain = DataFrameWriter.parquet

    def failing(self, path, *more, **options):
        plain(self, path, *more, **options)
        if f"/{broken}/" in path:
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", failing)
        with pytest.raises(RuntimeError):
            kept.commit(1, change(7))
    assert [r.tokens for r in kept.totals().collect()] == [5]
    assert kept.commit(1, change(7)) and [r.tokens for r in kept.totals().collect()] == [7]


def test_corpus_totals_against_plain_counts(spark, small, tmp_path, whole_tokenizer):
    """Also with odd rows: null, empty and very long texts, repeated and missing ids, clashing columns."""
    real = spark.read.parquet(f"{small}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars"
    ).where("doc_id > 10")
    more = spark.createDataFrame([(7, "one", "en", "s1", 0), (8, "a #b", "fr", None, 0), (9, None, None, "s", 0)], DOCS)
    for n, docs in enumerate((real.unionByName(odd(spark)).unionByName(more), odd(spark).where("doc_id > 99"))):
        rows = [r for r in docs.collect() if r.doc_id is not None]
        first, held = {}, {}
        for r in sorted(rows, key=lambda r: r.doc_id):
            first.setdefault(r.text, r.doc_id)
        for r in rows:
            words, tokens = len(WORD.findall(r.text or "")), len(
                whole_tokenizer.encode(r.text or "", add_special_tokens=False).ids
            )
            for version, count in ((rollup.WORDS_VERSION, words), (rollup.BPE, tokens)):
                row = (True, r.source is not None, r.source or "", r.lang is not None, r.lang or "", count)
                held[r.doc_id, version] = max(row, held.get((r.doc_id, version), row))
        copies = {r.doc_id for r in rows if first[r.text] != r.doc_id}
        revised = {}
        for r in rows:
            if r.doc_id not in copies:
                count = len(re.findall(r"[^\x20\x09-\x0D#*$%&|<>]+", r.text or ""))
                if count != len(WORD.findall(r.text or "")):
                    revised[r.doc_id, rollup.WORDS_VERSION] = (r.source, r.lang, count)
        expected = {}
        for key, (_, has_source, source, has_lang, lang, count) in held.items():
            if key[0] not in copies:
                source, lang, count = revised.get(key, (source if has_source else None, lang if has_lang else None, count))
                docs_, tokens_ = expected.get((source, lang, key[1]), (0, 0))
                expected[source, lang, key[1]] = (docs_ + 1, tokens_ + count)
        clashing = docs.withColumns({c: F.lit("x") for c in ("mark", "words", "tokens", "first", "copy", "version")})
        got = rollup.corpus_totals(clashing, str(tmp_path / str(n))).collect()
        assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in got} == expected


# pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, small)
    assert clean.schema == docs.schema and 0 < clean.count() < docs.count()
    single = stages["near_duplicates"](spark, clean, small)
    marks = [r.component_id for r in simhash.simhash_components(clean, setting=simhash.BY_SIMILARITY).collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(marks))
    private = stages["personal_data"](spark, single, small)
    assert private.columns == docs.columns and all(
        not brute_spans(r.text) and r.n_chars == len(r.text) for r in private.collect()
    )
    mixed = stages["mixing"](spark, private, small)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mixed_sizes(private).collect() if r.size and r.taken >= r.size}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == taken
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == set(taken) and check_layout(rows, 2048)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == taken


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_odd_rows(spark, tmp_path, empty):
    """Null, empty and very long texts, repeated rows, missing ids and columns with clashing names go through all stages."""
    import corpus_pipeline

    names = ("size", "taken", "mix_row", "dropped", "component_id", "node", "score", "spans", "length", "share", "path")
    docs = odd(spark, *names).where("doc_id > 99" if empty else "true")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(4, 0, 0), (6, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    left = [r.doc_id for r in now.collect()]
    assert set(left) <= {4, None, 6, 7} and (empty or 7 in left)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(left)
    check_layout(rows, 2048)
