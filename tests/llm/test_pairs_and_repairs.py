"""Tokenizer alignment, conversation repair and search by products against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from paperloom.llm import alignment, products, repair


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- operator 11


@lru_cache(maxsize=1)
def tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    a, b = tokenizers()
    chars = byte_of()
    done, links = [], []
    for text in texts:
        done.append((0, 0, 0, ""))
        links.append([])
        if not text:
            continue
        ids = a.encode(f" {text}", add_special_tokens=False).ids
        pieces = b.encode(text)
        a_bytes = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids]
        b_bytes = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces
        ]
        if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            continue
        ends = lambda tokens: np.cumsum([len(t) for t in tokens]).tolist()
        ea, eb = ends(a_bytes), ends(b_bytes)
        groups, at = [], {"a": 0, "b": 0}
        for end in sorted(set(ea) & set(eb)):
            own = []
            for side, x, y in (("a", ids, ea), ("b", pieces, eb)):
                upto = y.index(end, at[side]) + 1
                own.append(",".join(map(str, x[at[side] : upto])))
                at[side] = upto
            groups.append("|".join(own))
        ending = dict(zip(eb, pieces, strict=True))
        links[-1] = [(ending[e], x) for x, e in zip(ids, ea, strict=True) if e in ending]
        done[-1] = (len(ids), len(pieces), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    counts = Counter(p for own in links for p in own)
    highest: dict[int, int] = {}
    for (y, _), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    return [
        (d[0], d[1], d[2], len(own), sum(counts[p] == highest[p[0]] for p in own), sum(counts[p] for p in own), d[3])
        for d, own in zip(done, links, strict=True)
    ]


ODD_TEXTS = [
    None, "", " ", "  ", "a", "a  b", " lead", "trail ", "a\n b", "a\n \n  b\t c", "<|endoftext|> </s> <s> [INST]", "<0x41> x", "a▁b",
    "\x00 nul", "ﬁne ﬁ", "é é ü ß", "日本語の 文 です。", "don't 'll x's", "1 234 5678", "😀 🏳️‍🌈 x", " no break  em", "x\r\ny  z",
    "the the the the", "the the the the",
]


def test_alignment_of_odd_texts_equals_encoding_whole_texts(spark):
    rng = random.Random(7)
    mixed = ["".join(rng.choice(["a", " ", "  ", "\n", "the", "é", "▁", "'s", "12", ".", "日", "\t", " Zürich"]) for _ in range(30)) for _ in range(150)]
    texts = [*ODD_TEXTS, *mixed, "ab" * 40_000, "word " * 20_000]
    rows = [(i if i % 5 else None, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, pairs string").repartition(5)
    got, pairs = alignment.align_tokenizers(docs, buffer_records=300, cell_records=200)
    want = sorted([(r[0], *w) for r, w in zip(rows, plain_alignment(texts), strict=True)], key=repr)
    assert rows_of(got) == want
    held = pairs.collect()
    top = Counter()
    for r in held:
        top[r.b_id] = max(top[r.b_id], r["count"])
    assert all(r.highest == (r["count"] == top[r.b_id]) for r in held)
    assert sum(r["count"] for r in held) == sum(w[4] for w in want)


def test_alignment_of_the_table_equals_plain_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(held, plain_alignment([r.text for r in held]), strict=True)), key=repr)
    assert rows_of(alignment.align_tokenizers(docs)[0]) == want
    assert rows_of(alignment.align_tokenizers(docs.repartition(7), bits=2, buffer_records=2_000, cell_records=1_000)[0]) == want


def test_alignment_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got, pairs = alignment.align_tokenizers(docs)
    assert got.collect() == pairs.collect() == []


def test_runs_are_merged_in_the_order_of_pairs():
    rng = np.random.default_rng(3)
    runs, want = [], Counter()
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 2**40, 6_000, dtype=np.uint64) % np.uint64(9_000))
        times = rng.integers(1, 5, len(pairs))
        want.update(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
        runs.append((pairs, times))
    assert list(alignment.merged(runs)) == sorted(want.items())


# --- operator 12

SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of one conversation's rows."""
    mark = lambda r: hashlib.sha256(f"{len(r[1])} {r[1]}{r[2]}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:100], mark(r)))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACES)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    turn_of = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = [{s: (0, "") for s in ("", "a")}]
    behind = {}

    def closed(at):
        out = {}
        for s in after:
            ways, here = [], s
            for k in range(4):
                if here in at:
                    ways.append((5 * k + at[here][0], "I" * k + at[here][1]))
                here = turn_of[here]
            out[s] = min(ways)
        return out

    best = closed({s: (0, "") for s in ("", "a")})
    for (_, role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
        at = {}
        for s in after:
            ways = [(2 + best[s][0], "D" + best[s][1])]
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                if role[:1] in after[s]:
                    ways.append((more + best[role[:1]][0], "K" + best[role[:1]][1]))
                ways.append((more + 1 + best[turn_of[s]][0], "R" + best[turn_of[s]][1]))
            at[s] = min(ways)
        best = closed(at)
    cost, audit = best[""]
    names, s, given, out = {"u": "user", "a": "assistant"}, "", iter(rows), []
    for e in audit:
        row = next(given) if e != "I" else None
        if e == "D":
            continue
        s = row[1][:1] if e == "K" else turn_of[s]
        out.append(f"{row[1] if e == 'K' else names[s]}:{row[2] if row else ''}")
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def plain_repairs(rows):
    ids, by = {r[0] for r in rows if r[0] is not None}, {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    return {i: plain_repair(by.get(i, [])) for i in ids}


def some_conversations(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ünd"]
    texts = ["Yes.", "No!", "cut", " ", "", "\t\n", None, "Why? ", "so .x", " ", "Yes.", "a\nb."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(9)):
            number = rng.choice([turn, turn, turn, turn + 3, None, -turn])
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.randrange(40)}."
            rows.append((conv, number, role, text))
    return rows


def test_repairs_equal_the_least_of_all_edits(spark):
    rows = some_conversations(5, 400)
    rows += [(None, 1, "user", "left out."), (-7, 2**62, "user", "A."), (-7, -(2**62), "assistant", "B.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, seg int")
    got = {r[0]: tuple(r)[1:] for r in repair.repair_digests(df.repartition(6)).collect()}
    spaced = [(c, t, *(" " if x is None else x for x in y)) for c, t, *y in rows]
    assert got == plain_repairs([r for r in spaced if r[0] is not None])


def test_damaged_conversations_equal_the_plain_version(spark, small):
    given = spark.read.parquet(f"{small}/conversations.parquet")
    odd = spark.createDataFrame(some_conversations(6, 300), "conv_id long, turn long, role string, text string")
    for table in (given.select("conv_id", "turn", "role", "text"), odd):
        rows = [tuple(r) for r in table.collect()]
        got = {r[0]: tuple(r)[1:] for r in repair.repaired_digests_of_damaged(table).collect()}
        want = plain_repairs([r for r in plain_damage(rows) if r[0] is not None])
        assert got == {c: want.get(c) or plain_repair([]) for c in {r[0] for r in rows}}


def test_one_long_conversation_goes_over_many_segments(spark):
    rng = random.Random(2)
    rows = [
        (1, t // 2 if t % 7 == 0 else t, rng.choice(["user", "assistant", "assistant", "system", "x"]), rng.choice(["Yes.", f"No {t}.", "", f"t{t}"]))
        for t in range(9_000)
    ]
    rows += [(2, 1, "user", "long " * 1_200_000 + "."), (2, 2, "assistant", "B" * 5_000_000), (2, 3, "user", "!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_digests(df).collect()}
    assert got == plain_repairs(rows)
    turns = repair.repaired_turns(df).where("conv_id = 1").orderBy("position").collect()
    assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in turns))
    assert "".join(r.edit for r in turns) == got[1][6].replace("D", "")
    assert [r.position for r in turns] == list(range(len(turns)))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == got[1][7]


def test_repair_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired_digests_of_damaged(none).collect() == repair.repaired_turns(none).collect() == []


def test_block_tables_hold_every_vector_that_turns_lead_to():
    t = repair.tables()
    assert len(t.vectors) < 200  # few, as inserts bound what states differ by
    rng = random.Random(1)
    for _ in range(300):
        symbols = "".join(rng.choice("012345678") for _ in range(rng.randrange(30)))
        cost = t.end
        for x in reversed(symbols):
            cost = repair._before(cost, int(x))
        _, vector, total = t.behind(t.blocks(symbols), t.first)
        assert [c + total for c in t.vectors[vector]] == list(cost)
        assert t.ahead_of(np.array(t.summary(symbols)), t.first) == vector


# --- operator 13


def plain_products(vectors: dict[int, list[float]], every: int, k: int) -> list[tuple]:
    whole = {i: [int(np.floor(1024.0 * x)) for x in v] for i, v in vectors.items()}
    out = []
    for q, v in whole.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole.items() if i != q and len(w) == len(v))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def some_vectors(n: int, dim: int, seed: int = 0) -> np.ndarray:
    """Vectors of many lengths, some near each other, some repeated."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * rng.lognormal(0, 1.5, size=(n, 1))
    v[n // 2 :: 3] = v[0] + 0.01 * rng.normal(size=v[n // 2 :: 3].shape)
    v[5::11] = v[4]
    return v


@pytest.mark.parametrize("parts", [(32_768, 4_096, 1_024), (40, 7, 30)])
def test_products_equal_brute_force(spark, parts):
    v = some_vectors(900, 6)
    rows = [(i - 100, [float(x) for x in v[i]]) for i in range(len(v))]
    rows += [(2_000, [0.0] * 6), (2_010, [1.0, 2.0]), (2_020, [-1.0, 0.5]), (2_030, []), (2_040, [])]
    nan, inf = float("nan"), float("inf")
    odd = [(3_000, None), (3_010, [nan] + [0.0] * 5), (3_020, [inf] * 6), (3_030, [None] * 6), (None, [1.0] * 6), (0, rows[100][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, bucket int, chunk string").repartition(5)
    held = products.build_buckets(df).cache()
    got = products.largest_products(held.where("vec_id % 10 = 0"), held, 4, *parts)
    assert rows_of(got) == plain_products(dict(rows), 10, 4)


def test_products_of_vectors_of_one_length_and_one_hot_vector(spark):
    v = some_vectors(600, 8, seed=4).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[::3] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(len(v))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(products.products_of_every(df)) == plain_products(dict(rows), 100, 10)


def test_products_beyond_a_long_end_there(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1e9, 3.0]), (100, [3.0e8, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in products.products_of_every(df).orderBy("query_id", "rank").collect()]
    most = 2**63 - 1
    assert got[:4] == [(0, 1, 1, most), (0, 2, 3, most), (0, 3, 100, most), (0, 4, 2, -most)]
    exact = int(1e9 * 1024) * int(3e8 * 1024) + 3072 * 5120
    assert [r[2:] for r in got[4:]] == [(0, most), (1, most), (3, min(exact, most)), (2, -most)]


def test_products_of_no_rows_and_one(spark):
    schema = "vec_id long, embedding array<float>"
    assert products.products_of_every(spark.createDataFrame([], schema)).collect() == []
    assert products.products_of_every(spark.createDataFrame([(100, [1.0])], schema)).collect() == []


def test_search_tells_by_length_and_by_coordinates():
    rng = np.random.default_rng(8)
    spiky = rng.normal(size=(20_060, 32)) ** 5  # a few components stand out
    spiky /= np.linalg.norm(spiky, axis=1, keepdims=True)
    v = np.concatenate([spiky[:60], 0.98 * spiky[:60], spiky[60:] * rng.uniform(0.9, 1.0, (20_000, 1))])  # one bucket
    v = np.floor(1024 * v).astype(np.int64)
    ids, q = np.arange(len(v)), np.arange(60)
    for floors in (np.full(60, products.NONE), None):
        if floors is None:
            floors = np.sort(v[q] @ v.T, axis=1)[:, -2]
        at, found, score, told = products.search(q, v[q], floors, ids, v, 1)
        want = v[q] @ v.T
        want[q, q] = products.NONE
        assert found[np.argsort(at)].tolist() == want.argmax(axis=1).tolist()
        assert score[np.argsort(at)].tolist() == want.max(axis=1).tolist()
    assert told["length"] > 0 and told["coordinate"] > 0
    assert told["product"] < len(q) * len(v) / 2
