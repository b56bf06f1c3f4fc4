"""Packing tokenized documents into training sequences by a best-fit plan over length counts."""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.storage import written

CAPACITY = 2048
#: Names of the vocabulary: byte-pair ranks for the fast encoder, and its full file.
RANKS, FULL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Rows that share a length and are ranked in one task.
RANK_ROWS = 100_000


@lru_cache(maxsize=2)
def encoder(ranks: str, full: str):
    """A function from text to token ids (an array), as the full tokenizer gives them.

    Both files hold one vocabulary. The rank encoder is several times faster; it knows none of the
    full file's added tokens, by which a text is split first, and can't take runs of white space of
    some hundred thousand characters, where the full tokenizer stands in.
    """
    import public_tokenizers
    import tiktoken

    place = lambda name: name if "/" in name else public_tokenizers.path(name)
    with open(place(ranks), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    with open(place(full), encoding="utf-8") as held:
        added = {t["content"]: t for t in json.load(held)["added_tokens"]}
    # tokens that take in what stands around them are left to the full tokenizer
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added.values())
    split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")

    def whole(text: str) -> list[int]:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(place(full)).encode(text, add_special_tokens=False).ids

    def part(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:
            if type(error).__name__ != "PanicException":
                raise
            return whole(text)

    def encode(text: str) -> np.ndarray:
        ids, at = [], 0
        for token in split.finditer(text) if plain else ():
            ids += part(text[at : token.start()])
            ids.append(added[token.group()]["id"])
            at = token.end()
        ids += part(text[at:]) if plain or not split.search(text) else whole(text)
        return np.asarray(ids, dtype=np.uint32)

    return encode


def tokenize_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0,
    ranks: str = RANKS, full: str = FULL,
) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's tokens and the end id, cut to fit.

    Only a document of more than `capacity` ids is cut: into pieces of that length, the first of
    which may be shorter, so that at most one piece of a document needs a place beside others.
    ids holds unsigned little-endian 32-bit numbers. A null text is empty and has the end id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks, full)
        for b in batches:
            for at in range(0, len(b), 256):  # the ids of a whole batch would be as large as its texts
                rows = []
                for doc_id, text in zip(b["doc_id"].iloc[at : at + 256], b["text"].iloc[at : at + 256], strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    head = len(ids) % capacity if len(ids) > capacity else len(ids)
                    cuts = [0, *range(head or capacity, len(ids), capacity), len(ids)]
                    rows += [
                        (
                            doc_id, k, lo, hi - lo, ids[lo:hi].tobytes()
                        ) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
                    ]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                yield out.astype({"doc_id": "Int64"})

    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return keys.mapInPandas(run, "doc_id long, piece int, start long, length long, ids binary")


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: (slots, number of sequences).

    Lengths go from the longest down; an item goes to the fullest sequence that it fits in. Items
    of one length fill such a sequence as often as it goes, so whole runs of equally full sequences
    are dealt with at once and the work depends on the number of lengths, not of documents.
    A slot is (length, first rank, end rank, first sequence, items a sequence, offset): items with
    these ranks among the pieces of that length go to consecutive sequences.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    slots, used = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit in {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], sizes[at]
            else:
                free, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = free // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - free))
                put(free - each * length, first, full)
            else:
                each, full = left, 1
                slots.append((length, rank, rank + each, first, each, capacity - free))
                put(free - each * length, first, 1)
            put(free, first + full, n - full)
            rank, left = rank + full * each, left - full * each
    return slots, used


def pack_best_fit(
    pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece")
) -> DataFrame:
    """The pieces with sequence_id and offset: where the best-fit plan puts each of them.

    The driver sees one count for each length (at most `capacity` of them) and plans slots from
    these. A piece's slot follows from its rank among the pieces of its length, which is its rank
    within a salted share of that length plus the sizes of the shares before; a length that many
    pieces have is ranked by many tasks. The plan has a few rows a length and is broadcast.
    Repeated pieces each get a place; which of two equal rows comes first makes no difference.
    Pieces without an id are dealt over the shares by where they are stored.
    """
    spark = pieces.sparkSession
    own = F.struct(*pieces.columns).alias("row")
    unnamed = F.when(F.concat(*(F.col(c).cast("string") for c in order_cols)).isNull(), F.monotonically_increasing_id())
    pieces = written(
        pieces.select(own, F.col(length_col).cast("int").alias("len"), F.xxhash64(*order_cols, unnamed).alias("salt")),
        "pieces",
    )
    counts = {r[0]: r[1] for r in pieces.groupBy("len").count().collect()}
    slots, _ = plan_best_fit(counts, capacity)
    shares = max(32, -(-sum(counts.values()) // RANK_ROWS))
    plan = spark.createDataFrame(
        slots, "slot_length int, slot_from long, slot_to long, slot_first long, slot_each long, slot_offset long"
    )

    dealt = pieces.select("row", "len", F.pmod("salt", F.lit(shares)).alias("share"))
    before = Window.partitionBy("len").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("len", "share").count().select(
        "len", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("len", "share").orderBy(*(F.col(f"row.{c}") for c in order_cols)))
    ranked = dealt.withColumn("place", place).join(starts, ["len", "share"]).withColumn(
        "rank", F.col("before") + F.col("place") - 1
    )
    fits = (
        F.col("len") == F.col("slot_length")
    ) & (F.col("rank") >= F.col("slot_from")) & (F.col("rank") < F.col("slot_to"))
    nth = F.col("rank") - F.col("slot_from")
    return ranked.join(F.broadcast(plan), fits).select(
        "row.*",
        (F.col("slot_first") + F.floor(nth / F.col("slot_each"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + nth % F.col("slot_each") * F.col("len")).cast("long").alias("offset"),
    )


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, from pieces that still have ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document has at least one piece (null and empty texts: the end id alone); repeated rows
    and null ids are packed like any others. No rows give no rows. Only the two named columns are
    read. The ids themselves are dropped for their checksum before anything is shuffled.
    """
    pieces = tokenize_pieces(docs, id_col, text_col, capacity)
    return pack_best_fit(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
