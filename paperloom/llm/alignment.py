"""Alignment of two tokenizers over a corpus, with linked pairs counted from spilled runs."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.packing import RANKS
from paperloom.llm.packing import FULL as BYTE_BPE
from paperloom.llm.storage import written

PIECE_BPE = "piece_bpe_32k.model"
#: Runs are cut by so many low bits of the B id; records of a task's buffer and of a cell of runs at most.
RADIX_BITS, BUFFER_RECORDS, CELL_RECORDS = 5, 1_000_000, 4_000_000
#: Pairs that a merge reads of a run at once.
READ_PAIRS = 4_096
#: A pair as one number: the B id above, the A id below.
SHIFT = np.uint64(32)

DIGESTS = "doc_id long, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUN = "radix int, run long, records long, pairs binary, times binary, lengths binary, keys binary, each binary"


class Aligner:
    """Encodes texts by two tokenizers and cuts the tokens where both end."""

    def __init__(self, ranks: str, full: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        place = lambda name: name if "/" in name else public_tokenizers.path(name)
        with open(place(ranks), "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.full = place(full)
        a_bytes = [b""] * (max(merges.values()) + 1)
        for token, rank in merges.items():
            a_bytes[rank] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=place(pieces))
        names = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (a_bytes, b_bytes))
        # what is written for a token that its group goes on after, and for its side's last one of a group
        written_as = [b"%d%b" % (i, end) for i in range(len(a_bytes)) for end in (b",", b"|")]
        written_as += [b"%d%b" % (i, end) for i in range(len(b_bytes)) for end in (b",", b";")]
        self.written_as = np.array(written_as, dtype=object)

    def _a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # runs of white space that the rank encoder can't take
            if type(error).__name__ != "PanicException":
                raise
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(self.full)
            whole.encode_special_tokens = True
            return whole.encode(text, add_special_tokens=False).ids

    def align(self, text: str | None) -> tuple[int, int, np.ndarray, bytes]:
        """(numbers of both tokenizers' tokens, linked pairs, groups as they are written) of a text.

        The second tokenizer adds the space ahead itself. A text whose tokens' bytes aren't the text with
        a space ahead has none.
        """
        none = (0, 0, np.empty(0, np.uint64), b"")
        if not text:
            return none
        whole, a, b = f" {text}".encode(), self._a(f" {text}"), self.b.encode(text, num_threads=1)
        if not b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
            return none
        a, b = np.array(a), np.array(b)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at = np.searchsorted(b_ends, a_ends)
        a_last = np.flatnonzero(b_ends[at] == a_ends)  # both end with the text
        b_last = at[a_last]
        pairs = b[b_last].astype(np.uint64) << SHIFT | a[a_last].astype(np.uint64)
        # a group's tokens of the first side stand behind all earlier groups, those of the second behind them
        codes = np.empty(len(a) + len(b), np.int64)
        a_ended, b_ended = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_ended[a_last], b_ended[b_last] = 1, 1
        a_group, b_group = np.cumsum(a_ended) - a_ended, np.cumsum(b_ended) - b_ended
        codes[np.arange(len(a)) + np.concatenate(([0], b_last + 1))[a_group]] = 2 * a + a_ended
        codes[np.arange(len(b)) + (a_last + 1)[b_group]] = 2 * (len(self.a_bytes) + b) + b_ended
        return len(a), len(b), pairs, b"".join(self.written_as[codes].tolist())[:-1]


@lru_cache(maxsize=2)
def aligner(ranks: str, full: str, pieces: str) -> Aligner:
    return Aligner(ranks, full, pieces)


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def runs_of(pairs: np.ndarray, keys: np.ndarray, each: np.ndarray, name: int, bits: int) -> Iterator[tuple]:
    """Records (pair, document, how often) as zstd runs, one a radix of the B id, in the order of B id, A id and document."""
    radix = (pairs >> SHIFT & np.uint64(2**bits - 1)).astype(np.int32)
    order = np.lexsort((keys, pairs, radix))
    radix, pairs, keys, each = radix[order], pairs[order], keys[order], each[order]
    starts = np.flatnonzero(np.diff(radix, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(radix)], strict=True):
        own, first, length = np.unique(pairs[lo:hi], return_index=True, return_counts=True)
        times = np.add.reduceat(each[lo:hi], first)
        # keys of one pair go up, so their differences are small numbers
        gaps = np.diff(keys[lo:hi], prepend=0)
        yield (
            int(radix[lo]), name, int(hi - lo), _packed(np.diff(own, prepend=np.uint64(0))), _packed(times), _packed(length.astype(np.int64)),
            _packed(gaps), _packed(each[lo:hi].astype(np.int64)),
        )


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """(pair, count) in the order of pairs, from runs of (pairs in order, counts), by a heap of the runs' heads."""

    def read(pairs: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int]]:
        for at in range(0, len(pairs), READ_PAIRS):
            yield from zip(pairs[at : at + READ_PAIRS].tolist(), times[at : at + READ_PAIRS].tolist(), strict=True)

    for pair, same in groupby(heapq.merge(*(read(*r) for r in runs)), key=lambda x: x[0]):
        yield pair, sum(times for _, times in same)


def encode_and_spill(
    docs: DataFrame, id_col: str, text_col: str, ranks: str, full: str, pieces: str, bits: int, buffer_records: int
) -> DataFrame:
    """Rows of two kinds: what each document is by itself, and runs of its tasks' records."""
    names = [c.split()[0] for c in f"{DIGESTS}, {RUN}".split(", ")]
    n_digest = DIGESTS.count(",") + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        made = aligner(ranks, full, pieces)
        task = TaskContext.get().partitionId() << 33
        key = name = task
        kept, n_kept = [], 0

        def spilled() -> pd.DataFrame:
            nonlocal kept, n_kept, name
            columns = (np.concatenate(x) for x in zip(*kept, strict=True))
            rows = [(None,) * n_digest + r for r in runs_of(*columns, name, bits)]
            kept, n_kept, name = [], 0, name + 1
            return frame(rows)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({c: "Int64" for c in ("doc_id", "key", "n_a", "n_b", "n_groups", "n_links", "radix", "run", "records")})

        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                n_a, n_b, pairs, groups = made.align(text)
                own, each = np.unique(pairs, return_counts=True)
                digest = hashlib.sha256(groups).hexdigest() if n_a else ""
                # a group ends where one token of each does, and that is its link
                rows.append((None if pd.isna(doc_id) else int(doc_id), key, n_a, n_b, len(pairs), len(pairs), digest) + (None,) * 8)
                if len(own):
                    kept.append((own, np.full(len(own), key, np.int64), each.astype(np.int64)))
                    n_kept += len(own)
                key += 1
                if n_kept >= buffer_records:
                    yield spilled()
            yield frame(rows)
        if kept:
            yield spilled()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInPandas(run, f"{DIGESTS}, {RUN}")


def _count_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """The counts of a cell's pairs as one run, by merging its runs."""
    runs = [(np.cumsum(_unpacked(p, np.uint64), dtype=np.uint64), _unpacked(t, np.int64)) for p, t in zip(cell["pairs"], cell["times"], strict=True)]
    counted = np.fromiter(merged(runs), dtype=[("pair", np.uint64), ("count", np.int64)])
    pairs = np.diff(counted["pair"], prepend=np.uint64(0))
    return pd.DataFrame({"radix": cell["radix"].iloc[:1], "pairs": [_packed(pairs)], "times": [_packed(counted["count"])]})


def _sum_radix(radix: pd.DataFrame) -> pd.DataFrame:
    """A radix's pairs with their counts over all cells and whether a count is its B id's highest.

    All pairs of a B id are in one radix, and in its order side by side, so one pass over the
    merged runs has the highest counts.
    """
    out = _count_cell(radix)
    pairs = np.cumsum(_unpacked(out["pairs"].iloc[0], np.uint64), dtype=np.uint64)
    counts = _unpacked(out["times"].iloc[0], np.int64)
    first = np.flatnonzero(np.diff(pairs >> SHIFT, prepend=np.uint64(2**32)))
    highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(counts)))
    return out.assign(best=[_packed((counts == highest).astype(np.uint8))])


def _contributions(runs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """What a cell's records give their documents, run by run against the radix's counts, both in one order."""
    if not len(runs):
        return pd.DataFrame({"key": [], "n_best": [], "count_sum": []})
    known = np.cumsum(_unpacked(counts["pairs"].iloc[0], np.uint64), dtype=np.uint64)
    total, best = _unpacked(counts["times"].iloc[0], np.int64), _unpacked(counts["best"].iloc[0], np.uint8)
    out = []
    for r in runs.itertuples():
        pairs = np.cumsum(_unpacked(r.pairs, np.uint64), dtype=np.uint64)
        at = np.repeat(np.searchsorted(known, pairs), _unpacked(r.lengths, np.int64))
        keys, each = np.cumsum(_unpacked(r.keys, np.int64)), _unpacked(r.each, np.int64)
        own, place = np.unique(keys, return_inverse=True)
        n_best, count_sum = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        np.add.at(n_best, place, each * best[at])
        np.add.at(count_sum, place, each * total[at])
        out.append(pd.DataFrame({"key": own, "n_best": n_best, "count_sum": count_sum}))
    return pd.concat(out)


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, full: str = BYTE_BPE,
    pieces: str = PIECE_BPE, bits: int = RADIX_BITS, buffer_records: int = BUFFER_RECORDS, cell_records: int = CELL_RECORDS,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of two tokenizers' tokens over a corpus.

    documents has a row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum
    and groups_sha256. The first tokenizer (A, byte-level) encodes a space and the text, the second
    (B, pieces) the text, whose space it adds. Byte offsets where tokens of both end cut both into
    groups; two tokens that end together are a link, and count_sum adds up, over a document's links,
    how many links of the corpus hold their pair of ids. n_best are the links whose pair is
    the most frequent of its B id. pairs has b_id, a_id, count and whether it is that.

    Each task sorts its records (pair, document, how often) in buffers of bounded size and writes
    them as zstd runs, one a radix of the B id. A radix's runs are dealt over cells of a bounded
    number of records, however common one of its ids is; a cell's runs are merged by a heap and give
    its counts, a radix's cells again give all counts in the order of B ids, hence the
    highest ones, and the runs' records then take their counts back to the documents. Runs are
    in the shared folder, so a lost executor costs the running stage only.

    Texts that are null or empty, or whose tokens' bytes differ from space and text, have no tokens:
    zeros and ''. Repeated rows and rows without an id are documents of their own. Very long texts are
    encoded whole. No rows give none. Only the two named columns are read.
    """
    spilled = written(encode_and_spill(docs, id_col, text_col, ranks, full, pieces, bits, buffer_records), "runs")
    digests = spilled.where("key IS NOT NULL").select(*(c.split()[0] for c in DIGESTS.split(", ")))
    runs = spilled.where("run IS NOT NULL")
    sizes = runs.groupBy("radix").agg(F.ceil(F.sum("records") / cell_records).cast("int").alias("cells"))  # 2^bits rows
    sizes = written(sizes, "radix-sizes")
    celled = runs.join(F.broadcast(sizes), "radix").withColumn("cell", F.pmod(F.xxhash64("run"), F.col("cells")).cast("int"))
    part = celled.select("radix", "cell", "pairs", "times").groupBy("radix", "cell")
    part = part.applyInPandas(_count_cell, "radix int, pairs binary, times binary")
    counts = part.groupBy("radix").applyInPandas(_sum_radix, "radix int, pairs binary, times binary, best binary")
    counts = written(counts, "pair-counts")
    records = celled.select("radix", "cell", "pairs", "lengths", "keys", "each")
    # a copy of a radix's counts goes to each of its cells
    every = counts.join(F.broadcast(sizes), "radix").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cells = records.groupBy("radix", "cell").cogroup(every.drop("cells").groupBy("radix", "cell"))
    back = cells.applyInPandas(_contributions, "key long, n_best long, count_sum long")
    sums = back.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    or_none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    documents = digests.join(sums, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", or_none("n_best"), or_none("count_sum"), "groups_sha256"
    )

    def pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                pairs = np.cumsum(_unpacked(r.pairs, np.uint64), dtype=np.uint64)
                sides = (pairs >> SHIFT).astype(np.int64), (pairs & np.uint64(2**32 - 1)).astype(np.int64)
                best = _unpacked(r.best, np.uint8).astype(bool)
                yield pd.DataFrame({"b_id": sides[0], "a_id": sides[1], "count": _unpacked(r.times, np.int64), "highest": best})

    return documents, counts.mapInPandas(pairs_of, "b_id long, a_id long, count long, highest boolean")
