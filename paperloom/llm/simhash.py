"""Near-duplicate documents by SimHash fingerprints and a binary-trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from paperloom.llm.components import connected_components
from paperloom.llm.storage import written

#: Fingerprint rows of one task's tries.
TASK_ROWS = 200_000
#: Node pairs of a frontier that are walked at once, which bounds a task's memory.
FRONTIER = 1_000_000
#: Bits by which a large sub-trie goes down before it is dealt again.
DEEPER = 4


@dataclass(frozen=True)
class SimHashSetting:
    """What is fingerprinted, and how much two fingerprints may differ to be linked.

    The trie is over the first 64 bits, of which `max_bits` may differ; a longer fingerprint has
    `words` times 64 bits, of which `whole_bits` may differ. `turns` is the number of rotations
    that are walked: some rotation spreads the differing bits so evenly that after each of its
    `turns` blocks no more than a proportionate share of them has been met. A trie leaf holds
    `leaf_rows` fingerprints at most, a sub-trie that one task walks `cell_rows` a side.
    """

    width: int = 3
    words: int = 1
    max_bits: int = 3
    whole_bits: int | None = None
    turns: int = 2
    leaf_rows: int = 1
    cell_rows: int = 20_000

    def budgets(self) -> np.ndarray:
        """The most bits that may differ within the first d of a rotation, for d from 0 to 64."""
        block = 64 // self.turns
        ends = -(-np.arange(65) // block)
        return np.minimum(self.max_bits, self.max_bits * ends // self.turns)


BY_BITS = SimHashSetting()
#: Five-word shingles with a Jaccard score of 0.8 share 0.89 of their numbers, so that 15 % of the
#: bits differ, 39 of 256. 42 and 15 leave room for chance; the README has the recall measured.
BY_SIMILARITY = SimHashSetting(width=5, words=4, max_bits=15, whole_bits=42, turns=4, leaf_rows=8, cell_rows=1 << 20)


def sketch(text: str | None, width: int = 3, seed: int = 42, words: int = 1) -> np.ndarray:
    """SimHash of a whole text, `words` unsigned 64-bit numbers: a bit is set if over half its
    shingles have it set.

    The first number is of the shingles' XXH64, further ones of numbers mixed from it. Words are
    runs without ASCII white space, A-Z lower-cased; a shingle is `width` words joined by a space,
    repeats counted. A text of fewer words is one shingle; one without words gives 0.
    """
    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not own:
        return np.zeros(words, np.uint64)
    runs = zip(*(own[i:] for i in range(width)), strict=False) if len(own) > width else [own]
    count = max(1, len(own) - width + 1)
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in map(b" ".join, runs)), dtype=np.uint64, count=count)
    out = np.empty(words, np.uint64)
    for k in range(words):
        own = hashes if k == 0 else _mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, count, 65_535):
            bits = np.unpackbits(own[at : at + 65_535].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
        out[k] = np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """The numbers with all bits mixed, so that numbers made from one another look unrelated."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text."""
    return int(sketch(text, width, seed)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: SimHashSetting = BY_BITS
) -> DataFrame:
    """(doc_id, fingerprint, sketch): one row per document; the first 64 bits as a signed number,
    and all of them as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sketch(t, setting.width, words=setting.words) for t in b["text"]]
            first = np.array([s[0] for s in found], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": first, "sketch": [s.tobytes() for s in found]})

    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return keys.mapInPandas(run, "doc_id long, fingerprint long, sketch binary")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: SimHashSetting = BY_BITS
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Two documents are linked if their fingerprints differ in no more bits than the setting says; a
    component holds all documents that links reach, and its id is its smallest doc_id.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give
    repeated rows. A null doc_id is kept and never a component's id, unless all of them are null.
    Only the two named columns are read, so others may have any name. No rows give no rows.
    """
    # a fingerprint of 64 bits is its own name; longer ones are named by their hash
    name = F.col("fingerprint") if setting.words == 1 else F.xxhash64("sketch")
    marks = written(fingerprints(docs, id_col, text_col, setting).withColumn("node", name), "fingerprints")
    nodes = marks.groupBy("node").agg(
        F.min("doc_id").alias("first_doc"), F.min("fingerprint").alias("fingerprint"), F.min("sketch").alias("sketch")
    )
    nodes = written(nodes, "nodes")
    groups = connected_components(near_fingerprints(nodes, setting)).withColumnRenamed("node", "member")
    linked = nodes.join(groups, nodes["node"] == groups["member"], "left")
    linked = linked.select("node", "first_doc", F.coalesce("component", "node").alias("component"))
    firsts = linked.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = linked.join(firsts, "component").select(F.col("node").alias("own"), "component_id")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return marks.join(named, marks["node"] == named["own"]).select("doc_id", hexed, "component_id")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: SimHashSetting = BY_SIMILARITY
) -> DataFrame:
    """The documents with the smallest id of each component, once each, with all their columns.

    Rows that repeat an id are one document, which goes if one of them is linked to a smaller id.
    Rows without an id can't be named as copies and stay. Null and empty texts are copies of each
    other. Columns of any other name are kept as they are. No rows give no rows.
    """
    found = written(simhash_components(docs, id_col, text_col, setting), "components").where("doc_id IS NOT NULL")
    same = lambda ids: docs[id_col] == ids["dropped"]
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped")).distinct()
    kept = docs.join(copies, same(copies), "left_anti")
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("dropped"))
    if again.isEmpty():
        return kept
    first = kept.join(again, same(again), "left_semi").dropDuplicates([id_col])
    return kept.join(again, same(again), "left_anti").unionByName(first)


def near_fingerprints(nodes: DataFrame, setting: SimHashSetting = BY_BITS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(src, dst): links that join the same distinct fingerprints as all near pairs do.

    Nodes have node (a number), fingerprint and sketch. For each rotation of the fingerprint there
    is a binary trie, which is joined with itself from its root: pairs of nodes go down together,
    add up their differing bits and end where these exceed what the setting allows at that depth.

    The first levels are walked by Spark: a row of a pair of nodes (a cell) goes to the cells of
    all pairs of their descendants within the budget, until a cell fits in a task. Cells with
    more rows than the setting allows go down further, so a sub-trie that holds most fingerprints
    is parted by its own branches. From there each task walks its cells and gives back a spanning
    star of each group it finds, never all pairs of one.
    """
    n = nodes.count()
    budgets = setting.budgets()
    turns = [
        F.struct(
            F.lit(k).alias("turn"), _rotated(F.col("fingerprint"), k * (64 // setting.turns)).alias("path")
        ) for k in range(setting.turns)
    ]
    rows = nodes.select("node", "sketch", F.explode(F.array(*turns)).alias("t")).select("node", "sketch", "t.turn", "t.path")
    if setting.words == 1:
        rows = rows.drop("sketch")
    rows = rows.withColumns({"own": F.lit(0).cast("long"), "other": F.lit(0).cast("long")})
    depth = max(2, math.ceil(math.log2(max(1, 2 * n / setting.cell_rows))))
    cells, done = _descended(rows, 0, depth, budgets), []
    key = ["turn", "one", "two"]
    while True:
        cells = cells.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other"), "depth": F.lit(depth)})
        large = cells.groupBy(*key).count().where(F.col("count") > 2 * setting.cell_rows).select(*key)
        large = written(large, "large") if depth + DEEPER < 64 else large.limit(0)
        if large.isEmpty():
            break
        done.append(cells.join(large, key, "left_anti"))
        cells = written(cells.join(large, key, "left_semi").drop("one", "two"), "deeper")
        cells, depth = _descended(cells, depth, DEEPER, budgets), depth + DEEPER
    for part in done:
        cells = cells.unionByName(part)
    copies = setting.turns * sum(math.comb(depth, k) for k in range(budgets[depth] + 1)) if not done else 16 * setting.turns
    tasks = max(8, math.ceil(n * copies * setting.words / task_rows))
    cells = cells.withColumn("task", F.pmod(F.xxhash64("turn", "depth", "one", "two"), F.lit(tasks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for d, own in pdf.groupby("depth"):
            path = own["path"].to_numpy(np.int64).view(np.uint64)
            keys = own[["turn", "one", "two"]].to_numpy(np.int64)
            order = np.lexsort((path, *keys.T))
            path, keys, node = path[order], keys[order], own["node"].to_numpy(np.int64)[order]
            more = None
            if setting.words > 1:
                more = np.frombuffer(b"".join(own["sketch"].iloc[order]), np.uint64).reshape(len(path), -1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(path)]
            one, two = keys[starts, 1], keys[starts, 2]
            # the rows of a cell's first node come before those of its second
            mine = (path >> np.uint64(64 - d)).view(np.int64) == keys[:, 1]
            upto = starts + np.add.reduceat(mine, starts, dtype=np.int64)
            pairs = (starts, upto, np.where(one == two, starts, upto), ends, np.bitwise_count(one ^ two).astype(np.int8))
            hung, root = trie_links(path, pairs, int(d), budgets, setting.leaf_rows, more, setting.whole_bits)
            found.append((node[hung], node[root]))
        src, dst = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        return pd.DataFrame({"src": src, "dst": dst})

    return cells.repartition(tasks, "task").groupBy("task").applyInPandas(run, "src long, dst long")


def _descended(rows: DataFrame, depth: int, bits: int, budgets: np.ndarray) -> DataFrame:
    """The rows of pairs of trie nodes (own, other) at a depth, as rows of all pairs of their
    descendants `bits` below that are within the budget there."""
    most = int(budgets[depth + bits])
    masks = [sum(1 << i for i in chosen) for k in range(min(bits, most) + 1) for chosen in combinations(range(bits), k)]
    low = F.col("below").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    others = F.transform(
        F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.shiftleft("other", bits).bitwiseOR(low.bitwiseXOR(m))
    )
    down = rows.withColumn("below", F.shiftrightunsigned("path", 64 - depth - bits))
    down = down.withColumn("next", F.explode(others)).where(F.bit_count(F.col("below").bitwiseXOR(F.col("next"))) <= most)
    return down.withColumns({"own": F.col("below"), "other": F.col("next")}).drop("below", "next")


def trie_links(
    path: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, budgets: np.ndarray, leaf_rows: int = 1,
    more: np.ndarray | None = None, whole_bits: int | None = None, frontier: int = FRONTIER,
) -> tuple[np.ndarray, np.ndarray]:
    """(members, heads), as positions in `path`: a star of each group that near pairs join.

    A trie node is a range of `path`, which is sorted within each node that the walk starts from;
    `pairs` holds the first and end positions of either node, and the bits in which their own paths
    differ. Each step goes down one bit: both nodes to the same side at no price, or to different
    sides at the price of one bit. A pair that is over the budget of its depth ends, and so does
    one whose fingerprints are all of one group already. Two leaves are compared.

    A stack holds frontiers of node pairs of one depth; long ones are cut, so that memory stays
    bounded whatever the number of near pairs. `more` has the longer fingerprints in the order of
    `path`, which must not differ in over `whole_bits` bits.
    """
    n = len(path)
    label = np.arange(n)

    def link(left: np.ndarray, right: np.ndarray) -> None:
        near = np.bitwise_count(path[left] ^ path[right]) <= budgets[64]
        left, right = left[near], right[near]
        if more is not None and len(left):
            near = np.bitwise_count(more[left] ^ more[right]).sum(axis=1, dtype=np.int64) <= whole_bits
            left, right = left[near], right[near]
        _union(label, left, right)

    link(np.arange(n - 1), np.arange(1, n))  # neighbours in the order; it spares many pairs below
    stack = [(depth, *pairs)] if n else []
    while stack:
        d, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > frontier:
            cut = len(a0) // 2
            stack += [(d, *(x[:cut] for x in (a0, a1, b0, b1, diff))), (d, *(x[cut:] for x in (a0, a1, b0, b1, diff)))]
            continue
        turns = np.r_[0, np.cumsum(label[1:] != label[:-1])]  # equal at two places: one group in between
        live = (a0 < a1) & (b0 < b1) & (diff <= budgets[d])
        live[live] = ~(
            (label[a0[live]] == label[b0[live]]) & (turns[a1[live] - 1] == turns[a0[live]]) & (
                turns[b1[live] - 1] == turns[b0[live]]
            )
        )
        a0, a1, b0, b1, diff = (x[live] for x in (a0, a1, b0, b1, diff))
        leaf = (np.maximum(a1 - a0, b1 - b0) <= leaf_rows) if d < 64 else np.ones(len(a0), bool)
        for lo in range(0, int(leaf.sum()), frontier // leaf_rows**2 + 1):
            some = np.flatnonzero(leaf)[lo : lo + frontier // leaf_rows**2 + 1]
            link(*_leaf_pairs(a0[some], a1[some], b0[some], b1[some]))
        a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        ones = np.r_[0, np.cumsum((path >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        turn = ~((a0 == b0) & (a1 == b1))  # a node with itself has one way to part, not two
        down = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, diff + 1),
            (am[turn], a1[turn], b0[turn], bm[turn], diff[turn] + 1),
        ]
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*down, strict=True))))
    root = _roots(label)
    hung = np.flatnonzero(root != np.arange(n))
    return hung, root[hung]


def _leaf_pairs(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    """Every (fingerprint of a, fingerprint of b) with the first at a smaller position."""
    wide = b1 - b0
    count = (a1 - a0) * wide
    pair = np.repeat(np.arange(len(a0)), count)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    left, right = a0[pair] + at // wide[pair], b0[pair] + at % wide[pair]
    first = left < right
    return left[first], right[first]


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _union(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the groups of left[i] and right[i]; a label never points to a larger position."""
    while len(left):
        label[:] = _roots(label)
        x, y = label[left], label[right]
        open_ = x != y
        left, right, x, y = left[open_], right[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
    label[:] = _roots(label)


def _rotated(bits: Column, by: int) -> Column:
    """The 64 bits rotated to the left."""
    return bits if by == 0 else F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by))
