"""Exact top-k search by inner product over vectors grouped by length."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.nearest import _best
from paperloom.llm.storage import written

#: Lengths in a bucket differ by at most this factor.
RATIO = 0.9
#: Rows of a part of a bucket and queries of a chunk: one task searches one chunk in one part.
PART_ROWS, CHUNK_ROWS = 32_768, 4_096
#: The longest vectors, at least so many of them, are searched first and give every query a threshold.
HEAD_ROWS = 1_024
#: Vectors of a part that are searched at once, in decreasing length, and queries that are.
BLOCK_ROWS, QUERY_ROWS = 4_096, 256
#: Coordinates that a query looks up, and how many of a block's products cost as much as one vector looked up.
FOCUS, LOOKUP_COST = 4, 16
#: What rounding may add to a length, a cosine or a coordinate.
SLACK = 1e-9
#: Stands for no threshold; scores end one above it and at the largest long.
NONE, MOST = -(2**63), 2**63 - 1


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as longs (components beyond a long are its ends)."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def products(queries: np.ndarray, vectors: np.ndarray, pairs: bool = False) -> np.ndarray:
    """Integer inner products: of all queries with all vectors, or row by row.

    Doubles hold them exactly as long as no sum can reach 2^53; beyond that Python's integers do,
    and products beyond a long become its ends.
    """
    if not len(queries) or not len(vectors):
        return np.empty(len(queries) if pairs else (len(queries), len(vectors)), np.int64)
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    exact = most(queries) * most(vectors) * queries.shape[1] < 2**52
    q, v = (x.astype(np.float64 if exact else object) for x in (queries, vectors))
    found = (q * v).sum(axis=1) if pairs else q @ v.T
    return (found if exact else np.clip(found, NONE + 1, MOST)).astype(np.int64)


class Block:
    """Vectors of similar length, longest first, with a list of rows by each coordinate's value."""

    def __init__(self, vectors: np.ndarray, lengths: np.ndarray):
        self.vectors, self.lengths = vectors, lengths
        self.unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order: dict[int, np.ndarray] = {}

    def range(self, coordinate: int, low: float, high: float) -> np.ndarray:
        """Rows whose unit vector has a coordinate from low to high."""
        if coordinate not in self.order:
            self.order[coordinate] = np.argsort(self.unit[:, coordinate], kind="stable")
        rows = self.order[coordinate]
        a, b = np.searchsorted(self.unit[rows, coordinate], (low, high))
        return rows[a:b]


def feasible(unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Between what each coordinate of a unit vector lies that has at least this cosine with another."""
    half = np.sqrt(np.maximum(0, (1 - unit**2) * (1 - cosine**2)))
    low = np.where(unit <= -cosine, -1.0, unit * cosine - half)
    high = np.where(unit >= cosine, 1.0, unit * cosine + half)
    return low - SLACK, high + SLACK


def lookups(query: np.ndarray, length: float, least: int, block: Block, within: int) -> np.ndarray | None:
    """Rows of the block that can reach a query's threshold by their coordinates, None if length tells more cheaply.

    `within` rows are long enough. The threshold as a cosine with the block's longest vector bounds
    each coordinate; the query's largest coordinates bound it best.
    """
    cosine = least / (length * block.lengths[0]) - SLACK
    if cosine <= 0:
        return None
    unit = query / length
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    low, high = feasible(unit[focus], min(1.0, cosine))
    rows = min((block.range(int(f), lo, hi) for f, lo, hi in zip(focus, low, high, strict=True)), key=len)
    if len(rows) * LOOKUP_COST >= within:
        return None
    rows = rows[rows < within]
    return rows[((block.unit[rows][:, focus] >= low) & (block.unit[rows][:, focus] <= high)).all(axis=1)]


def search(
    q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(query row, id, score) of the k best vectors for each query, itself left out, that reach its floor,
    and how many pairs were told by length alone, by coordinates or by their product.

    Vectors go in blocks of decreasing length. A query is done once the block's longest vector is too
    short for its threshold: the k-th best score so far. Otherwise its threshold is a cosine in this
    block, by which either coordinates or lengths choose the vectors whose products are computed.
    """
    length = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    lengths = length(vectors)
    order = np.lexsort((ids, -lengths))
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    blocks = [slice(a, a + BLOCK_ROWS) for a in range(0, len(ids), BLOCK_ROWS)]
    held = [Block(vectors[b], lengths[b]) for b in blocks]
    told = {"length": 0, "coordinate": 0, "product": 0}
    found = [(np.empty(0, np.int64),) * 3]
    for at in range(0, len(q_ids), QUERY_ROWS):
        mine, own_ids = queries[at : at + QUERY_ROWS], q_ids[at : at + QUERY_ROWS]
        size, least = length(mine), floors[at : at + QUERY_ROWS].copy()
        best = (np.empty(0, np.int64),) * 3
        for part, block in zip(blocks, held, strict=True):
            # a vector of at least this length can reach the threshold
            needed = np.where(least > 0, least / np.maximum(size, 1e-300), -np.inf) * (1 - SLACK)
            within = np.searchsorted(-block.lengths, -needed, side="right")
            told["length"] += int((len(block.lengths) - within).sum())
            # thresholds of 0 or less tell nothing by length, and a null query ties with all
            dense, rows, cols = [], [], []
            for q in np.nonzero(within)[0]:
                near = lookups(mine[q], size[q], int(least[q]), block, int(within[q])) if least[q] > 0 and size[q] > 0 else None
                if near is None:
                    dense.append(q)
                else:
                    told["coordinate"] += int(within[q]) - len(near)
                    rows.append(np.full(len(near), q)), cols.append(near)
            scored = []
            if rows:
                r, c = np.concatenate(rows), np.concatenate(cols)
                scored.append((r, c, products(mine[r], block.vectors[c], pairs=True)))
            if dense:
                dense = np.array(dense)
                n = int(within[dense].max())
                score = products(mine[dense], block.vectors[:n])
                score[own_ids[dense][:, None] == ids[part][:n]] = NONE
                enough = np.partition(score, n - k, axis=1)[:, n - k] if n >= k else np.full(len(dense), NONE)
                r, c = np.nonzero((score >= np.maximum(enough, least[dense])[:, None]) & (score > NONE))
                scored.append((dense[r], c, score[r, c]))
                told["product"] += score.size
            for r, c, score in scored:
                near = (score >= least[r]) & (own_ids[r] != ids[part][c])
                new = (r[near], ids[part][c[near]], score[near])
                best, least = _best(*(np.concatenate(x) for x in zip(best, new, strict=True)), k, least)
        found.append((best[0] + at, *best[1:]))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), told


def build_buckets(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, vector, dim, length, bucket): the integer vectors that take part, for a table that is stored.

    A bucket holds lengths that differ by at most a factor of RATIO; vectors of zeros have the lowest one.
    An id that is repeated has the smallest vector of it.
    """
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("vector"))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("length", F.sqrt(squares)).withColumn("dim", F.size("vector"))
    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / F.lit(-math.log(RATIO)))).otherwise(-1)
    return rows.withColumn("bucket", bucket.cast("int"))


def largest_products(
    queries: DataFrame, buckets: DataFrame, k: int = 10, part_rows: int = PART_ROWS, chunk_rows: int = CHUNK_ROWS,
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to the smaller id.

    Both tables come from build_buckets and are stored. A bucket is dealt over parts by the hash of
    the id and queries over chunks, all of bounded size, whatever lengths are common. The parts
    that hold the longest vectors are searched first; each query's k-th best score there is its
    threshold, and a chunk then goes to those other buckets only whose longest vector can reach one of its
    thresholds. Inside a part, blocks of vectors are pruned by length or by coordinates (`search`).
    Of equal vectors only the k + 1 smallest ids are searched, since ties go to the smaller id.
    """
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    held = written(buckets.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "buckets")
    # a row a bucket: as many as there are steps of RATIO between the shortest and the longest vector
    sizes = held.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    before = Window.partitionBy("dim").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = written(sizes.withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")), "bucket-sizes")
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    chunks = max(1, math.ceil(queries.count() / chunk_rows))
    asked = queries.select("vec_id", "vector", "dim", "length", deal(F.lit(chunks)).alias("chunk"))
    index = held.join(F.broadcast(sizes.select("dim", "bucket", "before", "parts")), ["dim", "bucket"])
    index = index.withColumn("part", deal(F.col("parts")))
    in_head = F.col("before") + F.col("part") * part_rows < head_rows
    cell = ["dim", "bucket", "part", "chunk"]

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows = q["queries"].iloc[0]
        dim = int(d["dim"].iloc[0])
        stacked = lambda vectors, n: np.array(list(vectors), dtype=np.int64).reshape(n, dim)
        q_ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        floors = np.array([r["floor"] for r in rows], dtype=np.int64)
        at, found, score, _ = search(
            q_ids, stacked((r["vector"] for r in rows), len(rows)), floors,
            d["vec_id"].to_numpy(), stacked(d["vector"], len(d)), k,
        )
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": found, "score": score})

    def searched(asked: DataFrame, index: DataFrame, places: DataFrame) -> DataFrame:
        """The hits of all chunks in the parts that `places` (dim, bucket, part, chunk) sends them to."""
        row = F.struct("vec_id", "vector", "floor")
        packed = asked.groupBy("dim", "chunk").agg(F.collect_list(row).alias("queries"))  # at most chunk_rows
        left = packed.join(places, ["dim", "chunk"])
        wanted = places.groupBy("dim", "bucket", "part").agg(F.collect_list("chunk").alias("chunks"))
        right = index.join(wanted, ["dim", "bucket", "part"]).select(
            "vec_id", "vector", "dim", "bucket", "part", F.explode("chunks").alias("chunk")
        )
        cells = left.groupBy(*cell).cogroup(right.groupBy(*cell))
        hits = cells.applyInPandas(run, "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    parts = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = asked.select("dim", "chunk").distinct()
    first = searched(
        asked.withColumn("floor", F.lit(NONE).cast("long")), index.where(in_head), parts.where(in_head).join(every, "dim").select(*cell)
    )
    first = written(first, "longest")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    asked = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE).cast("long")))
    asked = written(asked, "thresholds")
    # what a vector's length must be for one of the chunk's queries at least
    needed = F.when((F.col("floor") > 0) & (F.col("length") > 0), F.col("floor") / F.col("length")).otherwise(0.0)
    reach = asked.groupBy("dim", "chunk").agg(F.min(needed * (1 - SLACK)).alias("needed"))
    rest = parts.where(~in_head).join(reach, "dim").where(F.col("longest") >= F.col("needed")).select(*cell)
    both = first.unionByName(searched(asked, index.where(~in_head), rest)).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def products_of_every(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k largest integer inner products of each row whose id is divisible by `every` with the others.

    Null vectors, ones with a null, NaN or infinite component and rows without an id take no part;
    vectors of zeros do. Vectors are only compared with those of their own length; empty ones score
    0 with each other. Equal scores go to the smaller id. A repeated id counts once, with its smallest
    vector. Components and scores beyond a long are its ends. A row that is alone has no rows, and
    no rows give none. Only the two named columns are read, whatever else there is.
    """
    held = written(build_buckets(vectors, id_col, vector_col), "vectors")
    return largest_products(held.where(F.col("vec_id") % every == 0), held, k)
