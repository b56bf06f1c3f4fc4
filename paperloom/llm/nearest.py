"""Nearest neighbours by cosine from randomly rotated one-bit codes, reranked within error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.storage import written

#: Rows of a slab of the index and queries of a chunk: one task searches one chunk in one slab.
SLAB_ROWS, CHUNK_ROWS = 65_536, 4_096
#: Half-width of an estimate's interval, in standard deviations of the rotation's error.
ERROR_WIDTH = 2.5
#: Bits that a query's components are rounded to, and best estimates that are reranked first, in k.
PLANES, FIRST = 4, 4
#: Queries and codes that are compared at once.
BLOCK = 128, 8192


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    whole = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), dtype=np.uint8)
    whole[:, : -(-bits.shape[1] // 8)] = np.packbits(bits, axis=1)
    return whole.view(np.uint64)


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, factor) of unit vectors after the rotation.

    The code stands for the corner of the cube nearest to the rotated vector; the factor is their
    inner product, by which an inner product with the corner is divided to estimate the vector's.
    """
    turned = unit @ rotation(unit.shape[1], seed)
    return _packed(turned > 0), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


@dataclass(frozen=True)
class Codes:
    """Codes of vectors of one length: words of packed bits, how many are set, and factors."""

    words: np.ndarray
    factors: np.ndarray
    dim: int

    def error(self) -> np.ndarray:
        """Standard deviation of what the corner leaves open of an inner product."""
        return np.sqrt(np.maximum(0, 1 - self.factors**2) / max(1, self.dim - 1)) / self.factors


class Queries:
    """Unit query vectors, rotated, with components rounded to PLANES bits that are packed by plane."""

    def __init__(self, unit: np.ndarray, seed: int):
        turned = unit @ rotation(unit.shape[1], seed)
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-12) / (2**PLANES - 1)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        rounded = self.low[:, None] + level * self.step[:, None]
        self.total = rounded.sum(axis=1)
        self.rest = np.sqrt(((turned - rounded) ** 2).sum(axis=1) / unit.shape[1])
        self.planes = [_packed(level >> p & 1) for p in range(PLANES)]

    def estimates(self, mine: slice, codes: Codes, part: slice) -> np.ndarray:
        """Estimated inner products of some queries with some codes, from counts of common bits."""
        words = codes.words[part]
        common = np.zeros((len(self.low[mine]), len(words)), dtype=np.uint32)
        for p, plane in enumerate(self.planes):
            for w in range(words.shape[1]):
                common += np.bitwise_count(plane[mine, w, None] & words[None, :, w]).astype(np.uint32) << p
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        corner = 2 * (self.low[mine, None] * ones + self.step[mine, None] * common) - self.total[mine, None]
        return corner / (math.sqrt(codes.dim) * codes.factors[part])


def search(
    q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: Codes, k: int, seed: int,
    width: float = ERROR_WIDTH,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, cosine): the k best of the given vectors for each query, itself left out.

    Block by block, inner products are estimated from the bits. Of the first block the best
    estimates are scored exactly; from then on a vector is, if its estimate's upper bound reaches
    the k-th best score found so far.
    """
    q_norm, norm = np.sqrt((queries**2).sum(axis=1)), np.sqrt((vectors**2).sum(axis=1))
    asked, error = Queries(queries / q_norm[:, None], seed), codes.error()
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for q0 in range(0, len(q_ids), BLOCK[0]):
        mine = slice(q0, q0 + BLOCK[0])
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        least = np.full(len(q_ids[mine]), -np.inf)
        for d0 in range(0, len(ids), BLOCK[1]):
            part = slice(d0, d0 + BLOCK[1])
            guess = asked.estimates(mine, codes, part)
            guess[q_ids[mine][:, None] == ids[part][None, :]] = -np.inf
            reach = width * (error[part] + asked.rest[mine, None] / codes.factors[part])
            n = guess.shape[1]
            for first in (True, False) if d0 == 0 and n > FIRST * k else (False,):
                near = guess >= np.partition(guess, n - FIRST * k, axis=1)[:, n - FIRST * k, None] if first else guess + reach >= least[:, None]
                row, col = np.nonzero(near & (guess > -np.inf))
                exact = np.empty(len(row))
                for c in range(0, len(row), 65_536):
                    r, v = row[c : c + 65_536] + q0, col[c : c + 65_536] + d0
                    exact[c : c + 65_536] = (queries[r] * vectors[v]).sum(axis=1) / (q_norm[r] * norm[v])
                guess[row, col] = -np.inf  # scored
                both = (np.concatenate(x) for x in zip(best, (row, ids[part][col], exact), strict=True))
                best, least = _best(*both, k, least)
        found.append((best[0] + q0, *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, least: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The k best of each row, ties to the smaller id, and the rows' k-th best scores."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    least[row[nth == k - 1]] = score[nth == k - 1]
    return tuple(x[nth < k] for x in (row, ids, score)), least


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """(vec_id, vector, dim, code, factor): a row for every id that takes part; it can be stored as a table.

    An id that is repeated has the smallest vector of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, own in b.groupby("dim"):
                v = np.stack(own["vector"].to_numpy()).astype(np.float64)
                codes, factors = encode(v / np.sqrt((v**2).sum(axis=1, keepdims=True)), seed)
                yield own.assign(code=[c.tobytes() for c in codes], factor=factors)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(
        F.col("vec_id").isNotNull() & usable(F.col("vector"))
    ).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    kind = rows.schema["vector"].dataType.simpleString()
    rows = rows.withColumn("dim", F.size("vector"))
    return rows.mapInPandas(run, f"vec_id long, vector {kind}, dim int, code binary, factor double")


def nearest_neighbours(
    queries: DataFrame, index: DataFrame, k: int = 5, seed: int = 42, slab_rows: int = SLAB_ROWS, chunk_rows: int = CHUNK_ROWS,
    width: float = ERROR_WIDTH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best in the index by cosine, nearest first.

    Both tables come from build_index and are stored. Queries are dealt over chunks and the index
    over slabs, each of bounded size by the hash of the id, and a task searches one chunk in one
    slab. Vectors go with their codes, so that those within the bounds are scored where they are and
    only k rows a query leave a task. Of equal vectors only the k + 1 smallest ids are searched,
    since ties go to the smaller id.
    """
    nth = F.row_number().over(Window.partitionBy(F.xxhash64("vector")).orderBy("vec_id"))
    held = written(index.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "codes")
    n, m = held.count(), queries.count()
    spread = 2 * index.sparkSession.sparkContext.defaultParallelism
    slabs = max(1, math.ceil(n / slab_rows), min(spread, n // 1024))
    chunks = max(1, math.ceil(m / chunk_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["dim", "chunk", "slab"]
    left = queries.select("vec_id", "vector", "dim", deal(chunks).alias("chunk"), every(slabs).alias("slab"))
    right = held.select("*", deal(slabs).alias("slab"), every(chunks).alias("chunk"))

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        qv, dv = (np.stack(x["vector"].to_numpy()).astype(np.float64) for x in (q, d))
        words = np.frombuffer(b"".join(d["code"]), np.uint64).reshape(len(d), -1)
        codes = Codes(words, d["factor"].to_numpy(), dv.shape[1])
        q_ids = q["vec_id"].to_numpy()
        at, found, score = search(q_ids, qv, d["vec_id"].to_numpy(), dv, codes, k, seed, width)
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": found, "score": score})

    cells = left.groupBy(*cell).cogroup(right.groupBy(*cell))
    found = cells.applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_every(
    vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k nearest others of each row whose id is divisible by `every`.

    Null vectors, zero ones, ones with a null, NaN or infinite component and rows without an id
    take no part. Vectors are only compared with those of their own length. Equal vectors tie,
    and the smaller ids go first. A repeated id counts once, with its smallest vector. No rows give
    no rows. Only the two named columns are read.
    """
    index = written(build_index(vectors, id_col, vector_col), "index")
    return nearest_neighbours(index.where(F.col("vec_id") % every == 0), index, k)
