"""Which hashes a stream has stored, told from sketches of fixed size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashes that a cell's sketch is meant for, bits for each of them, and bits that one sets.
CELL = 1 << 16
BITS = 10
PROBES = 7
MARKS = "cell int, file_hash string, maybe boolean, bits binary"


def sketched(held: bytes | None, one: np.ndarray, other: np.ndarray, size: int) -> tuple[np.ndarray, bytes]:
    """(whether each value may be in a Bloom filter of `size` bits, the filter with all of them)."""
    bits = np.zeros(size // 8, dtype=np.uint8) if held is None else np.frombuffer(held, dtype=np.uint8).copy()
    step = other.view(np.uint64) | np.uint64(1)
    at = (one.view(np.uint64)[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)
    byte, bit = (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8)
    maybe = (bits[byte] & bit > 0).all(axis=1)
    np.bitwise_or.at(bits, byte.ravel(), bit.ravel())
    return maybe, bits.tobytes()


@dataclass(frozen=True)
class HashStore:
    """A table of rows by `file_hash`, each once, that batches are added to.

    Rows lie in `parts` folders by their hash. Beside them are Bloom filters over all hashes, dealt over cells
    of 65,536 of the hashes that are `expected`; a batch takes the filters of the batch before, judges its hashes and
    writes them anew, ten bits for each expected hash. Only hashes that a filter may have are looked up,
    and only in their parts, so what a batch reads follows from `expected` and its repeats, not from what is stored.
    With more hashes than expected more are looked up; the rows are right all the same.

    A batch writes folders of its own, and filters beside those it read, so one that is run again gives the same.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    parts: int = 64
    expected: int = 1 << 20

    def read(self) -> DataFrame:
        """All rows."""
        return self._rows(f"{self.path}/rows").select(self.schema.names)

    def _rows(self, *paths: str) -> DataFrame:
        own = T.StructType([*self.schema, T.StructField("part", T.IntegerType()), T.StructField("batch", T.IntegerType())])
        return self.spark.read.schema(own).option("basePath", f"{self.path}/rows").parquet(*paths)

    def _sketches(self, number: int) -> str:
        return f"{self.path}/sketches/{number % 2}"

    def _judge(self, new: DataFrame, number: int) -> DataFrame:
        """The stored marks of a batch: (cell, file_hash, maybe) for its hashes, (cell, bits) for the filters."""
        cells, size = max(1, -(-self.expected // CELL)), CELL * BITS
        sides = F.xxhash64("file_hash", F.lit(1)), F.xxhash64("file_hash", F.lit(2))
        hashes = new.select(F.pmod(F.xxhash64("file_hash"), F.lit(cells)).cast("int").alias("cell"), "file_hash", *(s.alias(n) for s, n in zip(sides, ("one", "other"), strict=True)))

        def run(key: tuple, own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            before = held["bits"].iloc[0] if len(held) else None
            maybe, bits = sketched(before, own["one"].to_numpy(np.int64), own["other"].to_numpy(np.int64), size)
            marks = pd.DataFrame({"cell": key[0], "file_hash": own["file_hash"].to_numpy(), "maybe": maybe, "bits": None})
            kept = pd.DataFrame({"cell": [key[0]], "file_hash": [None], "maybe": [None], "bits": [bits]})
            return pd.concat([marks.astype(object), kept.astype(object)])

        if number:
            held = self.spark.read.schema(MARKS).parquet(self._sketches(number - 1)).where("bits IS NOT NULL").select("cell", "bits")
        else:
            held = self.spark.createDataFrame([], "cell int, bits binary")
        marks = hashes.groupBy("cell").cogroup(held.groupBy("cell")).applyInPandas(run, MARKS)
        marks.write.mode("overwrite").parquet(self._sketches(number))
        return self.spark.read.schema(MARKS).parquet(self._sketches(number)).where("bits IS NULL")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("file_hash", F.lit(3)), F.lit(self.parts)).cast("int")

    def stored(self, parts: list[int], before: int) -> DataFrame:
        """The hashes of earlier batches in some parts; no other part is opened."""
        return self._rows(*(f"{self.path}/rows/part={p}" for p in parts)).where(F.col("batch") < before).select("file_hash")

    def add(self, batch: DataFrame, number: int) -> None:
        """Stores the rows of a batch whose hashes no earlier batch has stored. Of rows with one hash the
        smallest is taken; rows without a hash are left out."""
        rest = [c for c in self.schema.names if c != "file_hash"]
        row = F.min(F.struct(*rest)).alias("r") if rest else F.lit(None).cast("struct<r:int>").alias("r")
        new = batch.where("file_hash IS NOT NULL").groupBy("file_hash").agg(row).persist()
        try:
            known = self._judge(new, number).where("maybe").select("file_hash")
            parts = [r.part for r in known.select(self._part().alias("part")).distinct().collect()]  # at most `parts`
            if number and parts:
                held = self._present(parts)
                if held:
                    known = known.join(self.stored(held, number), "file_hash", "left_semi")
                    new = new.join(known, "file_hash", "left_anti")
            out = new.select("file_hash", "r.*") if rest else new.select("file_hash")
            out = out.select(*self.schema.names, self._part().alias("part"), F.lit(number).alias("batch"))
            out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "part", "batch"
            ).parquet(f"{self.path}/rows")
        finally:
            new.unpersist()

    def _present(self, parts: list[int]) -> list[int]:
        """Those of some parts that have rows."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [p for p in parts if fs.exists(path(f"{self.path}/rows/part={p}"))]
