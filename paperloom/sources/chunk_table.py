"""The chunk table on disk: versions of hash partitions, of which a change rewrites those it touches."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.sources.scratch import written
from paperloom.sources.versions import Versions


#: Files of a change whose hashes go to all tasks, 64 characters each.
FEW_FILES = 100_000


@dataclass(frozen=True)
class ChunkTable:
    """Chunks at a path, dealt over partitions by the first digits of their file's hash.

    A version names the folders of each partition. append adds a folder to those at hand; replace and
    delete write the partitions that they touch anew and leave the files of the others as they are.
    A version counts once its state is there, written last, so a write that failed at any step
    leaves the version before it, and may be repeated. Writers of the same moment don't overwrite each
    other: the later one gets a Conflict and can run again. Versions stay readable until `vacuum`.

    A chunk's key `pk` follows from its file's hash and its place. New columns widen the table; older
    rows have nulls there.
    """

    spark: SparkSession
    path: str
    prefix: int = 1

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, self.path)

    def _part(self) -> Column:
        return F.substring("file_hash", 1, self.prefix)

    def _rows(self, state: dict, parts: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        # of a partition only its own folders are listed and opened
        own = state["parts"] if parts is None else {p: state["parts"].get(p, ()) for p in parts}
        paths = [f"{self.path}/{folder}/hash_prefix={p}" for p, folders in own.items() for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The chunks of a version, the latest by default."""
        number, state = self.versions.state(version)
        if number < 0:
            raise ValueError(f"no chunk table at {self.path}")
        return self._rows(state)

    def _keyed(self, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("pk", F.xxhash64("file_hash", "chunk_index"))

    def _once(self, chunks: DataFrame) -> DataFrame:
        """Keyed chunks, once each, dealt by partition and key: one shuffle for both."""
        spread = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 16**self.prefix)
        rows = self._keyed(chunks).withColumns({"hash_prefix": self._part(), "cell": F.pmod("pk", F.lit(spread))})
        return rows.repartition("hash_prefix", "cell").dropDuplicates(["hash_prefix", "cell", "pk"]).drop("cell")

    def _write(self, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """(folder, rows of each partition) of newly written rows; large partitions become several files."""
        folder = self.versions.folder("data")
        # rows with their partition have been dealt
        dealt = rows if "hash_prefix" in rows.columns else rows.withColumn("hash_prefix", self._part()).hint("rebalance", "hash_prefix")
        dealt.write.partitionBy("hash_prefix").parquet(f"{self.path}/{folder}")
        kept = T.StructType([T.StructField("hash_prefix", T.StringType())])
        counts = self.spark.read.schema(kept).parquet(f"{self.path}/{folder}").groupBy("hash_prefix").count()
        return folder, {r["hash_prefix"]: r["count"] for r in counts.collect()}  # at most 16^prefix

    @staticmethod
    def _widened(state: dict, rows: DataFrame) -> str:
        held = T.StructType.fromJson(json.loads(state["schema"])) if state else T.StructType()
        return T.StructType([*held.fields, *(f for f in rows.schema.fields if f.name not in held.names)]).json()

    def _at_hand(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(self._part()).distinct().collect()]  # at most 16^prefix

    def append(self, chunks: DataFrame) -> int:
        """Adds the chunks whose key the table doesn't have, once each; how many.

        Of the table only the keys of the partitions at hand are read. If nothing is new, there is no
        new version.
        """
        number, state = self.versions.state()
        new = self._once(chunks)
        if state:
            new = written(new.drop("hash_prefix"), "chunks")
            held = self._rows(state, self._at_hand(new)).select("pk")
            new = new.join(held, "pk", "left_anti")
        folder, counts = self._write(new)
        if counts:
            parts = dict(state.get("parts", {}))
            for p in counts:
                parts[p] = [*parts.get(p, ()), folder]
            self.versions.commit(number, {"schema": self._widened(state, new.drop("hash_prefix")), "parts": parts})
        elif not state:
            self.versions.commit(number, {"schema": self._widened(state, new.drop("hash_prefix")), "parts": {}})
        return sum(counts.values())

    def replace(self, chunks: DataFrame) -> int:
        """The chunks in the place of all that the table has of their files; the version that has them.

        Where it has the same rows already there is no new version.
        """
        number, state = self.versions.state()
        new = written(self._once(chunks).drop("hash_prefix"), "chunks")
        files, touched = new.select("file_hash").distinct(), self._at_hand(new)
        if files.limit(FEW_FILES + 1).count() <= FEW_FILES:
            files = F.broadcast(files)  # else all that is held would be shuffled to meet them
        schema = self._widened(state, new)
        parts = dict(state.get("parts", {}))
        if state:
            held = self._rows({"schema": schema, "parts": parts}, touched)
            own = held.join(files, "file_hash", "left_semi")
            if self._same(own, new.select(*(c if c in new.columns else F.lit(None).alias(c) for c in own.columns))):
                return number
            new = held.join(files, "file_hash", "left_anti").unionByName(new, allowMissingColumns=True)
        folder, counts = self._write(new)
        parts |= {p: [folder] for p in counts}
        return self.versions.commit(number, {"schema": schema, "parts": parts})

    @staticmethod
    def _same(one: DataFrame, other: DataFrame) -> bool:
        """Whether both have the same rows by file: their number and the sum of their hashes."""

        def summed(rows: DataFrame, name: str) -> DataFrame:
            mark = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))
            return rows.groupBy("file_hash").agg(F.struct(F.count("*"), mark).alias(name))

        both = summed(one, "a").join(summed(other, "b"), "file_hash", "full")
        return both.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()

    def delete(self, filename: str) -> int:
        """Removes a file's chunks; how many. Only the partitions that have some are written anew."""
        number, state = self.versions.state()
        if not state:
            return 0
        own = F.col("filename").eqNullSafe(F.lit(filename))
        found = self._rows(state).where(own).groupBy(self._part().alias("p")).count().collect()  # at most 16^prefix
        if not found:
            return 0
        touched = [r["p"] for r in found]
        folder, counts = self._write(self._rows(state, touched).where(~own))
        parts = {p: f for p, f in state["parts"].items() if p not in touched} | {p: [folder] for p in counts}
        self.versions.commit(number, state | {"parts": parts})
        return sum(r["count"] for r in found)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the last versions has, and older states; how many folders.

        Not while others write: what they have not committed yet would go too.
        """
        last = self.versions.numbers()[-keep:]
        states = [self.versions.state(n)[1] for n in last]
        used = {folder for s in states for folders in s["parts"].values() for folder in folders}
        gone = self.versions.vacuum(["data"], used)
        self.versions.forget(min(last, default=0))
        return gone
