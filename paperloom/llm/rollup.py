"""Token totals kept up by signed changes, in batches that may be sent again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.packing import FULL, RANKS, encoder
from paperloom.llm.storage import written

KEYS = ("source", "lang", "version")
LEDGER = "batch_id long, doc_id long, version string, source string, lang string, tokens long, live boolean"
DELTAS = "source string, lang string, version string, docs long, tokens long"
MANIFEST = "kind string, number long, ledger string, deltas string"


@dataclass(frozen=True)
class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version, in a folder.

    A batch of changes has doc_id, version, op (insert, revise or delete), source, lang and tokens,
    and may have seq, of which the largest counts where a batch changes a count twice. What it
    does to the totals, it does by signed differences from the counts that earlier batches left:
    an insert or a revision takes back the old count, if there is one, and adds the new; a delete
    takes it back, whatever source or count it names, and does nothing to a count that isn't there.

    Each batch has a number and writes two tables into folders of their own: the counts it sets
    (ledger) and the differences (deltas). It counts from the moment that its row in the manifest
    is there, which is one small file and written last. So a batch that fails half-way leaves
    nothing, and one that comes again does nothing. New ones come in the order of their numbers:
    one that comes late, behind a larger number, is an error and not passed over.

    Ledgers are dealt over partitions by the hash of the document, and a batch reads those
    partitions alone that its own keys are in. After every `compact_every` batches a snapshot of all counts
    and totals takes their place. The manifest has a row a batch and is read whole.
    """

    spark: SparkSession
    path: str
    compact_every: int = 16
    parts: int = 16

    def _entries(self) -> list[tuple[str, int, str, str]]:
        """All rows of the manifest."""
        try:
            return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()]
        except AnalysisException:
            return []

    def _manifest(self) -> list[tuple[str, int, str, str]]:
        """The rows of the manifest that count: the last snapshot and the batches after it, or all batches."""
        found = self._entries()
        last = max((number for kind, number, _, _ in found if kind == "snapshot"), default=-1)
        return [r for r in found if r[1] > last or (r[1] == last and r[0] == "snapshot")]

    def _read(self, table: str, schema: str, rows: list[tuple[str, int, str, str]]) -> DataFrame:
        paths = [f"{self.path}/{r[2 if table == 'ledger' else 3]}" for r in rows]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # the base path makes the partitions of all folders one column
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _enter(self, kind: str, number: int, ledger: DataFrame, deltas: DataFrame) -> None:
        """Writes both tables into new folders, then the row that makes them count."""
        name = f"entry={kind}-{number}-{uuid.uuid4().hex}"
        dealt = ledger.withColumn("part", self._part()).repartition("part")
        dealt.write.partitionBy("part").parquet(f"{self.path}/ledger/{name}")
        deltas.write.parquet(f"{self.path}/deltas/{name}")
        row = self.spark.createDataFrame([(kind, number, f"ledger/{name}", f"deltas/{name}")], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        """The counts that the batches left, one row a document and version; of some keys only, if given."""
        held = self._read("ledger", f"{LEDGER}, part int", self._manifest())
        if keys is not None:
            parts = [r[0] for r in keys.select(self._part()).distinct().collect()]  # at most self.parts
            held = held.where(F.col("part").isin(parts)).join(keys.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        last = F.max_by(F.struct("source", "lang", "tokens", "live"), "batch_id").alias("last")
        rows = held.groupBy("doc_id", "version").agg(last, F.max("batch_id").alias("batch_id")).where("last.live")
        return rows.select("batch_id", "doc_id", "version", "last.source", "last.lang", "last.tokens", "last.live")

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Applies a batch and tells so; a batch that was applied before changes nothing.

        Rows without a document id, version or known op are left out; null tokens count as 0.
        """
        rows = self._manifest()
        applied = {number for kind, number, _, _ in self._entries() if kind == "batch"}
        if batch_id < 0:
            raise ValueError("batches are numbered from 0")
        if batch_id in applied:
            return False
        if batch_id < max(applied, default=-1):
            raise ValueError(f"batch {batch_id} comes after batch {max(applied)}")
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        known = changes.where(
            F.col("doc_id").isNotNull() & F.col("version").isNotNull() & F.col("op").isin("insert", "revise", "delete")
        )
        row = F.struct(
            seq.alias("seq"), (F.col("op") != "delete").alias("live"), F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"),
        )
        new = known.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(F.max(row).alias("new"))
        new = written(new, "changes")
        old = self.counts(new).select("doc_id", "version", F.struct("source", "lang", "tokens").alias("old"))
        both = new.join(old, ["doc_id", "version"], "left")
        ledger = new.select(
            F.lit(batch_id).cast("long").alias("batch_id"), "doc_id", "version", "new.source", "new.lang", "new.tokens", "new.live"
        )

        def signed(side: str, sign: int, given) -> Column:
            group = (F.col(f"{side}.{k}").alias(k) for k in ("source", "lang"))
            change = F.struct(*group, F.lit(sign).alias("docs"), (sign * F.col(f"{side}.tokens")).alias("tokens"))
            return F.filter(F.array(F.when(given, change)), lambda x: x.isNotNull())

        changed = F.concat(signed("new", 1, F.col("new.live")), signed("old", -1, F.col("old").isNotNull()))
        deltas = both.select("version", F.explode(changed).alias("d")).groupBy("d.source", "d.lang", "version")
        deltas = deltas.agg(F.sum("d.docs").cast("long").alias("docs"), F.sum("d.tokens").cast("long").alias("tokens"))
        self._enter("batch", batch_id, ledger, deltas)
        if sum(kind == "batch" for kind, _, _, _ in rows) + 1 >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """A snapshot of all counts and totals, in the place of the batches so far."""
        rows = self._manifest()
        if any(kind == "batch" for kind, _, _, _ in rows):
            self._enter("snapshot", max(r[1] for r in rows), self.counts(), self.totals())

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens): the sum of all differences, without empty rows."""
        sums = self._read("deltas", DELTAS, self._manifest()).groupBy(*KEYS)
        return sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")


#: What the registered query counts: tokens of a public vocabulary, and words.
BPE, WORDS_VERSION = "byte_bpe_50k/1", "words/1"
WORDS = r"[^\x20\x09-\x0D]+"
#: Words where the symbols of damaged texts part words like white space.
WORDS_WITHOUT_SYMBOLS = r"[^\x20\x09-\x0D#*$%&|<>]+"


def token_count(text: Column, ranks: str = RANKS, full: str = FULL) -> Column:
    """How many tokens a text has in a vocabulary, as operator 3 encodes it; a null text has none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(ranks, full)
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(text.cast("string"))


def corpus_changes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three batches of changes: all counts, the removal of exact copies, and revised word counts.

    Copies are the documents whose text a smaller doc_id has too. A null text has no tokens, like an
    empty one, and equals other null ones as a text. Rows without an id are left out; of rows that
    repeat one, the largest count of a version stands. Very long texts are counted whole. Only the
    columns doc_id, text, source and lang are read. The counts are passed on without the texts.
    """
    count = lambda pattern: F.coalesce(F.regexp_count(F.col("text"), F.lit(pattern)), F.lit(0)).cast("long")
    d = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.sha2(F.col("text"), 256), F.lit("")).alias("mark"), count(WORDS).alias("words"),
        token_count(F.col("text")).alias("tokens"), count(WORDS_WITHOUT_SYMBOLS).alias("revised"),
    )
    d = written(d, "counts")
    version = lambda name, tokens: F.struct(F.lit(name).alias("version"), F.col(tokens).alias("tokens"))
    versions = F.explode(F.array(version(WORDS_VERSION, "words"), version(BPE, "tokens"))).alias("v")
    inserts = d.select("doc_id", "source", "lang", versions)
    inserts = inserts.select("doc_id", "v.version", F.lit("insert").alias("op"), "source", "lang", "v.tokens")
    # one row a text that has copies, summed up before it is shuffled; the join deals the copies
    firsts = d.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    marked = d.join(written(firsts.select("mark", "first"), "firsts"), "mark", "left")
    marked = written(marked.withColumn("copy", F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False))), "marked")
    deletes = marked.where("copy").select("doc_id", versions, "source", "lang")
    deletes = deletes.select("doc_id", "v.version", F.lit("delete").alias("op"), "source", "lang", "v.tokens")
    revised = marked.where("revised <> words AND NOT copy")
    revisions = revised.select(
        "doc_id", F.lit(WORDS_VERSION).alias("version"), F.lit("revise").alias("op"), "source", "lang", F.col("revised").alias("tokens")
    )
    return inserts, deletes, revisions


def corpus_totals(docs: DataFrame, path: str) -> DataFrame:
    """(source, lang, version, docs, tokens) after the three batches of corpus_changes, two of which
    come a second time, with a snapshot after the second. No rows give no rows."""
    rollup = TokenRollup(docs.sparkSession, path, compact_every=2)
    batches = corpus_changes(docs)
    for number, batch in enumerate(batches):
        rollup.commit(number, batch)
    for number in (1, 0):  # a sender that didn't hear of its commits
        rollup.commit(number, batches[number])
    return rollup.totals()
