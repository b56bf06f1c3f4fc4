"""The chunk catalog: what is stored, replaced, removed and listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.schemas import MAX_LENGTHS, NULLABLE


def dedupe_ingest(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """The files (file_hash, arrival, ...) with `status`: stored, or failed as a copy.

    A file fails if the catalog has its hash, or if an earlier one of the batch has it; arrivals differ.
    Each hash's first arrival is found before anything is shuffled, so files that come often
    meet in no one place.
    """
    stored = catalog.select("file_hash").distinct()
    first = incoming.groupBy("file_hash").agg(F.min("arrival").alias("arrival")).join(stored, "file_hash", "left_anti")
    first = first.select(F.col("file_hash").alias("own_hash"), F.col("arrival").alias("own_arrival"), F.lit(True).alias("first"))
    same = F.col("file_hash").eqNullSafe(F.col("own_hash")) & F.col("arrival").eqNullSafe(F.col("own_arrival"))
    marked = incoming.join(first, same, "left").select(*incoming.columns, "first")
    return marked.withColumn("status", F.when(F.col("first"), "stored").otherwise("failed: duplicate")).drop("first")


def replace_ingest(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The catalog where the new rows stand for all old ones of their file hashes."""
    return catalog.join(
        new.select("file_hash").distinct(), "file_hash", "left_anti"
    ).unionByName(new, allowMissingColumns=True)


def delete_document(catalog: DataFrame, filename: str) -> tuple[DataFrame, DataFrame]:
    """(the catalog without the file, one row with `deleted`, the number of its chunks)."""
    own = F.col("filename").eqNullSafe(F.lit(filename))
    return catalog.where(~own), catalog.agg(F.count_if(own).alias("deleted"))


def list_documents(catalog: DataFrame) -> DataFrame:
    """One row per filename: chunk_count, and upload_time and file_hash of its first row; newest first."""
    first = F.min(F.struct("pk", "upload_time", "file_hash")).alias("first")
    files = catalog.groupBy("filename").agg(F.count("*").alias("chunk_count"), first)
    return files.select(
        "filename", "chunk_count", F.coalesce("first.upload_time", F.lit(0)).alias("upload_time"), "first.file_hash"
    ).orderBy(F.desc("upload_time"), "filename")


def legacy_inventory(catalog: DataFrame) -> DataFrame:
    """Chunks and latest upload of each (filename, file_hash), sorted."""
    return catalog.groupBy("filename", "file_hash").agg(
        F.count("*").alias("chunks"), F.max("upload_time").alias("upload_time")
    ).orderBy("filename", "file_hash")


def inspect_chunks(
    catalog: DataFrame,
    positions: list[int] | None = None,
    filename: str | None = None,
    content: str | None = None,
    limit: int = 0,
    preview: int = 200,
) -> DataFrame:
    """Chunks at 1-based places in their file, of some file name and content, with a preview."""
    found = catalog.withColumn("position", F.row_number().over(Window.partitionBy("filename").orderBy("chunk_index")))
    if positions:
        found = found.where(F.col("position").isin(positions))
    if filename:
        found = found.where(F.contains("filename", F.lit(filename)))
    if content:
        found = found.where(F.contains("text", F.lit(content)))
    found = found.withColumn("preview", F.substring("text", 1, preview))
    return found.orderBy("filename", "position").limit(limit) if limit else found


def schema_upgrade(old: DataFrame, schema: T.StructType) -> DataFrame:
    """Old rows in a newer schema: missing text columns are empty, other missing ones null; the same
    rows if they have all columns already."""
    if all(f.name in old.columns for f in schema):
        return old
    missing = lambda f: F.lit(
        "" if isinstance(f.dataType, T.StringType) else None
    ).cast(f.dataType).alias(f.name)
    return old.select(*(F.col(f.name).cast(f.dataType) if f.name in old.columns else missing(f) for f in schema))


def schema_violations(
    chunks: DataFrame, dim: int | None = None, limits: dict[str, int] | None = None, nullable: tuple[str, ...] = NULLABLE
) -> DataFrame:
    """(rule, rows): how many rows break each declared limit; rules that none breaks are left out."""
    limits = MAX_LENGTHS if limits is None else limits
    rules = {f"{c} longer than {n}": F.length(c) > n for c, n in limits.items() if c in chunks.columns}
    rules |= {f"{c} is null": F.col(c).isNull() for c in chunks.columns if c not in nullable}
    if dim is not None:
        rules[f"vector size is not {dim}"] = F.size("vector") != dim
    counts = chunks.agg(*(F.count_if(test).alias(str(i)) for i, test in enumerate(rules.values())))
    pairs = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(str(i)).alias("rows")) for i, rule in enumerate(rules)))
    return counts.select(F.inline(pairs)).where("rows > 0")


def siblings_by_parent(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(parent_id, children): the chunks of each wanted parent in order; repeats and blanks are left out."""
    ids = wanted.where("trim(parent_id) <> ''").select("parent_id").distinct()
    child = F.struct("child_index", "chunk_index", "raw_text", "page_start", "page_end")
    return chunks.join(ids, "parent_id", "left_semi").groupBy("parent_id").agg(
        F.array_sort(F.collect_list(child)).alias("children")
    )
