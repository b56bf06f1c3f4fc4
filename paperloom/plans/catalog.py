"""Queries of the catalog operators. A document is a chunk of the file that its source stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import catalog as C
from paperloom.plans.registry import query, table
from paperloom.sources.chunk_table import ChunkTable
from paperloom.sources.scratch import scratch_path


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("pk"), "text", F.col("source").alias("filename"), (
            F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
        ).cast("long").alias("chunk_index"),
        (F.col("doc_id") % 97 + 1_700_000_000).alias("upload_time"), F.sha2(
            F.concat("source", F.lit("/"), "lang"), 256
        ).alias("file_hash"), F.concat("source", F.lit("-"), "lang").alias("parent_id"),
        F.col("doc_id").alias("child_index"), F.col("text").alias("raw_text"), F.lit(None).cast("long").alias("page_start"), F.lit(None).cast("long").alias("page_end"), "lang",
    )


CHUNKS_SQL = """chunks AS (
  SELECT doc_id AS pk, text, source AS filename, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, doc_id % 97 + 1700000000 AS upload_time,
    sha256(source || '/' || lang) AS file_hash, source || '-' || lang AS parent_id, doc_id AS child_index, lang FROM documents
)"""


@query("""WITH marked AS (
  SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS first, sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'es' AND n_chars < 1000) AS known FROM documents
) SELECT doc_id, CASE WHEN first AND NOT known THEN 'stored' ELSE 'failed: duplicate' END AS status FROM marked""")
def dedupe_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    stored = d.where("lang = 'es' AND n_chars < 1000").select(F.sha2("text", 256).alias("file_hash"))
    return C.dedupe_ingest(
        d.select("doc_id", F.col("doc_id").alias("arrival"), F.sha2("text", 256).alias("file_hash")), stored
    ).select("doc_id", "status")


@query(f"""WITH {CHUNKS_SQL}
SELECT file_hash, max(upload_time) AS upload_time, count(*) AS n FROM chunks WHERE lang <> 'fr' GROUP BY file_hash
UNION ALL SELECT file_hash, 1800000000, count(*) FROM chunks WHERE lang = 'fr' GROUP BY file_hash""")
def replace_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table whose French chunks are replaced by ones that were uploaded later."""
    stored = ChunkTable(spark, scratch_path(spark, "chunks"))
    stored.append(chunks(spark, sf_dir))
    # taken from the table, as numbering the chunks shuffles all of them
    stored.replace(stored.read().where("lang = 'fr'").withColumn("upload_time", F.lit(1_800_000_000).cast("long")))
    return stored.read().groupBy("file_hash").agg(F.max("upload_time").alias("upload_time"), F.count("*").alias("n"))


@query("SELECT count(*) FILTER (source = 'src7') AS deleted, count(*) FILTER (source <> 'src7') AS kept FROM documents")
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table that a file's chunks are deleted from."""
    stored = ChunkTable(spark, scratch_path(spark, "chunks"))
    stored.append(chunks(spark, sf_dir))
    deleted = stored.delete("src7")
    return stored.read().agg(F.lit(deleted).cast("long").alias("deleted"), F.count("*").alias("kept"))


@query(f"""WITH {CHUNKS_SQL}
SELECT filename, count(*) AS chunk_count, arg_min(upload_time, pk) AS upload_time, arg_min(file_hash, pk) AS file_hash FROM chunks GROUP BY filename""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_documents(chunks(spark, sf_dir))


@query(
    f"WITH {CHUNKS_SQL} SELECT filename, file_hash, count(*) AS chunks, max(upload_time) AS upload_time FROM chunks GROUP BY filename, file_hash"
)
def legacy_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.legacy_inventory(chunks(spark, sf_dir))


@query(
    f"WITH {CHUNKS_SQL} SELECT pk, chunk_index + 1 AS position, substr(text, 1, 200) AS preview FROM chunks WHERE chunk_index + 1 IN (1, 2, 5, 8) AND contains(filename, 'src1') AND contains(text, 'e')"
)
def inspect_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.inspect_chunks(chunks(spark, sf_dir), [1, 2, 5, 8], "src1", "e")
    return found.select("pk", F.col("position").cast("long").alias("position"), "preview")


@query(
    "SELECT vec_id AS pk, label AS upload_time, '' AS section, NULL::BIGINT AS page, len(embedding) AS dim FROM embeddings"
)
def schema_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pk"), F.col("label").alias("upload_time"), F.col("embedding").alias("vector")
    )
    newer = T.StructType.fromDDL("pk long, upload_time int, vector array<float>, section string, page long")
    return C.schema_upgrade(old, newer).select(
        "pk", "upload_time", "section", "page", F.size("vector").cast("long").alias("dim")
    )


@query("""WITH found AS (
  SELECT 'text longer than 5000' AS rule, count(*) FILTER (length(text) > 5000) AS rows FROM documents
  UNION ALL SELECT 'lang longer than 1', count(*) FILTER (length(lang) > 1) FROM documents
  UNION ALL SELECT 'label is null', count(*) FILTER (l.doc_id IS NULL) FROM documents LEFT JOIN labels l USING (doc_id)
) SELECT * FROM found WHERE rows > 0""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    return C.schema_violations(d, limits={"text": 5000, "lang": 1})


@query(f"""WITH {CHUNKS_SQL}
SELECT parent_id, count(*)::INTEGER AS n, md5(string_agg(pk::VARCHAR, ',' ORDER BY child_index)) AS children_md5 FROM chunks
WHERE filename IN (SELECT source FROM documents WHERE n_chars > 20000) GROUP BY parent_id""")
def siblings_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir)
    hit = table(spark, sf_dir, "documents").where("n_chars > 20000").select(F.col("source").alias("filename")).distinct()
    wanted = own.join(hit, "filename", "left_semi").select("parent_id").unionByName(
        own.select(F.lit(" ").alias("parent_id"))
    )
    found = C.siblings_by_parent(own, wanted)
    return found.select(
        "parent_id",
        F.size("children").alias("n"),
        F.md5(F.array_join(F.transform("children", lambda c: c["child_index"].cast("string")), ",")).alias("children_md5"),
    )
