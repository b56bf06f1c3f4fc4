"""Queries of the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.plans.registry import query, table
from paperloom.sources import files as S
from paperloom.sources.chunk_table import ChunkTable
from paperloom.sources.scratch import scratch_path


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: names by source and language, sizes of a thousand bytes a character."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", ".TXT").when(F.col("lang") == "fr", ".md").when(
        F.col("lang") == "de", ".exe"
    ).otherwise("")
    mode = F.when(F.col("source") == "src1", "auto").when(
        F.col("source") == "src2", "sentences"
    ).when(F.col("source") == "src3", "fixed")
    return d.select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("filename"),
        (F.col("n_chars") * 1000).alias("size_bytes"),
        mode.alias("split_mode"),
        "text",
    )


FILES_SQL = """
files AS (
  SELECT doc_id, source || '/' || doc_id::VARCHAR || CASE lang WHEN 'en' THEN '.TXT' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.exe' ELSE '' END AS filename,
    CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.exe' ELSE '' END AS ext,
    n_chars * 1000 AS size_bytes, CASE source WHEN 'src1' THEN 'auto' WHEN 'src2' THEN 'sentences' WHEN 'src3' THEN 'fixed' END AS split_mode, text
  FROM documents
)"""


@query(f"""WITH {FILES_SQL}, judged AS (
  SELECT doc_id, CASE WHEN ext NOT IN ('.txt', '.md') THEN 'extension' WHEN split_mode = 'sentences' THEN 'split_mode' WHEN size_bytes > 20971520 THEN 'size' END AS reason FROM files
) SELECT doc_id, reason, reason IS NULL AS accepted FROM judged""")
def upload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.upload_validate(stored_files(spark, sf_dir)).select("doc_id", "reason", "accepted")


@query(f"""WITH {FILES_SQL}, named AS (
  SELECT sha256(text) AS file_hash, sha256(text) || CASE ext WHEN '' THEN '.bin' ELSE ext END AS stored_name FROM files
) SELECT file_hash, stored_name, count(*) AS uploads FROM named GROUP BY file_hash, stored_name""")
def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = S.file_fingerprint(stored_files(spark, sf_dir), "text")
    return named.groupBy("file_hash", "stored_name").agg(F.count("*").alias("uploads"))


#: Folders that written text files are dealt over.
TEXT_FOLDERS = 128


@query(
    f"WITH {FILES_SQL} SELECT sha256(text || chr(10)) AS file_hash, filename, 0::BIGINT AS unit_no, length(text)::BIGINT + 1 AS chars FROM files"
)
def read_text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, each with a line end after its text, and read as units."""
    path = scratch_path(spark, "texts")
    S.write_text_files(stored_files(spark, sf_dir), path, TEXT_FOLDERS)
    units = S.read_text_units(spark, path, "*.txt", S.written_name())
    return units.select("file_hash", "filename", "unit_no", F.length("text").cast("long").alias("chars"))


@query("""WITH rows AS (
  SELECT c_nationkey::VARCHAR AS sheet, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_no,
    '| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' | in \\|debt\\|' ELSE ' | ' END || ' |' AS line
  FROM customer
), padded AS (
  SELECT sheet, row_no, CASE WHEN max(line LIKE '%debt%') OVER (PARTITION BY sheet) THEN line ELSE replace(line, ' |  |', ' |') END AS line FROM rows
)
SELECT sheet, '# Sheet: ' || sheet || chr(10) || chr(10) || max(line) FILTER (row_no = 1) || chr(10)
  || '| --- | --- | --- |' || CASE WHEN bool_or(line LIKE '%debt%') THEN ' --- |' ELSE '' END
  || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY row_no) FILTER (row_no > 1), '') AS text
FROM padded GROUP BY sheet""")
def table_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    c = c.withColumn("row_no", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)
    debt = F.when(F.col("c_acctbal") < 0, F.array(F.lit(" in |debt|"))).otherwise(F.array().cast("array<string>"))
    values = F.concat(F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")), debt)
    cells = c.select(
        F.col("c_nationkey").cast("string").alias("sheet"), "row_no", F.posexplode(values).alias("col_no", "value")
    )
    return S.table_to_markdown(cells)


@query("""SELECT c_custkey, concat_ws(chr(10), 'c_custkey: ' || c_custkey, 'c_name: ' || c_name,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN 'c_mktsegment: ' || c_mktsegment END) AS text FROM customer""")
def rows_to_kv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment"))
    )
    return S.rows_to_kv_docs(c, ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey", "text")


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.html_to_markdown(table(spark, sf_dir, "pages"))


@query(
    "SELECT substr(sha256(text), 1, 1) AS hash_prefix, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1"
)
def write_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("chunk_index"), "text")
    path = scratch_path(spark, "chunks")
    S.write_chunk_table(chunks, path)
    prefix = F.substring("file_hash", 1, 1).alias("hash_prefix")
    return ChunkTable(spark, path).read().groupBy(prefix).agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("chars")
    )


@query("""WITH lines AS (
  SELECT 'c' || c_nationkey || '.csv' AS sheet, c_custkey, '| ' || c_custkey || ' | ' || c_name || ' | ' || replace(c_mktsegment, 'I', '\\|') || ' |' AS line FROM customer
)
SELECT sheet, '# CSV: ' || sheet || chr(10) || chr(10) || '| c_custkey | c_name | c_mktsegment |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg(line, chr(10) ORDER BY c_custkey) AS text FROM lines GROUP BY sheet""")
def read_csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV files by nation and read as tables."""
    c = table(spark, sf_dir, "customer").select(
        "c_nationkey", "c_custkey", "c_name", F.replace("c_mktsegment", F.lit("I"), F.lit("|")).alias("c_mktsegment")
    )
    lines = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), "c_mktsegment")
    files = c.groupBy("c_nationkey").agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", lines.alias("line")))).alias("rows")
    )
    text = F.concat(F.lit("c_custkey,c_name,c_mktsegment\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    path = scratch_path(spark, "csv")
    # a folder a nation, each with one file
    files.select("c_nationkey", text.alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    name = F.concat(F.lit("c"), F.regexp_extract(F.input_file_name(), "c_nationkey=([0-9]+)", 1), F.lit(".csv"))
    cells = S.read_csv_tables(spark, path, "*.txt", name)
    return S.table_to_markdown(cells, "CSV")
