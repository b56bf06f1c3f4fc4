"""Queries of the cleaning operators. A source stands for a file, its documents for the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators import cleaning as C
from paperloom.plans.registry import query, table

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(r"""WITH kept AS (
  SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*[-=_*]{3,}\s*$')), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM documents
) SELECT doc_id, md5(text) AS text_md5 FROM kept WHERE text <> ''""")
def strip_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.strip_separators(table(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("text_md5"))


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("file"),
        F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("page"),
        "doc_id",
        "text",
    )


@query(r"""WITH lines AS (
  SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
), keyed AS (
  SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare, lower(regexp_replace(line, '[\s\d]', '', 'g')) AS key FROM lines
), pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
noise AS (
  SELECT source, key FROM keyed JOIN pages USING (source)
  WHERE bare <> '' AND NOT regexp_matches(bare, '^[|#]') AND length(bare) <= 80 AND length(key) >= 2
  GROUP BY source, key HAVING count(DISTINCT doc_id) > 0.4 * any_value(pages) AND any_value(pages) >= 3
), kept AS (
  SELECT k.doc_id, k.line, k.n FROM keyed k LEFT JOIN noise USING (source, key)
  WHERE noise.key IS NULL OR regexp_matches(bare, '^[|#]') OR length(bare) > 80
)
SELECT d.doc_id, md5(regexp_replace(coalesce(string_agg(k.line, chr(10) ORDER BY k.n), ''), '^\s+|\s+$', '', 'g')) AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
WHERE d.source IN (SELECT source FROM noise) GROUP BY d.doc_id
UNION ALL SELECT doc_id, md5(text) FROM documents WHERE source NOT IN (SELECT source FROM noise)""")
def strip_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.strip_repeated_lines(paged(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) <= 50 AND contains(text, '.')"
)
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("n_images", F.regexp_count("text", F.lit(r"\.")))
    return C.scanned_pages(d).select("doc_id")


@query("""WITH images AS (
  SELECT source AS job, lang AS task, doc_id AS seq, sha256(text) AS image_hash FROM documents
), new AS (
  SELECT * FROM images WHERE image_hash NOT IN (SELECT sha256(text) FROM documents WHERE n_chars < 100)
  QUALIFY row_number() OVER (PARTITION BY job, task, image_hash ORDER BY seq) = 1
)
SELECT job, task, seq, image_hash, (row_number() OVER (PARTITION BY job ORDER BY seq))::INTEGER AS n FROM new
QUALIFY row_number() OVER (PARTITION BY job ORDER BY seq) <= 30""")
def image_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    images = d.select(
        F.col("source").alias("job"),
        F.col("lang").alias("task"),
        F.col("doc_id").alias("seq"),
        F.col("text").alias("content"),
    )
    cache = d.where("n_chars < 100").select(F.col("lang").alias("task"), F.sha2("text", 256).alias("image_hash"))
    return C.image_budget(images, cache)


@query("""WITH pages AS (
  SELECT conv_id AS page_id, text || ' [图片1] ' || role AS text FROM conversations WHERE turn = 0
), images AS (SELECT conv_id AS page_id, turn AS n, text FROM conversations WHERE turn > 0)
SELECT page_id, md5(CASE WHEN i.first IS NULL THEN p.text ELSE replace(p.text, '[图片1]', '[图片: ' || i.first || ']') END || coalesce(i.rest, '')) AS text_md5
FROM pages p LEFT JOIN (
  SELECT page_id, any_value(text) FILTER (n = 1) AS first, string_agg(chr(10) || chr(10) || '[图片: ' || text || ']', '' ORDER BY n) FILTER (n > 1) AS rest FROM images GROUP BY page_id
) i USING (page_id)""")
def image_text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pages = c.where("turn = 0").select(
        F.col("conv_id").alias("page_id"), F.concat("text", F.lit(" [图片1] "), "role").alias("text")
    )
    images = c.where("turn > 0").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("n"), F.col("text").alias("description")
    )
    return C.image_text_merge(pages, images).select("page_id", F.md5("text").alias("text_md5"))
