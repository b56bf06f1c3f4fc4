"""Files, tables and pages as unit tables, and the chunk table as a sink."""

from __future__ import annotations

import csv
import io
import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.html import page_markdown
from paperloom.functions.text import extension, is_blank, stripped
from paperloom.sources.chunk_table import ChunkTable

#: Characters of a cell of a CSV file at most, as many as a text can have.
LONGEST_CELL = 2**31 - 1
#: Accepted file types, split modes and the size limit.
EXTENSIONS = (".pdf", ".docx", ".txt", ".md", ".csv", ".html", ".xlsx", ".pptx")
SPLIT_MODES = ("auto", "parent_child", "semantic", "fixed", "markdown")
MAX_BYTES = 20 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, size_bytes, content) of the files under a path; Spark passes over empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), "content"
    )


def upload_validate(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files with `accepted` and, for rejected ones, `reason`: type, then split mode, then size."""
    mode = F.col("split_mode")
    reason = F.when(
        ~extension(F.col("filename")).isin(*extensions), "extension"
    ).when(mode.isNotNull() & ~mode.isin(*SPLIT_MODES), "split_mode").when(F.col("size_bytes") > max_bytes, "size")
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def file_fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """The files with file_hash (SHA-256 of the bytes) and stored_name, under which it is kept once."""
    ext = extension(F.col("filename"))
    return files.withColumn("file_hash", F.sha2(F.col(content), 256)).withColumn(
        "stored_name", F.concat("file_hash", F.when(ext == "", ".bin").otherwise(ext))
    )


#: The part of a path that is the file's name, escaped as in addresses.
FILE_NAME = r"([^/]+)$"


def _file_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_extract(path, FILE_NAME, 1), F.lit("+"), F.lit("%2B")))


#: Of a scan of text files, bytes and partitions that a task reads.
TASK_BYTES, TASK_PARTS = 16_000_000, 32


def read_text_units(
    spark: SparkSession, path: str, pattern: str = "*", name: Column | None = None, per_batch: int | None = None
) -> DataFrame:
    """One unit per text file under a path: (file_hash, filename, unit_no, page, sheet, text).

    Files are in UTF-8, with or without a byte order mark, which is no text; file_hash is that of the bytes
    (what isn't UTF-8 counts as replaced). A file is named after itself or by `name`, a column of input_file_name.
    Small files share tasks; one file is one row, so its size is bounded by what `upload_validate` accepts.
    Spark passes over empty files, which would give no chunks.

    With `per_batch` the units are a stream, of that many files a batch, oldest first; files that are added
    later come in later batches, and each file comes once.
    """
    reader = spark.read if per_batch is None else spark.readStream.option("maxFilesPerTrigger", per_batch)
    files = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    files = _shared_tasks(files) if per_batch is None else files
    named = _file_name(F.input_file_name()) if name is None else name
    units = text_units(files.select(named.alias("filename"), F.col("value").alias("text")))
    return units.withColumn("text", F.regexp_replace("text", "^\ufeff", ""))


#: What stands for a missing name in the name of a folder.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_text_files(texts: DataFrame, path: str, folders: int = 128) -> None:
    """A text file for each (filename, text), with a line end after its text, which `read_text_units` reads by `written_name`.

    A file lies in a folder of its name, and these under as many others as tasks write; above 32 Spark lists them in
    tasks. Rows of one name are files beside each other. In a local or mounted folder tasks make the files
    themselves, as Hadoop starts a process or more for each that it makes there; other stores get them by Spark's writer.
    """
    spark = texts.sparkSession
    dealt = texts.select("filename", F.col("text").alias("value")).repartition(folders, "filename")
    nth = F.row_number().over(Window.partitionBy("filename").orderBy("value"))
    rows = dealt.withColumns({"bucket": F.spark_partition_id(), "nth": nth})
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri()
    if whole.getScheme() != "file":
        rows.write.partitionBy("bucket", "filename", "nth").text(path)
        return
    folder = whole.getPath()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, text, bucket, n in zip(b["filename"], b["value"], b["bucket"], b["nth"], strict=True):
                own = f"{folder}/bucket={bucket}/filename={NO_NAME if name is None else quote(name, safe=' ')}"
                os.makedirs(own, exist_ok=True)
                # whole or not at all, also where a task runs twice
                part = f"{own}/{n}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(f"{text or ''}\n".encode())
                os.replace(part, f"{own}/{n}.txt")
            yield b[["bucket"]].iloc[:0]

    os.makedirs(folder, exist_ok=True)
    rows.mapInPandas(run, "bucket int").write.format("noop").mode("overwrite").save()


def written_name() -> Column:
    """The name that a file of `write_text_files` was given."""
    path = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    return F.url_decode(F.replace(F.nullif(F.regexp_extract(path, "filename=([^/]+)/", 1), F.lit(NO_NAME)), F.lit("+"), F.lit("%2B")))


def _shared_tasks(files: DataFrame) -> DataFrame:
    """The scan of small files in fewer tasks, as Spark gives a task only as many as 4 MB each would fill; what large ones need stays."""
    parts = files.rdd.getNumPartitions()
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES), -(-parts // TASK_PARTS))
    return files.coalesce(least) if least < parts else files


def text_units(files: DataFrame) -> DataFrame:
    """One unit per (filename, text) row."""
    nothing = F.lit(None)
    return files.select(
        F.sha2("text", 256).alias("file_hash"),
        "filename",
        F.lit(0).cast("long").alias("unit_no"),
        nothing.cast("long").alias("page"),
        nothing.cast("string").alias("sheet"),
        "text",
    )


def _cell(value: Column) -> Column:
    text = F.coalesce(value, F.lit(""))
    return stripped(
        F.replace(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")), F.lit("\r"), F.lit(" "))
    )


def table_to_markdown(cells: DataFrame, heading: str = "Sheet") -> DataFrame:
    """(sheet, text): each sheet's cells (sheet, row_no, col_no, value) as a heading and a table.

    Short rows are filled up to the widest. Rows are built first, so a sheet's cells meet as lines.
    """
    width = cells.groupBy("sheet").agg((F.max("col_no") + 1).alias("width"))
    rows = cells.groupBy("sheet", "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col_no", _cell(F.col("value"))))).alias("by_col")
    ).join(width, "sheet")
    columns = F.transform(
        F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at(F.col("by_col"), c), F.lit(""))
    )
    line = F.concat(F.lit("| "), F.array_join(columns, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    lines = rows.select("sheet", "row_no", rule.alias("rule"), line.alias("text"))
    tables = lines.groupBy("sheet").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("rows"), F.first("rule").alias("rule")
    )
    texts = F.transform("rows", lambda r: r["text"])
    whole = F.array_join(
        F.concat(F.slice(texts, 1, 1), F.array("rule"), F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0)))),
        "\n",
    )
    return tables.select("sheet", F.concat(F.lit(f"# {heading}: "), "sheet", F.lit("\n\n"), whole).alias("text"))


def rows_to_kv_docs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with `text`: a line `column: value` for each cell that isn't blank; rows with none go."""
    line = lambda c: F.when(
        ~is_blank(F.col(c).cast("string")), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))
    )
    return rows.withColumn("text", F.concat_ws("\n", *map(line, columns))).where("text <> ''")


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): pages as Markdown, without scripts, styles and comments; empty ones go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["page_id", "url"]].assign(text=[page_markdown(h) if h else "" for h in b["html"]])
            yield out[out["text"] != ""]

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string")


def write_chunk_table(chunks: DataFrame, path: str, prefix: int = 1) -> int:
    """Appends chunks to the chunk table at a path (`ChunkTable`), by the first digits of the file's hash; the number appended.

    pk follows from the file and the chunk's place in it. Chunks whose key the table already has, or
    that come twice, are not written again, so a write that failed half-way can be repeated. Of the
    table only the keys under the prefixes at hand are read.
    """
    return ChunkTable(chunks.sparkSession, path, prefix).append(chunks)


def read_csv_tables(
    spark: SparkSession, path: str, pattern: str = "*.[cC][sS][vV]", name: Column | None = None
) -> DataFrame:
    """(sheet, row_no, col_no, value): the cells of the CSV files under a path, for table_to_markdown.

    A file is a table named after it (or by `name`, a column of input_file_name), in UTF-8 with or without a byte order mark; its rows follow
    each other as they stand. Quoted cells may hold commas and line ends. A file is one row of the
    scan and is parsed in one task; files beside it go to others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(LONGEST_CELL)
        for b in batches:
            for name, text in zip(b["sheet"], b["text"], strict=True):
                rows = csv.reader(io.StringIO((text or "").removeprefix("\ufeff"), newline=""))
                cells = [(name, i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row)]
                yield pd.DataFrame(cells, columns=["sheet", "row_no", "col_no", "value"])

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    own = _file_name(F.input_file_name()) if name is None else name
    files = files.select(own.alias("sheet"), F.col("value").alias("text"))
    return files.mapInPandas(run, "sheet string, row_no int, col_no int, value string")
