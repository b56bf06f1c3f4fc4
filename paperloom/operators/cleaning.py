"""Cleaning of page texts and of the images in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import is_blank, stripped

# Fixed value: lines that only part sections.
SEPARATOR = r"(?U)^\s*[-=_*]{3,}\s*$"


def strip_separators(units: DataFrame) -> DataFrame:
    """Units without lines of separator marks; what is blank then goes."""
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(SEPARATOR))
    return units.withColumn("text", stripped(F.array_join(lines, "\n"))).where("text <> ''")


def line_key(line: Column) -> Column:
    """A line without white space and digits, in lower case: equal for the footers of all pages."""
    return F.lower(F.regexp_replace(line, r"(?U)[\s\d]", ""))


def strip_repeated_lines(units: DataFrame, max_share: float = 0.4, least_pages: int = 3, longest: int = 80) -> DataFrame:
    """Units (file, page, text, ...) without lines whose key is on more than a share of the file's pages.

    Table and heading lines, lines over `longest` characters and keys of one character are left;
    so are units without a page and files of few pages. A page's own lines never leave it: the
    repeated keys of its file come to it as one array.
    """
    paged = units.where("page IS NOT NULL")
    line = F.col("line")
    counted = (stripped(line) != "") & ~stripped(line).rlike(r"^[|#]") & (
        F.length(stripped(line)) <= longest
    ) & (F.length(line_key(line)) >= 2)
    keys = paged.select(
        "file", "page", F.explode(F.split("text", "\n")).alias("line")
    ).where(counted).select("file", "page", line_key(line).alias("key"))
    pages = paged.groupBy("file").agg(F.countDistinct("page").alias("pages"))
    seen = keys.groupBy("file", "key").agg(F.countDistinct("page").alias("on"))
    noise = seen.join(pages, "file").where((F.col("pages") >= least_pages) & (F.col("on") > F.col("pages") * max_share))
    noise = noise.groupBy("file").agg(F.collect_set("key").alias("noise"))
    is_noise = lambda x: F.array_contains("noise", line_key(x)) & ~stripped(x).rlike(r"^[|#]") & (
        F.length(stripped(x)) <= longest
    )
    clean = stripped(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~is_noise(x)), "\n"))
    joined_ = units.join(noise, "file", "left")
    return joined_.withColumn(
        "text", F.when(F.col("noise").isNotNull() & F.col("page").isNotNull(), clean).otherwise(F.col("text"))
    ).drop("noise")


def scanned_pages(pages: DataFrame, most_chars: int = 50) -> DataFrame:
    """Pages (text, n_images) that hold next to no text but an image."""
    return pages.where((F.length(stripped(F.coalesce("text", F.lit("")))) <= most_chars) & (F.col("n_images") >= 1))


def image_budget(images: DataFrame, cache: DataFrame, budget: int = 30) -> DataFrame:
    """The images (job, task, seq, content) to describe: not in the cache (task, image_hash), each once
    in a job, and only the first `budget` of a job in order."""
    hashed = images.withColumn("image_hash", F.sha2("content", 256)).join(
        cache.select("task", "image_hash").distinct(), ["task", "image_hash"], "left_anti"
    )
    first = Window.partitionBy("job", "task", "image_hash").orderBy("seq")
    new = hashed.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return new.withColumn(
        "n", F.row_number().over(Window.partitionBy("job").orderBy("seq", "task"))
    ).where(F.col("n") <= budget).select("job", "task", "seq", "image_hash", "n")


def image_text_merge(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages (page_id, text) with their images' (page_id, n, description) in place of [图片n], or after
    the text; descriptions that say nothing are left out."""
    useful = images.where(~is_blank(F.col("description")) & ~stripped(F.col("description")).isin("空字符串", "无内容", "无法识别"))
    found = useful.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("n", F.col("description").alias("text")))).alias("images")
    )
    mark = lambda i: F.concat(F.lit("[图片"), i["n"].cast("string"), F.lit("]"))
    said = lambda i: F.concat(F.lit("[图片: "), i["text"], F.lit("]"))
    fold = F.aggregate(
        "images",
        F.col("text"),
        lambda t, i: F.when(
            F.contains(t, mark(i)), F.replace(t, mark(i), said(i))
        ).otherwise(F.concat(t, F.lit("\n\n"), said(i))),
    )
    return pages.join(found, "page_id", "left").withColumn(
        "text", F.coalesce(F.when(F.col("images").isNotNull(), fold), F.col("text"))
    ).drop("images")
