"""Prompts from contexts, and the sources that an answer cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import joined

UNKNOWN = "未知来源"


def context_line(no: Column, filename: Column, section: Column, first: Column, last: Column, text: Column) -> Column:
    """One numbered context with its file, section and pages."""
    pages = F.when(
        first.isNotNull() & (first != 0),
        F.concat(
            F.lit(" | 第"),
            first.cast("string"),
            F.when(
                last.isNotNull() & (last != 0) & (last != first), F.concat(F.lit("-"), last.cast("string"))
            ).otherwise(""),
            F.lit("页"),
        ),
    ).otherwise("")
    part = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" | 章节: "), section)).otherwise("")
    return F.concat(
        F.lit("["),
        no.cast("string"),
        F.lit("] (来源: "),
        F.coalesce(filename, F.lit(UNKNOWN)),
        part,
        pages,
        F.lit(")\n"),
        text,
    )


def format_context(contexts: DataFrame) -> DataFrame:
    """(query_id, context): each query's contexts, numbered in order, with blank lines between."""
    line = context_line(
        F.col("context_no"), F.col("filename"), F.col("section"), F.col("page_start"), F.col("page_end"), F.col("text")
    )
    return contexts.groupBy("query_id").agg(
        joined(F.collect_list(F.struct("context_no", line.alias("text"))), "\n\n").alias("context")
    )


def build_messages(requests: DataFrame, system: str = "{context}") -> DataFrame:
    """Requests (query_id, query, context, history) with `messages`: system, history and user."""
    before, _, after = system.partition("{context}")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    first = F.array(message("system", F.concat(F.lit(before), F.coalesce("context", F.lit("")), F.lit(after))))
    said = F.transform(
        F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")),
        lambda h: F.struct(h["role"].alias("role"), h["content"].alias("content")),
    )
    return requests.withColumn("messages", F.concat(first, said, F.array(message("user", F.col("query")))))


def select_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources (query_id, source_no, ...) that each answer cites as [n], with citation_index.

    They come in the order of first mention (`place`); numbers out of range are left out, and an
    answer that cites none has all its sources.
    """
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,9})\]")), lambda n: n.cast("int")))
    cited = answers.select("query_id", F.posexplode(numbers).alias("place", "source_no"))
    hit = sources.join(cited, ["query_id", "source_no"])
    none = sources.join(answers.select("query_id"), "query_id", "left_semi").join(
        hit.select("query_id").distinct(), "query_id", "left_anti"
    ).withColumn("place", F.col("source_no") - 1)
    return hit.unionByName(none).withColumn("citation_index", F.col("source_no"))


def source_payload(contexts: DataFrame) -> DataFrame:
    """Cards of contexts; columns that a table lacks fall back to others, nulls do not."""
    has = lambda c, *other: F.col(c) if c in contexts.columns else has(*other) if other and isinstance(other[0], str) else other[0] if other else F.lit(None)
    return contexts.select(
        "query_id", has("filename", F.lit(UNKNOWN)).alias("filename"), has(
            "matched_chunk_index", "chunk_index"
        ).alias("chunk_index"), has("section", F.lit("")).alias("section"),
        has("page_start", "page").alias("page_start"), has(
            "page_end", "page_start", "page"
        ).alias("page_end"), has("parent_id", F.lit("")).alias("parent_id"), F.col("text").alias("content"),
    )


RESULT = "array<struct<name:string,title:string,url:string,snippet:string,summary:string,content:string>>"


def normalize_search_results(responses: DataFrame) -> DataFrame:
    """(response_id, result_no, title, url, content) of the JSON bodies of two web searches.

    One nests its results in data.webPages.value, the other has `results`; rows without a url go.
    """
    body = F.from_json("body", f"struct<data:struct<webPages:struct<value:{RESULT}>>,results:{RESULT}>")
    r = responses.select("response_id", body.alias("b"))
    items = r.select(
        "response_id",
        F.posexplode(
            F.filter(F.coalesce("b.data.webPages.value", "b.results"), lambda x: F.coalesce(x["url"], F.lit("")) != "")
        ).alias("result_no", "r"),
    )
    given = lambda *cols: F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in cols))
    return items.select(
        "response_id",
        "result_no",
        given("r.name", "r.title", "r.url").alias("title"),
        "r.url",
        F.coalesce(given("r.snippet", "r.summary", "r.content"), F.lit("")).alias("content"),
    )


def search_summary(results: DataFrame, most: int = 200) -> DataFrame:
    """(response_id, summary): numbered results, their content cut to `most` characters."""
    line = F.concat(
        (F.col("result_no") + 1).cast("string"),
        F.lit(". "),
        "title",
        F.lit("\n"),
        F.substring("content", 1, most),
        F.lit("\n"),
        "url",
    )
    return results.groupBy("response_id").agg(
        joined(F.collect_list(F.struct("result_no", line.alias("text"))), "\n\n").alias("summary")
    )


def dedupe_sources(sources: DataFrame, by: str = "content") -> DataFrame:
    """The first (smallest source_no) of a query's sources with the same start of content, or the
    same title and url."""
    key = [F.substring("content", 1, 100)] if by == "content" else [F.col("title"), F.col("url")]
    first = F.row_number().over(Window.partitionBy("query_id", *key).orderBy("source_no"))
    return sources.withColumn("nth", first).where("nth = 1").drop("nth")
