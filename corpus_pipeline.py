"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.mixing import mix_documents
from paperloom.llm.packing import packed_documents
from paperloom.llm.pii import without_personal_data
from paperloom.llm.simhash import one_of_each
from paperloom.llm.storage import written
from paperloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; all others stay as they are, in all columns.

    Null and empty texts have the score of a text without known words. Repeated rows stay or go
    together, rows without an id are judged by their text alone. No documents give none.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Near copies are found by the SimHash operator's trie self-join over fingerprints of five-word
    shingles, at a number of bits that stands for a Jaccard score of 0.8. Null and empty texts are
    copies of each other. Rows that repeat an id are one document; rows without an id stay.
    """
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows, if there is such a column.

    Every row stays, repeated ones and ones without an id too; null texts stay null and then have
    no n_chars, empty ones stay empty.
    """
    clean = without_personal_data(docs)
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).to(docs.schema)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Documents without a word (null and empty texts among them) are never taken, since the mix is
    of words. Null sources are one source. No documents give none.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in training sequences, one row per piece.

    A null or empty text has the end token alone; repeated rows and rows without an id are packed
    like any others. No documents give no rows.
    """
    return packed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: The tokens of the last stage and the classifier of the first can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole documents table; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
