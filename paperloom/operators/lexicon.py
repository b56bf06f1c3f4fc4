"""Words of runs that are written without spaces, by a lexicon."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import is_blank

#: Words of a lexicon at most: it goes to every task whole.
MOST_WORDS = 2_000_000
#: A run of Han characters, or of other letters, digits and `_`.
RUNS = r"\p{IsHan}+|[\p{L}\p{N}_&&[^\p{IsHan}]]+"
HAN = regex.compile(r"\p{Script=Han}")


def best_path(run: str, weight: dict[str, float], longest: int, alone: float) -> list[str]:
    """The cut of a run into words whose weights have the greatest sum; of equal ones the one whose first
    word is longest, and so on. A character that the lexicon doesn't have is a word of weight `alone`."""
    n = len(run)
    best, end = [0.0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        top = None
        for j in range(i + 1, min(n, i + longest) + 1):
            w = weight.get(run[i:j], alone if j == i + 1 else None)
            if w is not None and (top is None or w + best[j] >= top):
                top, end[i] = w + best[j], j
        best[i] = top
    cut, i = [], 0
    while i < n:
        cut.append(run[i : end[i]])
        i = end[i]
    return cut


def tokenize_by_lexicon(chunks: DataFrame, lexicon: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The chunks with `tokens`, of raw_text or, where that is blank, of text; Han runs are cut into a lexicon's words.

    The lexicon has (word, count), words that come again count together, blank ones and counts below one don't.
    A run's cut is the likeliest one if words come independently, as often as counted; a character that no word
    covers is one that was counted once. Other tokens are as in `tokenize_chunks`. Runs are found and
    everything without Han characters is done by Spark's functions; each batch cuts its different runs once.

    The lexicon is the only thing that is sent to all tasks, and one of more than `most_words` words is an error.
    """
    spark = chunks.sparkSession
    words = lexicon.where("word <> '' AND count >= 1").groupBy("word").agg(F.sum("count").cast("double").alias("count"))
    rows = words.limit(most_words + 1).collect()
    if len(rows) > most_words:
        raise ValueError(f"a lexicon of more than {most_words} words")
    total = math.log(sum(r["count"] for r in rows) or 1.0)
    longest = max((len(r["word"]) for r in rows), default=1)
    sent = spark.sparkContext.broadcast({r["word"]: math.log(r["count"]) - total for r in rows})

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = sent.value
        for runs in batches:
            paths: dict[str, list[str]] = {}

            def tokens(own: Iterable[str] | None, paths: dict[str, list[str]] = paths) -> list[str] | None:
                if own is None:
                    return None
                out: list[str] = []
                for run in own:
                    if is_han(run):
                        if run not in paths:
                            paths[run] = best_path(run, weight, longest, -total)
                        out += paths[run]
                    else:
                        out.append(run)
                return out

            yield runs.map(tokens, na_action=None)

    searched = F.when(is_blank(F.col("raw_text")), F.col("text")).otherwise(F.col("raw_text"))
    runs: Column = F.regexp_extract_all(searched, F.lit(RUNS), F.lit(0))
    han = searched.rlike(r"\p{IsHan}")
    return chunks.withColumn("tokens", F.when(han, cut(F.when(han, runs))).otherwise(runs))


def is_han(run: str) -> bool:
    """Whether a run is one of Han characters: such runs hold no others."""
    return HAN.match(run) is not None

