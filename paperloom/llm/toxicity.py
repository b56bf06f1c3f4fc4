"""Toxicity of whole texts: a word classifier whose scores must not hang on identity terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.storage import written

#: Labelled rows that the classifier is fitted on at most, and its features at most.
SAMPLE_ROWS, FEATURES = 20_000, 4_000
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8, 9)
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?…\n]+")
#: Kinds of identity terms; those of one kind may stand for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "turkish", "polish"),
    ("immigrant", "immigrants", "refugee", "refugees", "native", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer", "juden", "muslime", "christen", "ausländer", "deutsche", "türken"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens", "étrangers", "français", "arabes"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos", "extranjeros", "españoles", "gitanos"),
)


#: Mentions of a group that are put into sentences of texts that mention none.
MENTIONS = ("the {} next door", "many {} people", "{} friends of ours")


def word_features(word: str) -> list[str]:
    """A lower-case word itself and its beginnings, which are marked by a following hyphen."""
    return [word, *(word[:n] + "-" for n in PREFIXES if n < len(word))]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of features that a text has or lacks; the score is the logistic of their sum.

    `pairs` is the number of counterfactual pairs of sentences that the fit was held to.
    """

    bias: float
    weights: dict[str, float]
    pairs: int = 0

    def scores(self, texts: pd.Series, memo: dict[str, tuple[str, ...]]) -> np.ndarray:
        known, out = self.weights, np.empty(len(texts))
        for i, text in enumerate(texts):
            seen: set[str] = set()
            for word in text_words(text):
                held = memo.get(word)
                if held is None:
                    held = memo[word] = tuple(f for f in word_features(word) if f in known)
                if held:
                    seen.update(held)
            out[i] = self.bias + sum(known[f] for f in sorted(seen))
            if len(memo) > 500_000:
                memo.clear()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

    def score(self, text: Column) -> Column:
        """The column of scores of a column of whole texts."""
        model = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            memo: dict[str, tuple[str, ...]] = {}
            for texts in batches:
                yield pd.Series(model.scores(texts, memo))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept out of training: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def swapped(words: set[str], pick: int, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> set[str] | None:
    """The words with each identity term swapped for another of its kind; None if they have none."""
    swaps = {w: kind for kind in identities for w in words.intersection(kind)}
    if not swaps:
        return None
    other = {w: kind[(kind.index(w) + 1 + pick % (len(kind) - 1)) % len(kind)] for w, kind in swaps.items()}
    return {other.get(w, w) for w in words}


def counterfactuals(
    text: str | None, pick: int, identities: tuple[tuple[str, ...], ...] = IDENTITIES
) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets whose scores must not differ: sentences of a text, and what they become.

    Each sentence with identity terms is paired with itself after a swap. If none has any, a
    mention is put into one of its sentences, which is paired with the plain sentence and with the
    same mention of another group. `pick` chooses among terms, mentions and sentences.
    """
    sentences = [set(WORD.findall(s)) for s in SENTENCE_END.split(text.lower())] if text else [set()]
    found = [(words, other) for words in sentences if (other := swapped(words, pick, identities))]
    if found or not identities:
        return found
    plain = sentences[pick % len(sentences)]
    kind = identities[pick % len(identities)]
    mention = MENTIONS[pick // 7 % len(MENTIONS)]
    own, other = kind[pick // 3 % len(kind)], kind[(pick // 3 + 1) % len(kind)]
    about = lambda term: plain | set(WORD.findall(mention.format(term)))
    return [(plain | set(WORD.findall(mention.format(""))), about(own)), (about(own), about(other))]


def training_rows(
    docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str, identities: tuple[tuple[str, ...], ...] = IDENTITIES
) -> DataFrame:
    """(doc_id, toxic, words, pairs) of at most `sample_rows` labelled documents that aren't held out.

    They are those with the smallest hashes of their ids. A document with several labels is toxic
    if one of them says so; of rows that repeat an id one counts, with the smallest text. The sample's ids are broadcast; they are as many at most. pairs has
    the features that only one side of each counterfactual pair has, on either side.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("key IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("key")))
    chosen = marked.groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def differences(text: str | None, pick: int) -> list[dict[str, list[str]]]:
        sides = [(features(a), features(b)) for a, b in counterfactuals(text, pick, identities)]
        return [{"minus": sorted(a - b), "plus": sorted(b - a)} for a, b in sides]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [sorted(text_words(t)) for t in b["text"]]
            pairs = [differences(t, int(d)) for t, d in zip(b["text"], b["doc_id"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "words": words, "pairs": pairs})

    own = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("key")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    pair = "array<struct<minus:array<string>,plus:array<string>>>"
    return own.mapInPandas(run, f"doc_id long, toxic int, words array<string>, pairs {pair}")


def chosen_features(rows: DataFrame, features: int) -> list[str]:
    """The features whose presence tells most of the label, by a weighted log odds ratio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                toxic, clean = Counter(), Counter()
                for label, words in zip(b["toxic"].iloc[at : at + 1000], b["words"].iloc[at : at + 1000], strict=True):
                    (toxic if label else clean).update({f for w in words for f in word_features(w)})
                names = list(toxic | clean)
                yield pd.DataFrame(
                    {"feature": names, "toxic": [toxic[n] for n in names], "clean": [clean[n] for n in names]}
                )

    n = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not n[0] or n[0] == n[1]:
        return []
    seen = rows.select("toxic", "words").mapInPandas(run, "feature string, toxic long, clean long").groupBy("feature")
    seen = seen.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t + c >= 3")
    ratio = F.log((F.col("t") + 0.5) / (n[0] + 1)) - F.log((F.col("c") + 0.5) / (n[1] - n[0] + 1))
    weight = F.when(ratio > 0, ratio * F.sqrt("t")).otherwise(-ratio * F.sqrt("c") / 4)
    return [r[0] for r in seen.orderBy(weight.desc(), "feature").limit(features).select("feature").collect()]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES, id_col: str = "doc_id",
    text_col: str = "text", swap_weight: float = 10.0, ridge: float = 1e-3,
    identities: tuple[tuple[str, ...], ...] = IDENTITIES,
) -> ToxicityModel:
    """A logistic model of labels.toxic that is penalised for changes under counterfactuals.

    It is fitted on a bounded sample of labelled documents (`sample_rows`), none of them held out,
    by at most `n_features` features and those of the identity terms. In the sample's sentences
    identity terms are swapped for others of their kind, or put in where a text has none, and
    `swap_weight` times the mean squared change of the sum of weights is added to the loss: a
    group's name alone must not raise a score. So there are pairs on every corpus with labels.

    Of the sample the driver gets the labels, the numbers of the features that each text has, and
    counts of the distinct differences between two sides of a pair, which hang on the terms.
    Without labels of both kinds the model knows no feature and scores all texts alike.
    """
    rows = written(training_rows(docs, labels, sample_rows, id_col, text_col, identities), "labelled")
    names = chosen_features(rows, n_features)
    if names:
        names += sorted({f for kind in identities for w in kind for f in word_features(w)} - set(names))
    number = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            has = [sorted({number[f] for w in words for f in word_features(w) if f in number}) for words in b["words"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "has": has})

    got = rows.select("doc_id", "toxic", "words").mapInPandas(run, "doc_id long, toxic int, has array<int>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["toxic"], r["has"]))
    y = np.array([r["toxic"] for r in got], dtype=float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    if not names:
        return ToxicityModel(bias, {})
    pairs = rows.select(
        F.explode("pairs").alias("p")
    ).groupBy("p.minus", "p.plus").count().orderBy("minus", "plus").collect()
    known = lambda side: [number[f] for f in side if f in number]
    sides = [(known(r["minus"]), known(r["plus"]), r["count"]) for r in pairs]
    bias, w = _fit([r["has"] for r in got], y, sides, len(names), bias, swap_weight, ridge)
    weights = {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-4}
    return ToxicityModel(bias, weights, sum(r["count"] for r in pairs))


def _fit(
    has: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int], int]], n: int, bias: float,
    swap_weight: float, ridge: float, steps: int = 400,
) -> tuple[float, np.ndarray]:
    """Adam on the mean logistic loss, the ridge and the mean squared change between two sides.

    A pair is the features that either side alone has, and how often it was seen.
    """
    row = np.repeat(np.arange(len(has)), [len(h) for h in has])
    col = np.concatenate([np.asarray(h, dtype=np.int64) for h in has]) if len(row) else np.empty(0, np.int64)
    sides = [(k, f, s) for k, (minus, plus, _) in enumerate(pairs) for s, side in ((-1.0, minus), (1.0, plus)) for f in side]
    p_row, p_col, p_sign = (np.array(x) for x in zip(*sides, strict=True)) if sides else (np.empty(0, np.int64),) * 3
    often = np.array([c for _, _, c in pairs], dtype=float)
    x, m, v = np.r_[np.zeros(n), bias], np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, x[col], len(y)) + x[n]
        off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        grad = np.r_[np.bincount(col, off[row], n) + ridge * x[:n], off.sum()]
        if len(p_row):
            change = np.bincount(p_row, p_sign * x[p_col], len(pairs)) * often / often.sum()
            grad[:n] += 2 * swap_weight * np.bincount(p_col, p_sign * change[p_row], n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        pace = 0.1 * (1 - (step - 1) / steps)
        x = x - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(x[n]), x[:n]


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted (score >= threshold).

    The score comes from the whole text alone. Null and empty texts have the score of a text
    without known words. Null ids aren't held out; repeated rows score alike. No rows give no
    rows, and labels of unknown documents or of other values than 0 and 1 are left out.
    """
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The documents that score below the threshold, with all their columns.

    Null and empty texts score as texts without known words; rows without an id and repeated rows
    are judged by their text. Columns of any other name stay. No rows give no rows.
    """
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(model.score(F.col(text_col)) < threshold)
