"""Document quality by weak supervision: rules vote, EM weighs them; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.storage import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for on with as are was it by this an be at or de la le les des et un une du en que qui est pour dans par "
    "sur pas der die das und den von zu mit ist im auf ein eine nicht für el los las por con del se no una su al y lo"
).split()
MIN_WORDS = 50


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with counts of its whole text; a null text counts as empty.

    n_words; word_chars (code points in words); n_symbols; n_lines (with a word); n_dup_lines (equal
    to an earlier line); n_repeat_words (words in three-word windows found twice or more in the
    text); n_stop_words; n_upper; n_ended_lines (that end in a sentence mark).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), words.alias("words"), lines.alias("lines")
    )
    d = d.withColumn("n_words", F.size("words").cast("long"))
    n = F.greatest(F.size("words") - 2, F.lit(0))
    windows = F.arrays_zip(*(F.slice("words", k, n).alias(f"w{k}") for k in (1, 2, 3)))
    d = d.withColumn("marks", F.transform(windows, lambda w: F.xxhash64(w["w1"], w["w2"], w["w3"])))
    d = d.withColumn("repeats", F.size(F.array_distinct("marks")) < F.size("marks"))
    # only a text with a repeated window has its windows sorted, so that equal ones stand together
    numbered = F.transform(F.col("marks"), lambda m, i: F.struct(m.alias("mark"), i.alias("at")))
    d = d.withColumn("sorted", F.when(F.col("repeats"), F.sort_array(numbered)))
    same = lambda x, i: F.get(F.col("sorted"), i)["mark"] == x["mark"]
    places = F.transform(
        F.filter("sorted", lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False))),
        lambda x: x["at"],
    )
    d = d.withColumn("places", F.when(F.col("repeats"), F.sort_array(places)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("covered"))
    covered = F.aggregate(
        "places",
        start,
        lambda s, p: F.struct(p.alias("last"), (s["covered"] + F.least(F.lit(3), p - s["last"])).alias("covered")),
        lambda s: s["covered"],
    )
    count = lambda pattern: F.regexp_count(F.col("text"), F.lit(pattern)).cast("long")
    stop = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    return d.select(
        "doc_id",
        "n_words",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        count(f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        count(r"\p{Lu}").alias("n_upper"),
        F.size(F.filter("lines", lambda x: x.rlike(r"""[.!?…。！？]["'”»)]*\s*$"""))).cast("long").alias("n_ended_lines"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes for a document if `good` holds, against it if `bad` does, else abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("lines", "n_dup_lines = 0 AND n_lines > 1", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("capitals", "10 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    Rule("stop_words", "100 * n_stop_words >= 6 * n_words", "100 * n_stop_words < 2 * n_words"),
    Rule(
        "word_length",
        "word_chars BETWEEN 4 * n_words AND 7 * n_words",
        "word_chars NOT BETWEEN 3 * n_words AND 10 * n_words",
    ),
    Rule("sentences", "10 * n_ended_lines >= 8 * n_lines AND n_lines > 0", "10 * n_ended_lines < n_lines"),
)

#: What is expected before any vote is seen: the share of good documents, and how often a rule's vote
#: is for a good document, for one that has the rule's own kind of damage, and for one of another kind.
GOOD, FOR_GOOD, FOR_OWN_KIND, FOR_OTHER_KIND = 0.9, 0.97, 0.1, 0.8
#: Votes of each rule and class, and documents, that this counts as, however many are seen.
EXPECTED_VOTES = 200.0


@dataclass(frozen=True)
class RuleModel:
    """Shares of good documents (first) and of each rule's kind of damage, and for each of these
    classes the share of each rule's votes that are for a document."""

    shares: tuple[float, ...]
    rates: tuple[tuple[float, ...], ...]

    @staticmethod
    def expected(n: int) -> RuleModel:
        """What is expected of n rules before any vote is seen."""
        kinds = tuple(tuple(FOR_OWN_KIND if j == k else FOR_OTHER_KIND for j in range(n)) for k in range(n))
        return RuleModel((GOOD, *((1 - GOOD) / n for _ in range(n))), ((FOR_GOOD,) * n, *kinds))

    def posterior(self, rules: tuple[Rule, ...]) -> Column:
        """An array: how likely a document with these votes (1, -1 or 0 a rule) is of each class."""

        def log_odds(share: float, rates: tuple[float, ...]) -> Column:
            total = F.lit(math.log(share))
            for rule, rate in zip(rules, rates, strict=True):
                vote = F.col(f"vote_{rule.name}")
                total = total + F.when(vote == 1, math.log(rate)).when(vote == -1, math.log(1 - rate)).otherwise(0.0)
            return total

        logs = F.array(*(log_odds(*c) for c in zip(self.shares, self.rates, strict=True)))
        weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x))


def votes(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with a column vote_<rule> for each rule."""
    return measures.withColumns(
        {f"vote_{r.name}": F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0) for r in rules}
    )


def fit_rules(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 40) -> RuleModel:
    """Expectation-maximisation of the rules' accuracies over all documents.

    A document is good or has one kind of damage, a kind for each rule that looks for it. In each of
    these classes a rule's votes are for a document as often as its accuracy there says, so that a
    common kind of damage is a class of its own and doesn't pass for a trait of good documents.
    Documents are counted by their votes in one aggregation; of these counts there are at most 3 to the number of
    rules, whatever there is of documents, so the driver has them and goes round. It starts
    from what is expected, which counts as EXPECTED_VOTES throughout.
    """
    names = [f"vote_{r.name}" for r in rules]
    counts = [((*(r[n] for n in names),), r["count"]) for r in voted.groupBy(*names).count().orderBy(*names).collect()]
    start = model = RuleModel.expected(len(rules))
    weight = EXPECTED_VOTES
    total = sum(n for _, n in counts)
    for _ in range(rounds if counts else 0):
        members = [0.0] * len(start.shares)
        cast, right = ([[0.0] * len(rules) for _ in start.shares] for _ in range(2))
        for vote, n in counts:
            likely = [
                share * math.prod(x if v == 1 else 1 - x for v, x in zip(vote, rate, strict=True) if v)
                for share, rate in zip(model.shares, model.rates, strict=True)
            ]
            whole = sum(likely)
            for c, x in enumerate(likely):
                own = n * x / whole
                members[c] += own
                for j, v in enumerate(vote):
                    cast[c][j] += own if v else 0.0
                    right[c][j] += own if v == 1 else 0.0
        shares = tuple((m + weight * share) / (total + weight) for m, share in zip(members, start.shares, strict=True))
        rates = tuple(
            tuple(min(0.99, max(0.01, (r + weight * x) / (k + weight))) for r, k, x in zip(*of_class, strict=True))
            for of_class in zip(right, cast, start.rates, strict=True)
        )
        before, model = model, RuleModel(shares, rates)
        moved = zip((*before.shares, *sum(before.rates, ())), (*model.shares, *sum(model.rates, ())), strict=True)
        if max(abs(x - y) for x, y in moved) < 1e-3:
            break
    return model


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per document: the measures, base_failed, kept and quality (posterior probability).

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. kept:
    not base_failed and a posterior of at least one half. No threshold must be passed by each
    rule: a document may break one if the others outweigh it.

    Null and empty texts have no words and fail the base. Rows with null ids and repeated rows are
    judged like any others, each giving a row. No rows give no rows. Only the two named columns
    are read.
    """
    measures = written(text_measures(docs, id_col, text_col), "measures")
    voted = votes(measures, rules)
    voted = voted.withColumn("quality", fit_rules(voted, rules).posterior(rules)[0])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (
            ~failed & (F.col("quality") >= 0.5)
        ).alias("kept"), "quality"
    )
