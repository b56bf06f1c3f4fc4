"""Personal data in texts: labelers vote on candidate spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from paperloom.llm.storage import written

KINDS = ("email", "ip", "card", "phone")
#: Distinct feature rows that the classifier is trained on at most, the most frequent first.
TRAINING_ROWS = 20_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a number that starts inside a run of digits fails wherever one from the run's start does
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED_EMAIL = re.compile(
    r"(?<![\w.%+-])[\w.%+-]{1,64}(?: at |\s?[\[(]at[\])]\s?)[A-Za-z0-9-]{1,63}(?:(?: dot |\s?[\[(]dot[\])]\s?)[A-Za-z0-9-]{2,63}){1,3}(?!\w)",
    re.IGNORECASE,
)
LOCAL_PHONE = re.compile(
    r"(?<![\w+.-])(?:\([0-9]{2,4}\)[ .-]?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"
)
LONG_IP = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")

#: Common top-level domains, and first digits of card issuers.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz io co de fr es uk us it nl ch at be pt pl se no dk fi ie eu ru cn jp br in au ca mx".split()
)
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27")
#: Words before a span that speak for a kind, and words that speak against any.
CONTEXT = {
    "email": {"email", "e-mail", "mail", "contact", "write", "reach", "correo", "courriel", "kontakt", "contacto"},
    "ip": {"ip", "host", "server", "address", "client", "login", "from", "adresse", "servidor", "serveur"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "karte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "anruf"},
}
AGAINST = {
    "version",
    "release",
    "isbn",
    "issn",
    "invoice",
    "order",
    "article",
    "section",
    "page",
    "chapter",
    "serial",
    "id",
    "no",
    "nr",
    "vol",
    "figure",
    "table",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the run of local characters before an @ and a dotted domain."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, other candidates), each (kind number, start, end) in code points.

    Base spans have the plain shape of their kind and pass its test. Candidates are spans that
    fail it, and ones of looser shapes: spelled-out addresses, numbers without a country code,
    long network addresses and shorter card numbers.
    """
    base, more = [], []

    def sort_in(kind: int, spans, passes) -> None:
        for a, b in spans:
            (base if passes(text[a:b]) else more).append((kind, a, b))

    if "@" in text:
        sort_in(0, emails(text), lambda s: True)
    if re.search("[0-9]", text):
        sort_in(1, (m.span() for m in DOTTED.finditer(text)), _octets)
        numbers = [m.span() for m in DIGITS.finditer(text)]
        sort_in(
            2,
            (s for s in numbers if s[1] - s[0] >= 13 and 13 <= len(_digits(text[s[0] : s[1]])) <= 19),
            lambda s: len(_digits(s)) >= 16 and luhn(_digits(s)),
        )
        if "+" in text:
            sort_in(3, (m.span() for m in PLUS.finditer(text)), lambda s: 8 <= len(_digits(s)) <= 15)
        more += [(3, *m.span()) for m in LOCAL_PHONE.finditer(text)]
    if ":" in text:
        more += [(1, *m.span()) for m in LONG_IP.finditer(text)]
    lower = text.lower()
    if " dot " in lower or "dot]" in lower or "dot)" in lower:
        more += [(0, *m.span()) for m in SPELLED_EMAIL.finditer(text)]
    # in the order of the list, then of the text; a candidate that overlaps a base span adds nothing
    taken = sorted((a, b) for _, a, b in base)
    free, k = [], 0
    for kind, a, b in sorted(more, key=lambda s: s[1:]):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            free.append((kind, a, b))
    return sorted(base), sorted(set(free))


#: How often each labeler's votes are right, before any is seen; a checksum is hard to meet by chance.
#: They count as many votes as TRUST_VOTES, whatever the number of votes seen.
TRUST_VOTES = 50.0
TRUST = {"checksum": 0.97, "gazetteer": 0.7, "context": 0.8, "edges": 0.65}
LABELERS = tuple(TRUST)


def ballots(text: str, kind: int, a: int, b: int) -> str:
    """The labelers' votes on a span, a character each: + for personal data, - against, 0 for none."""
    s, digits = text[a:b], _digits(text[a:b])
    if kind == 0:
        checksum = "+" if "@" in s and "." not in (s[0], s[s.index("@") - 1]) and ".." not in s else "-" if "@" in s else "0"
        gazetteer = "+" if re.split(r"[^A-Za-z]+", s.rstrip("])"))[-1].lower() in TOP_DOMAINS else "-"
    elif kind == 1:
        checksum = ("+" if _octets(s) else "-") if ":" not in s else "+"
        gazetteer = "-" if s.startswith("0.") or ":" not in s and len(digits) < 6 else "+" if ":" not in s and s.count(".") == 3 else "0"
    elif kind == 2:
        checksum = "+" if luhn(digits) else "-"
        gazetteer = "+" if digits.startswith(ISSUERS) else "-"
    else:
        checksum = "+" if 8 <= len(digits) <= 15 else "-"
        gazetteer = "+" if s[0] == "+" and digits[0] != "0" or s[0] in "(0" else "0"
    before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, a - 40) : a].lower())[-4:]
    context = "+" if CONTEXT[KINDS[kind]].intersection(before) else "-" if AGAINST.intersection(before[-2:]) else "0"
    left, right = text[a - 1 : a], text[b : b + 1]
    edges = "-" if left.isalnum() or right.isalnum() or left in ("-", "_", "#") and left else "+" if (not left or left.isspace()) and (
        not right or right.isspace() or right in ".,;:!?)"
    ) else "0"
    return checksum + gazetteer + context + edges


def shape(s: str) -> str:
    """Length class, number of digits and separators of a span: few values, whatever the text."""
    return f"{min(len(s) // 4, 10)} {min(len(_digits(s)), 20)} {''.join(c for c in '@.-+( :' if c in s)}"


def around(text: str, a: int, b: int) -> str:
    """The word before a span and the one after it, in lower case, cut to 12 letters; - where there is none."""
    before = re.findall(r"[^\W\d_]+", text[max(0, a - 40) : a])
    after = re.search(r"[^\W\d_]+", text[b : b + 40])
    return f"{before[-1].lower()[:12] if before else '-'} {after.group().lower()[:12] if after else '-'}"


def features(kind: int, votes: str, form: str, near: str) -> list[str]:
    size, digits, marks = form.split(" ", 2)
    before, after = near.split(" ")
    name = KINDS[kind]
    cast = [f"{labeler} {v}" for labeler, v in zip(LABELERS, votes, strict=True)]
    own = [*cast, f"size {size}", f"digits {digits}", f"marks {marks}", f"before {before}", f"after {after}"]
    return [name, *cast, *(f"{name} {x}" for x in own)]


@dataclass(frozen=True)
class SpanModel:
    """Weights of a span's features; a span is personal data if they sum to more than 0."""

    bias: float
    weights: dict[str, float]

    def accepts(self, kind: int, votes: str, form: str, near: str) -> bool:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(kind, votes, form, near)) > 0

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans of a text: the base ones and the candidates that the model accepts."""
        base, more = scan(text)
        looks = lambda k, a, b: (k, ballots(text, k, a, b), shape(text[a:b]), around(text, a, b))
        return sorted(base + [(k, a, b) for k, a, b in more if self.accepts(*looks(k, a, b))])


def span_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, others): a row per document with its spans, votes, shapes and the words around; no text."""

    def looks(text: str, k: int, a: int, e: int) -> dict[str, object]:
        return {
            "kind": k,
            "from": a,
            "to": e,
            "votes": ballots(text, k, a, e),
            "form": shape(text[a:e]),
            "near": around(text, a, e),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scan(text) if text else ([], []) for text in b["text"]]
            out = [[[looks(t, *s) for s in spans] for spans in f] for t, f in zip(b["text"], found, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": [o[0] for o in out], "others": [o[1] for o in out]})

    span = "array<struct<kind:int,from:int,to:int,votes:string,form:string,near:string>>"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInPandas(run, f"doc_id long, base {span}, others {span}")


@dataclass(frozen=True)
class Reliabilities:
    """The share of candidates that are personal data, and the share of each labeler's votes that
    speak for it, among candidates that are (`on_true`) and that aren't (`on_false`)."""

    prior: float
    on_true: np.ndarray
    on_false: np.ndarray

    def probability(self, votes: np.ndarray) -> np.ndarray:
        """Of being personal data, for rows of votes (1 for, -1 against, 0 for none)."""
        odds = np.log(self.prior / (1 - self.prior))
        odds = odds + (votes == 1) @ np.log(self.on_true / self.on_false)
        odds = odds + (votes == -1) @ np.log((1 - self.on_true) / (1 - self.on_false))
        return 1 / (1 + np.exp(-odds))


def fit_spans(table: DataFrame, training_rows: int = TRAINING_ROWS) -> SpanModel:
    """Labeler reliabilities by EM over all candidates, and a classifier that is trained on what the
    labelers together say of a candidate, and sees its shape and the words around it beside the votes.

    EM sees how often each of the at most 81 votes was cast. The classifier sees candidates counted
    by kind, votes, shape and words around, of which the `training_rows` commonest are taken.
    """
    spans = table.select(F.explode(F.concat("base", "others")).alias("s")).select("s.kind", "s.votes", "s.form", "s.near")
    cast = spans.groupBy("votes").count().orderBy("votes").collect()
    found = reliabilities(_signs(cast), np.array([r["count"] for r in cast], dtype=float))
    kinds = ("kind", "votes", "form", "near")
    counts = spans.groupBy(*kinds).count().orderBy(F.desc("count"), *kinds).limit(training_rows).collect()
    n = np.array([r["count"] for r in counts], dtype=float)
    return _classifier([features(*(r[c] for c in kinds)) for r in counts], found.probability(_signs(counts)), n)


def _signs(rows: list[Row]) -> np.ndarray:
    return np.array([[{"+": 1, "-": -1}.get(v, 0) for v in r["votes"]] for r in rows]).reshape(len(rows), len(LABELERS))


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> Reliabilities:
    """EM from rows of votes (1, -1, 0 for none) seen n times each, which starts from the trust in the
    labelers and adds TRUST_VOTES votes of that trust.

    Votes for and against are judged apart among true and false candidates, so that a labeler who
    says the same of both has no weight.
    """
    trust = np.array(list(TRUST.values()))
    found = Reliabilities(0.5, trust, 1 - trust)
    if not len(votes):
        return found
    share = lambda p, start: (
        ((votes == 1).T @ (n * p)) + TRUST_VOTES * start
    ) / (((votes != 0).T @ (n * p)) + TRUST_VOTES)
    for _ in range(rounds):
        p = found.probability(votes)
        prior = (n @ p + TRUST_VOTES / 2) / (n.sum() + TRUST_VOTES)
        found = Reliabilities(prior, np.clip(share(p, trust), 0.01, 0.99), np.clip(share(1 - p, 1 - trust), 0.01, 0.99))
    return found


def _classifier(
    rows: list[list[str]], target: np.ndarray, n: np.ndarray, steps: int = 300, ridge: float = 1e-4
) -> SpanModel:
    """Logistic regression of soft labels, rows weighted by the root of how often they were seen.

    Only the features that a row has are held, so memory follows their number, not that of all names.
    """
    names = sorted({f for r in rows for f in r})
    if not names:
        return SpanModel(0.0, {})
    number = {f: i for i, f in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([number[f] for r in rows for f in r])
    weight = np.sqrt(n) / np.sqrt(n).sum()
    w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + w[-1]
        off = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        grad = np.r_[np.bincount(col, off[row], len(names)), off.sum()] + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return SpanModel(float(w[-1]), {f: float(w[i]) for f, i in number.items()})


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans, `spans` lists all, as kind:start:end by kind and
    start, in code points. Null and empty texts have none. Null ids and repeated rows are rows
    like any others. No rows give no rows. Only the two named columns are read.
    """
    table = written(span_table(docs, id_col, text_col), "spans")
    model = fit_spans(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base = [[(s["kind"], s["from"], s["to"]) for s in spans] for spans in b["base"]]
            more = [
                [
                    (s["kind"], s["from"], s["to"]) for s in spans if model.accepts(
                        s["kind"], s["votes"], s["form"], s["near"]
                    )
                ] for spans in b["others"]
            ]
            out = pd.DataFrame({"doc_id": b["doc_id"]})
            for k, name in enumerate(KINDS):
                out[f"n_{name}"] = [sum(s[0] == k for s in spans) for spans in base]
            out["base_sha256"] = [hashlib.sha256(_listed(spans).encode()).hexdigest() for spans in base]
            out["spans"] = [_listed(x + y) for x, y in zip(base, more, strict=True)]
            yield out

    return table.mapInPandas(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced in their text by its kind, with all their columns.

    Null texts stay null and empty ones empty; repeated rows and rows without an id are cleaned like
    any others, whole texts however long. Columns of any other name stay. No rows give no rows.
    """
    model = fit_spans(written(span_table(docs, id_col, text_col), "spans"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: redacted(t, model.spans(t)), na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    clean: Column = F.pandas_udf(run, "string")(F.col(text_col).cast("string"))
    return docs.withColumn(text_col, clean)
