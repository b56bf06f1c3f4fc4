"""Passages that documents share: MinHash bands over paragraphs, exact verification, components."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.components import connected_components
from paperloom.llm.storage import written

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of Jaccard similarity s meets in a band with probability 1 - (1 - s**ROWS)**BANDS: 0.97 at 0.8,
#: 0.998 at 0.9, 0.13 at 0.3.
BANDS, ROWS = 5, 3
#: Words from which a paragraph may end at a sentence, and from which at certain words.
LEAST_WORDS, MANY_WORDS = 8, 32
#: Words that a run of shared paragraphs must have to count: a passage of 50 words less its first sentence.
RUN_WORDS = 25
#: Characters of texts that are cut at once, so that the texts of a batch don't add up.
BATCH_CHARS = 500_000
#: Marks that a task remembers to have given shingles for.
MEMORY = 500_000

#: Bits a shared band key has in the filter that spares a shuffle of all others, and the filter's most
#: bits (32 MB). Where there are more keys there is no filter; the join alone decides what meets.
FILTER_SHARE, FILTER_MOST = 16, 1 << 28

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_P = 0x100000001B3
_P_INVERSE = pow(_P, -1, 1 << 64)

#: Kinds of characters: white space, marks that end a sentence, and marks that may follow these.
SPACE, END, CLOSE = 1, 2, 3
_KINDS = np.zeros(0x3002, dtype=np.uint8)
_KINDS[[i for i in range(0x3001) if chr(i).isspace()]] = SPACE
_KINDS[[ord(c) for c in ".!?…"]] = END
_KINDS[[ord(c) for c in "\"'”’)]»"]] = CLOSE


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _lower(text: str) -> str:
    """The text in lower case, with each character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Paragraphs:
    """The paragraphs of many texts: where each is, its words' hashes, and hashes of all its words.

    A paragraph is a sentence, or line, or a few that are short: it ends at the first end of a
    sentence or line after LEAST_WORDS words. Past MANY_WORDS words it also ends after words that
    a hash picks. So where it ends depends on what it holds, and a passage is cut alike wherever it
    stands, from its first whole sentence on. Words are runs without white space, in lower case.

    text, number, start, end and count have a row for each paragraph: its text's place in `texts`,
    its number there, its first and end character, and its number of words. Its words are hashes
    from `first` on.
    """

    def __init__(self, texts):
        held = [_lower(t) if t else "" for t in texts]
        ends = np.cumsum([len(t) + 1 for t in held]) - 1
        code = np.frombuffer("\n".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KINDS[np.minimum(code, len(_KINDS) - 1)]
        space = kind == SPACE
        word_at = np.flatnonzero(~space & np.r_[True, space[:-1]][: len(code)])
        word_end = np.flatnonzero(~space & np.r_[space[1:], True][: len(code)]) + 1
        self.hashes = self._word_hashes(code, word_at, word_end)

        # a sentence ends before white space that an end mark and closing marks stand before
        last = np.maximum.accumulate(np.where(kind != CLOSE, np.arange(len(code)), 0))
        before = np.r_[0, kind[last]][: len(code)]
        stops = np.r_[np.flatnonzero(space & (before == END)), np.flatnonzero(code == 10) + 1, ends]
        stops = np.unique(stops).astype(np.int64)
        words = np.searchsorted(word_at, stops).tolist()
        picked = np.flatnonzero((self.hashes >> np.uint64(20)) % np.uint64(8) == 0).tolist()
        word_end, stops = word_end.tolist(), stops.tolist()

        rows: list[tuple[int, int, int, int, int, int]] = []
        stop, word = 0, 0
        for i, t1 in enumerate(ends.tolist()):
            t0 = at = t1 - len(held[i])
            k = 0
            while stop < len(stops) and stops[stop] <= t0 and stops[stop] < t1:
                word = words[stop]
                stop += 1
            while stop < len(stops) and stops[stop] <= t1:
                here, upto = stops[stop], words[stop]
                stop += 1
                n = upto - word
                if n == 0:
                    at = here
                elif n > MANY_WORDS:
                    for a, b, w, m in self._cut(at, here, word, upto, word_end, picked):
                        rows.append((i, k, a - t0, b - t0, w, m))
                        k += 1
                elif n >= LEAST_WORDS or here == t1:
                    rows.append((i, k, at - t0, here - t0, word, n))
                    k += 1
                else:
                    continue
                at, word = here, upto
        self.text, self.number, self.start, self.end, self.first, self.count = np.array(rows, dtype=np.int64).reshape(-1, 6).T
        # all words in order, and their number
        place = np.arange(len(self.hashes)) - np.repeat(self.first, self.count)
        own = _mixed((self.hashes + place.astype(np.uint64) * _M1) * _M1)
        sums = np.add.reduceat(own, self.first) if len(rows) else np.empty(0, np.uint64)
        self.marks = _mixed(sums + self.count.astype(np.uint64) * _M2).view(np.int64)

    @staticmethod
    def _word_hashes(code: np.ndarray, word_at: np.ndarray, word_end: np.ndarray) -> np.ndarray:
        """A hash of the characters of each word, the same wherever it stands."""
        sums = np.r_[np.uint64(0), np.cumsum((code + np.uint32(1)) * _powers(_P, len(code)), dtype=np.uint64)]
        own = (sums[word_end] - sums[word_at]) * _powers(_P_INVERSE, len(code))[word_at]
        return _mixed(own * _M1 + (word_end - word_at).astype(np.uint64))

    @staticmethod
    def _cut(
        at: int, stop: int, word: int, upto: int, word_end: list[int], picked: list[int]
    ) -> Iterator[tuple[int, int, int, int]]:
        """A long sentence in parts (start, end, first word, words) that end after words whose hash says so."""
        for k in range(bisect_left(picked, word), bisect_left(picked, upto - 1)):
            if picked[k] + 1 - word >= LEAST_WORDS:
                yield at, word_end[picked[k]], word, picked[k] + 1 - word
                at, word = word_end[picked[k]], picked[k] + 1
        yield at, stop, word, upto - word

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first, count): 32-bit hashes of the shingles of all paragraphs; one, of all its
        words, where a paragraph has no more."""
        count = np.maximum(self.count - SHINGLE + 1, 1)
        first = np.cumsum(count) - count
        padded = np.r_[self.hashes, np.zeros(SHINGLE - 1, np.uint64)]
        n, value = len(self.hashes), np.zeros(len(self.hashes), np.uint64)
        for k in range(SHINGLE):
            value = value * np.uint64(_P) + padded[k : k + n]
        at = np.arange(int(count.sum())) - np.repeat(first - self.first, count)
        out = (_mixed(value[at] * _M1) >> np.uint64(32)).astype(np.uint32)
        few = self.count < SHINGLE
        out[first[few]] = (self.marks[few].view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        return out, first, count


def bands(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set of 32-bit hashes that starts at `first` in `value`."""
    keys = np.random.default_rng(11).integers(0, 1 << 32, (BANDS, ROWS, 2), dtype=np.uint32)
    out = np.empty((len(first), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(first), b + 1, dtype=np.uint64)
        for shift, factor in keys[b]:
            least = np.minimum.reduceat((value ^ shift) * (factor | np.uint32(1)), first) if len(first) else value
            key = _mixed(key * _M1 + least)
        out[:, b] = key
    return out.view(np.int64)


def paragraph_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, start, end, n_words, mark, shingles): every paragraph's place and the hash
    of its words; the hashes of its shingles where a task meets the mark for the first time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            ends = np.cumsum(b["text"].map(lambda t: len(t) if t else 0).to_numpy(dtype=np.int64))
            for _, own in b.groupby((ends - 1) // BATCH_CHARS):
                p = Paragraphs(own["text"])
                value, first, count = p.shingles()
                value = value.view(np.int32)
                sets: list[np.ndarray | None] = []
                for mark, lo, n in zip(p.marks.tolist(), first.tolist(), count.tolist(), strict=True):
                    sets.append(None if mark in seen else value[lo : lo + n])
                    seen.add(mark)
                if len(seen) > MEMORY:
                    seen.clear()
                places = {"paragraph": p.number, "start": p.start, "end": p.end, "n_words": p.count, "mark": p.marks}
                yield pd.DataFrame(
                    {"doc_id": own["doc_id"].to_numpy()[p.text], **places, "shingles": pd.Series(sets, dtype=object)}
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, paragraph int, start int, end int, n_words int, mark long, shingles array<int>"
    return texts.where("doc_id IS NOT NULL").mapInPandas(run, schema)


def band_rows(table: DataFrame, wanted: bytes | None = None) -> DataFrame:
    """(band, mark): the keys of the bands of each paragraph that has shingles; those in a filter, if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count = b["shingles"].map(len).to_numpy(dtype=np.int64)
            value = np.concatenate(b["shingles"].to_list()).astype(np.int32).view(np.uint32)
            keys = bands(value, np.cumsum(count) - count).reshape(-1)
            mark = np.repeat(b["mark"].to_numpy(), BANDS)
            kept = slice(None) if wanted is None else in_filter(keys, wanted)
            yield pd.DataFrame({"band": keys[kept], "mark": mark[kept]})

    return table.where("shingles IS NOT NULL").select("mark", "shingles").mapInPandas(run, "band long, mark long")


def bit_filter(values: DataFrame, column: str) -> bytes | None:
    """A bitmap with the bits of the column's values set, of a size that follows their number: FILTER_SHARE
    to twice as many bits each. None if it would have more than FILTER_MOST bits."""
    size = 1 << max(15, (FILTER_SHARE * values.count()).bit_length())
    if size > FILTER_MOST:
        return None
    bit = F.pmod(column, F.lit(size)) + 1  # position n + 1 is bit n % 32768 of bucket n / 32768 + 1
    parts = values.groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
    parts = parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros((size // 32768, 4096), dtype=np.uint8)
    for r in parts.collect():
        raw = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["bucket"] - 1, : len(raw)] = raw
    return out.tobytes()


def in_filter(values: np.ndarray, bits: bytes) -> np.ndarray:
    """Whether each value's bit is set; all that were put in pass, and few others."""
    at = values % (8 * len(bits))
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) of marks whose sets of shingles have a Jaccard score of THRESHOLD or more."""
    left, right = (sets.select(F.col("mark").alias(end), F.col("shingles").alias(f"{end}_set")) for end in ("src", "dst"))
    n, m = F.size("src_set"), F.size("dst_set")
    possible = F.least(n, m) >= F.greatest(n, m) * F.lit(THRESHOLD)
    both = F.size(F.array_intersect("src_set", "dst_set"))
    near = F.when(possible, both >= (n + m - both) * F.lit(THRESHOLD))
    return pairs.join(left, "src").join(right, "dst").where(near).select("src", "dst")


def near_paragraphs(table: DataFrame) -> DataFrame:
    """(src, dst): links between different paragraphs' marks with a Jaccard similarity of THRESHOLD or more.

    `table` is a stored paragraph_table; texts aren't read again. Equal paragraphs are one mark. Of
    each band key only the smallest and largest mark are shuffled, summed up before they leave a
    task, which tells the keys that different paragraphs share. The smallest mark of such a key is
    its hub, and all others are held against it: a star. Where a key's paragraphs are still of
    several components, these are held against each other as far as they meet on one of the rarest
    shingles that a pair of this similarity must share; so a key that very many paragraphs share
    gives no pairs of all of them. All scores are of whole sets.
    """
    rows = band_rows(table)
    shared = rows.groupBy("band").agg(F.min("mark").alias("hub"), F.max("mark").alias("last")).where("hub < last")
    shared = written(shared.select("band", "hub"), "bands")
    rows = band_rows(table, bit_filter(shared, "band"))
    met = written(rows.join(shared, "band").distinct(), "met")
    wanted = written(met.select("mark").distinct(), "wanted")
    sets = table.where("shingles IS NOT NULL").select("mark", "shingles").join(wanted, "mark", "left_semi")
    sets = written(sets.groupBy("mark").agg(F.array_distinct(F.first("shingles")).alias("shingles")), "sets")

    stars = met.where("mark <> hub").select(F.col("hub").alias("src"), F.col("mark").alias("dst")).distinct()
    links = written(_verified(stars, sets), "links")
    named = connected_components(links)
    rows = met.join(named, met["mark"] == named["node"], "left").select(
        "band", "mark", F.coalesce("component", "mark").alias("component")
    )
    several = rows.groupBy("band").agg(
        F.min("component").alias("one"), F.max("component").alias("other")
    ).where("one <> other")
    apart = rows.join(several.select("band"), "band", "left_semi").select("mark", "component").distinct()
    return links.unionAll(_verified(_meeting(sets.join(written(apart, "open"), "mark")), sets))


def _meeting(sets: DataFrame) -> DataFrame:
    """(src, dst): pairs of marks of different components that may have a similarity of THRESHOLD.

    All shingles are in one order, the rarest first. Sets of n and m shingles of that similarity
    share at least `both` of these, so they meet on one of the n - both + 1 first of the one and
    the m - both + 1 first of the other. Each offers these for every size that a near set may have,
    and sets meet by shingle and sizes. What no other set has comes first and meets nothing.
    """
    has = sets.select("mark", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = has.groupBy("shingle").agg(F.count("*").alias("on")).where("on > 1")
    held = has.join(common, "shingle")
    own = Window.partitionBy("mark")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("on", "shingle"))
    eps, share = 1e-9, F.lit(THRESHOLD)
    sizes = F.sequence(F.ceil(F.col("n") * share - eps).cast("int"), F.floor(F.col("n") / share + eps).cast("int"))
    both = F.ceil((F.col("n") + F.col("m")) * F.lit(THRESHOLD / (1 + THRESHOLD)) - eps)
    offered = held.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - eps) + 1)
    offered = offered.withColumn("m", F.explode(sizes)).where(F.col("place") <= F.col("n") - both + 1)
    offered = written(offered.select("shingle", "n", "m", "mark", "component"), "offered")
    left = offered.select("shingle", "n", "m", F.col("mark").alias("src"), F.col("component").alias("one"))
    right = offered.select(
        "shingle",
        F.col("m").alias("n"),
        F.col("n").alias("m"),
        F.col("mark").alias("dst"),
        F.col("component").alias("other"),
    )
    pairs = left.join(right, ["shingle", "n", "m"]).where((F.col("src") < F.col("dst")) & (F.col("one") != F.col("other")))
    return pairs.select("src", "dst").distinct()


def shared_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS
) -> DataFrame:
    """One row per paragraph of a passage that documents share: what to remove, and what stays.

    doc_id, paragraph, start, end (code points), n_words, passage (number of its first paragraph),
    component_id, first_doc (the smallest document with a paragraph of the component) and removed:
    whether it is not the component's first paragraph, by document and place.

    Paragraphs are linked if they are equal or similar by THRESHOLD on five-word shingles; components
    are what links reach. A component is shared if two documents have it, and a passage is a run of
    shared paragraphs of at least `run_words` words. Documents that share none give no row, nor do
    null and empty texts and rows without an id. Rows that repeat an id are one document, and its
    rows that also repeat the text count once. No rows give no rows. Only the two named columns are
    read. Texts are cut whole, however long they are.
    """
    table = written(paragraph_table(docs, id_col, text_col), "paragraphs")
    places = table.drop("shingles")
    groups = connected_components(near_paragraphs(table))
    spread = places.groupBy("mark").agg(F.min(F.struct("doc_id", "paragraph")).alias("first"), F.max("doc_id").alias("last"))
    # marks of several documents or with similar ones; a component is summed up from these alone
    spread = spread.join(
        groups, spread["mark"] == groups["node"], "left"
    ).where("first.doc_id <> last OR component IS NOT NULL")
    marks = written(spread.select("mark", F.coalesce("component", "mark").alias("component"), "first", "last"), "marks")
    common = marks.groupBy("component").agg(
        F.min("first").alias("first"), F.max("last").alias("last")
    ).where("first.doc_id <> last")
    common = marks.select("mark", "component").join(common.drop("last"), "component")
    common = common.select(F.col("mark").alias("common"), "component", "first")
    shared = places.join(common, F.col("mark") == F.col("common"))
    shared = shared.select("doc_id", "paragraph", "start", "end", "n_words", "component", "first")
    once = Window.partitionBy("doc_id", "paragraph").orderBy("start", "end", "component")
    shared = shared.withColumn("again", F.row_number().over(once)).where("again = 1")
    run = F.col("paragraph") - F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph"))
    whole = Window.partitionBy("doc_id", "run")
    runs = shared.withColumn("run", run)
    runs = runs.withColumns({"words": F.sum("n_words").over(whole), "passage": F.min("paragraph").over(whole)})
    ahead = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("paragraph") != F.col("first.paragraph"))
    return runs.where(F.col("words") >= run_words).select(
        "doc_id", "paragraph", "start", "end", "n_words", "passage",
        F.col("component").alias("component_id"), F.col("first.doc_id").alias("first_doc"), ahead.alias("removed"),
    )
