"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
#: Documents whose running sums one task works out.
SHARE_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """(source, source_size, target): the budget shared by weight, no source above its size times epochs.

    Sources take the weights in turn, by code point, null last. A source whose share is above its
    limit gets the limit, and what is left is shared by weight among the others. Sources in order
    of limit over weight are limited up to some place, and the first that isn't gives the rate.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    s = s.withColumns(
        {
            "limit": F.col("source_size") * epochs,
            "all_words": F.sum("source_size").over(whole),
            "all_weights": F.sum("weight").over(whole),
        }
    )
    earlier = Window.orderBy(
        F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    spent, weighed = F.coalesce(F.sum("limit").over(earlier), F.lit(0)), F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    s = s.withColumn("rate", (F.col("all_words") * F.lit(float(budget)) - spent) / (F.col("all_weights") - weighed))
    s = s.withColumn("rate", F.max(F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.col("rate"))).over(whole))
    return s.select(
        "source", "source_size", F.least(F.col("limit").cast("double"), F.col("rate") * F.col("weight")).alias("target")
    )


def fair_queue(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, source, start, first and second.

    All documents of a source are shuffled: they queue by their ids' MD5, twice over. start is the source's words
    ahead of a document, first and second are the virtual times at which its two entries finish: the source's words
    up to and with it, over the source's target. As targets add up to the budget, all sources' queues served in the
    order of these times have used the budget up at time 1.

    Running sums are made of the sums of shares of a source's queue and sums within a share, so a source
    that holds most rows is dealt over many tasks; equal rows are one in them. The driver sees the
    number of documents.
    """
    doc_id = F.col(id_col).cast("long")
    place = F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), F.md5(F.col(text_col).cast("string"))), F.lit("")))
    sizes = docs.select(
        doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), place.alias("place")
    )
    sizes = written(sizes, "sizes")
    shares = max(64, sizes.count() // SHARE_ROWS)
    targets = source_targets(sizes, weights, budget).withColumnRenamed("source", "name")
    rows = sizes.groupBy("source", "place", "doc_id", "size").agg(F.count("*").alias("times"))
    queue = rows.join(targets, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    share = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * shares / F.lit(1 << 32)).cast("int")
    queue = queue.withColumn("share", share).withColumn("words", F.col("size") * F.col("times"))

    before = Window.partitionBy("source").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = queue.groupBy("source", "share").agg(F.sum("words").alias("words"))
    starts = starts.select(
        F.col("source").alias("of"),
        F.col("share").alias("part"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"),
    )
    within = Window.partitionBy("source", "share").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    own = queue.withColumn("within", F.sum("words").over(within))
    own = own.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("share") == F.col("part")))
    each = own.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    start = F.col("before") + F.col("within") - F.col("words") + F.col("nth") * F.col("size")
    each = each.withColumn("start", start)
    finish = lambda w: F.try_divide(w.cast("double"), F.col("target"))  # noqa: E731  no target: never
    upto = F.col("start") + F.col("size")
    return each.select(
        "doc_id", "size", "source_size", "target", "source", "start", finish(upto).alias("first"), finish(upto + F.col("source_size")).alias("second")
    )


def mixed_sizes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, first, second, taken, source.

    All documents are queued by source (`fair_queue`) and the mix is cut where the budget is used up, at the
    queue's virtual time 1: entries that finish by then are taken whole, and one that is in service gives the
    words served by then. So every source's words are its target but for less than one word, however
    long its documents are, and never more. first and second, the times at which a document's entries finish, are the
    order of the mix over all sources; a source without a word has none. The same rows always give the same mix.

    Null texts have no words and take none, nor do empty ones; very long ones are counted whole and queue like
    any other. Null sources are one source, null ids queue by the MD5 of their texts. Repeated rows
    queue one after the other. No rows give no rows. Only the three named columns are read, whatever
    else there is.
    """
    queue = fair_queue(docs, id_col, text_col, source_col, weights, budget)
    served = F.floor("target")

    # by time 1 a source has served its target; what of that lies behind an entry's start is the entry's
    by_then = lambda start: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), served - start))
    both = by_then(F.col("start")) + by_then(F.col("start") + F.col("source_size"))
    return queue.select("doc_id", "size", "source_size", "target", "first", "second", both.alias("taken"), "source")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, each as often as it takes them whole, with all their own columns.

    Documents without a word (null and empty texts among them) are never taken: the mix is of
    words. One that is taken in part, of which each source has one at most, isn't taken for that part. Rows that repeat id, size and source are each taken as often as the one of them that is
    taken least, so that the budget holds. Null ids are matched like any others, columns of any
    other name are kept, and no rows give no rows.
    """
    mix = mixed_sizes(docs, id_col, text_col, source_col)
    copies = mix.where("size > 0").select(
        F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size"), F.col("source").alias("mix_source"),
        (F.col("taken") / F.col("size")).cast("int").alias("mix_copies"),
    )
    copies = copies.groupBy("mix_id", "mix_size", "mix_source").agg(
        F.min("mix_copies").alias("mix_copies")
    ).where("mix_copies > 0")
    rows = docs.select(
        F.struct("*").alias("mix_row"), F.col(id_col).cast("long").alias("own_id"),
        word_count(F.col(text_col)).alias("own_size"), F.col(source_col).cast("string").alias("own_source"),
    )
    same = F.col("own_id").eqNullSafe(F.col("mix_id")) & (F.col("own_size") == F.col("mix_size"))
    same &= F.col("own_source").eqNullSafe(F.col("mix_source"))
    taken = rows.join(copies, same).select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    return taken.select("mix_row.*")
