"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.storage import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest reachable node.

    Links may repeat, run either way or join a node with itself; links with a null end are no
    links. Each round hangs every node's larger neighbours under the smallest (large star), then
    a node's smaller ones too (small star), until the links stop changing: a logarithmic number
    of rounds, each two aggregations and two joins on the node. Links are made distinct while they
    are shuffled, and a hub's links are dealt over many tasks when the join finds them skewed.
    No link or label goes to the driver; it sees two numbers a round.
    """
    links = _star_table(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    links = written(links, "links")
    before = _digest(links)
    while before[0]:
        links = written(_small_star(_large_star(links)), "links")
        after = _digest(links)
        if after == before:
            break
        before = after
    # every node now hangs under its component's smallest node
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _star_table(pairs: DataFrame) -> DataFrame:
    """Distinct links with u the larger end."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(
        links.select(F.col("v").alias("n"), F.col("u").alias("m"))
    )
    least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
    return _star_table(both.where("m > n").join(least, "n").select(F.col("m").alias("a"), F.col("least").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    hung = links.join(least, "u")
    ends = hung.select(F.col("v").alias("a"), F.col("least").alias("b")).unionAll(
        least.select(F.col("u").alias("a"), F.col("least").alias("b"))
    )
    return _star_table(ends)


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
