"""Exact quantiles by narrowing to the ranks that are asked for."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.sources.scratch import written

#: Values of a range that are sorted in one task, and cells that a larger range is parted into.
SORTED, CELLS = 100_000, 64


@dataclass(frozen=True)
class Range:
    """Values of a metric from `low` up to but without `high`, `inside` in number, with `below` under them; the ranks sought there."""

    metric: str
    low: float | None
    high: float | None
    below: int
    inside: int
    ranks: tuple[int, ...]


def _within(rows: DataFrame, ranges: list[Range], splits: list[list[float]] | None = None) -> DataFrame:
    """The rows of each range, by the range's number; ranges are a few for each metric."""
    given = [(i, r.metric, r.low, r.high, splits[i] if splits else []) for i, r in enumerate(ranges)]
    schema = "id int, metric string, low double, high double, splits array<double>"
    held = F.broadcast(rows.sparkSession.createDataFrame(given, schema))
    value = F.col("value")
    above, under = F.col("low").isNull() | (value >= F.col("low")), F.col("high").isNull() | (value < F.col("high"))
    return rows.join(held, "metric").where(above & under)


def _narrowed(rows: DataFrame, ranges: list[Range], cells: int) -> list[Range]:
    """The cells of ranges that ranks are in. Cells are parted at approximate quantiles and counted exactly."""
    at = [F.lit(i / cells) for i in range(1, cells)]
    cuts = F.percentile_approx("value", F.array(*at), F.lit(16 * cells))
    found = {r["id"]: r["cuts"] for r in _within(rows, ranges).groupBy("id").agg(cuts.alias("cuts")).collect()}
    splits = [sorted(set(found[i])) for i in range(len(ranges))]
    cell = F.size(F.filter("splits", lambda s: s <= F.col("value")))
    counted = _within(rows, ranges, splits).groupBy("id", cell.alias("cell")).count().collect()  # at most `cells` a range
    out = []
    for i, r in enumerate(ranges):
        below = r.below
        for c, n in sorted((x["cell"], x["count"]) for x in counted if x["id"] == i):
            own = tuple(k for k in r.ranks if below <= k < below + n)
            if own:
                low, high = (splits[i][c - 1] if c else r.low), (splits[i][c] if c < len(splits[i]) else r.high)
                out.append(Range(r.metric, low, high, below, n, own))
            below += n
    return out


def exact_quantiles(rows: DataFrame, at: tuple[float, ...], most: int = SORTED, cells: int = CELLS) -> DataFrame:
    """(metric, quantiles): the quantiles of each metric's values, interpolated between neighbours, nulls left out.

    Rows have metric and value, metrics are few. A quantile needs the values of one or two ranks. A range that
    a rank is in and that has too many values is parted into cells, whose counts, summed up before they are
    shuffled, tell in which cell the rank is; that goes on until few values are left, or one value
    makes up most of them. Then equal values are summed up and the rest sorted. So a task sees no more than
    `most` distinct values or so of a metric, and the driver the counts of cells.
    """
    held = written(rows.where("value IS NOT NULL").select("metric", "value"), "values")
    totals = {r["metric"]: r["count"] for r in held.groupBy("metric").count().collect()}
    places = {m: [p * (n - 1) for p in at] for m, n in totals.items()}
    ranks = {m: tuple(sorted({k for x in xs for k in (math.floor(x), math.ceil(x))})) for m, xs in places.items()}
    todo, done = [Range(m, None, None, 0, n, ranks[m]) for m, n in totals.items()], []
    while todo:
        done += [r for r in todo if r.inside <= most]
        large = [r for r in todo if r.inside > most]
        todo = _narrowed(held, large, cells) if large else []
        # where a cell has most of its range, it is one value and few others
        least = {k: r.inside / 2 for r in large for k in ((r.metric, x) for x in r.ranks)}
        stuck = [r for r in todo if r.inside > least[r.metric, r.ranks[0]]]
        done, todo = done + stuck, [r for r in todo if r not in stuck]
    values = _ranked(held, done) if done else {}
    out = []
    for m, xs in places.items():
        pairs = [(values[m, math.floor(x)], values[m, math.ceil(x)], x - math.floor(x)) for x in xs]
        out.append((m, [float((1 - part) * a + part * b if a != b else a) for a, b, part in pairs]))
    return held.sparkSession.createDataFrame(out, "metric string, quantiles array<double>")


def _ranked(rows: DataFrame, ranges: list[Range]) -> dict[tuple[str, int], float]:
    """The value of each rank of the ranges."""
    each = _within(rows, ranges).groupBy("id", "value").count()
    upto = F.expr("sum(count) OVER (PARTITION BY id ORDER BY value)")
    asked = [(i, r.metric, k, k - r.below) for i, r in enumerate(ranges) for k in r.ranks]
    sought = rows.sparkSession.createDataFrame(asked, "id int, metric string, rank long, place long")
    found = each.withColumn("upto", upto).join(F.broadcast(sought), "id")
    found = found.where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("count")))
    return {(r["metric"], r["rank"]): r["value"] for r in found.select("metric", "rank", "value").collect()}
