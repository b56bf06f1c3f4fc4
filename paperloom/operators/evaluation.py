"""Test sets, cached answers and the figures of evaluation runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import is_blank, stripped
from paperloom.operators.quantiles import exact_quantiles
from paperloom.sources.scratch import written

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
CACHE_VERSION = 2


def testset_rows(sets: DataFrame) -> DataFrame:
    """(set_id, q_no, question, reference, skipped) of parallel arrays; the first reference counts.

    A set whose arrays differ in length is an error. Blank references are marked as skipped.
    """
    same = F.size("questions") == F.size("ground_truths")
    checked = F.when(same, F.arrays_zip("questions", "ground_truths")).otherwise(
        F.raise_error(F.lit("questions and ground truths differ in number"))
    )
    rows = sets.select("set_id", F.posexplode(checked).alias("q_no", "r"))
    reference = F.get(F.col("r.ground_truths"), F.lit(0))
    return rows.select(
        "set_id",
        "q_no",
        F.col("r.questions").alias("question"),
        reference.alias("reference"),
        is_blank(reference).alias("skipped"),
    )


def eval_cache_join(samples: DataFrame, cache: DataFrame, fingerprint: str, version: int = CACHE_VERSION) -> DataFrame:
    """Samples with response, contexts and `hit`: a stored answer of this version and fingerprint that
    isn't blank and has contexts; the others are to be answered anew.

    A question has one entry, the newest by stored_at, if the cache has that column; of several
    of one time, and where there is no such column, the largest response stands.
    """
    good = (F.col("version") == version) & (
        F.col("fingerprint") == fingerprint
    ) & ~is_blank(F.col("response")) & (F.size("contexts") > 0)
    when = F.col("stored_at") if "stored_at" in cache.columns else F.lit(None).cast("timestamp")
    newest = F.max_by(F.struct("response", "contexts"), F.struct(when.alias("at"), "response", "contexts"))
    stored = cache.where(good).groupBy("question").agg(newest.alias("entry")).select("question", "entry.*")
    return samples.join(stored, "question", "left").withColumn("hit", F.col("response").isNotNull())


def corpus_manifest(chunks: DataFrame, config: dict[str, object]) -> DataFrame:
    """One row: chunk_count, max_upload_time, pk_digest and the fingerprint of these with a configuration.

    The keys' digest is of two sums, over 60 bits each of every key's SHA-256; so order and
    partitions don't matter, and each task sends one row, however many keys there are.
    """
    digest = F.sha2(F.col("pk").cast("string"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    row = chunks.agg(
        F.count("*").alias("chunk_count"), F.max("upload_time").alias("max_upload_time"),
        *(F.coalesce(F.sum(part(at)), F.lit(0)).cast("string").alias(name) for name, at in (("one", 1), ("two", 16))),
    )
    row = row.select("chunk_count", "max_upload_time", F.sha2(F.concat_ws(",", "one", "two"), 256).alias("pk_digest"))
    latest = F.coalesce(F.col("max_upload_time").cast("string"), F.lit(""))
    settings = F.lit(json.dumps(config, sort_keys=True, ensure_ascii=False))
    canonical = F.concat_ws("\n", settings, F.col("chunk_count").cast("string"), latest, "pk_digest")
    return row.withColumn("fingerprint", F.sha2(canonical, 256))


def stacked(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(metric, value): a row for each number of the columns, NaN as null."""
    pairs = F.array(
        *(
            F.struct(
                F.lit(c).alias("metric"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")
            ) for c in columns
        )
    )
    return rows.select(F.inline(pairs))


def run_metrics(
    runs: DataFrame, columns: tuple[str, ...] = ("retrieval_s", "generation_s", "context_chars", "source_count")
) -> DataFrame:
    """(metric, mean, p50, p95) of the columns, nulls left out, rounded to 4 digits."""
    rows = stacked(runs, columns)
    figures = rows.groupBy("metric").agg(F.avg("value").alias("mean"))
    figures = figures.join(exact_quantiles(rows, (0.5, 0.95)), "metric", "left")
    quantile = lambda i: F.get("quantiles", F.lit(i))
    named = (("mean", F.col("mean")), ("p50", quantile(0)), ("p95", quantile(1)))
    return figures.select("metric", *(F.round(x, 4).alias(n) for n, x in named))


def metric_nan_counts(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, n_nan): how many scores are missing or not a number."""
    return stacked(scores, metrics).groupBy("metric").agg(F.count_if(F.col("value").isNull()).alias("n_nan"))


def nan_policy(scores: DataFrame, policy: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Scores as they are (keep), without rows that lack one (drop), or with 0 in its place (zero)."""
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    if policy == "keep":
        return scores
    if policy == "drop":
        any_missing = F.lit(False)
        for c in metrics:
            any_missing = any_missing | missing(c)
        return scores.where(~any_missing)
    if policy == "zero":
        return scores.withColumns({c: F.when(missing(c), 0.0).otherwise(F.col(c)) for c in metrics})
    raise ValueError(f"no such policy: {policy}")


def metric_summary(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, mean, min, p25, p50, p75, max) without NaN, rounded to 4 digits; `overall` is the mean of means."""
    rows = stacked(scores, metrics)
    figures = ("mean", "min", "p25", "p50", "p75", "max")
    value = F.col("value")
    each = rows.groupBy("metric").agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    each = each.join(exact_quantiles(rows, (0.25, 0.5, 0.75)), "metric", "left")
    quantiles = {n: F.get("quantiles", F.lit(i)) for i, n in enumerate(("p25", "p50", "p75"))}
    each = each.select("metric", *(quantiles.get(n, F.col(n)).alias(n) for n in figures))
    nothing = F.lit(None).cast("double")
    overall = each.agg(F.avg("mean").alias("mean")).select(
        F.lit("overall").alias("metric"), "mean", *(nothing.alias(n) for n in figures if n != "mean")
    )
    return each.unionByName(overall).select("metric", *(F.round(n, 4).alias(n) for n in figures))


def metric_details(scores: DataFrame, metrics: tuple[str, ...] = METRICS, longest: int = 50) -> DataFrame:
    """(q_no, question, metrics): questions cut with an ellipsis, scores rounded, NaN as null."""
    short = F.when(
        F.length("question") > longest, F.concat(F.substring("question", 1, longest), F.lit("…"))
    ).otherwise(F.col("question"))
    return scores.select(
        "q_no",
        short.alias("question"),
        *(F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), 4).alias(c) for c in metrics),
    )


def context_metrics(verdicts: DataFrame, statements: DataFrame) -> DataFrame:
    """(q_no, context_precision, context_recall) of judged contexts (q_no, rank, relevant 0/1) and
    statements (q_no, covered 0/1): the mean precision at the relevant ranks, and the share covered."""
    upto = Window.partitionBy("q_no").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = verdicts.withColumn("at", F.sum("relevant").over(upto) / F.count("*").over(upto))
    precision = at.groupBy("q_no").agg(
        F.coalesce(
            F.try_divide(F.sum(F.col("at") * F.col("relevant")), F.sum("relevant").cast("double")), F.lit(0.0)
        ).alias("context_precision")
    )
    recall = statements.groupBy("q_no").agg(F.avg(F.col("covered").cast("double")).alias("context_recall"))
    return precision.join(recall, "q_no", "full").select(
        "q_no",
        F.round("context_precision", 6).alias("context_precision"),
        F.round("context_recall", 6).alias("context_recall"),
    )


def sample_chunks(chunks: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """At most n chunks that aren't blank, the same ones for the same seed, whatever the partitions."""
    place: Column = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("pk").cast("string")))
    return chunks.where(~is_blank(stripped(F.coalesce("text", F.lit(""))))).orderBy(place, "pk").limit(n)


def overlap_classes(chunks: DataFrame, threshold: float = 0.01, most: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """((left, right, score), (pk, class)): which sets of entities have a Jaccard score of `threshold` or more, and
    which chunks (pk, entities) have them.

    Chunks with the same entities are one class, named by its smallest pk; pairs are of different classes, and
    chunks without entities have none. Null entities don't count. Scores aren't rounded.

    Sets meet on an entity, with the rarest first: of n entities, a set offers the n - ceil(threshold * n) + 1 rarest,
    one of which a pair that reaches the threshold must share. Of the sets that meet, those whose sizes, or whose
    places of that entity, leave no room for enough common ones aren't paired. The sets of an entity are dealt over
    parts of about `most`, and each pair of parts is a task's own, so an entity that very many have gives many
    tasks of that size. No pair is lost.
    """
    t = F.lit(float(threshold))
    sets = chunks.select("pk", F.array_sort(F.array_distinct(F.array_compact("entities"))).alias("entities"))
    sets = sets.where(F.size("entities") > 0)
    classes = sets.groupBy("entities").agg(F.min("pk").alias("class"))
    classes = written(classes.select("class", "entities", F.size("entities").alias("n")), "classes")
    # as a digest, entities are compared by 32 bytes whatever their number
    digest = F.sha2(F.to_json("entities"), 256)
    members = sets.select("pk", digest.alias("d")).join(classes.select(digest.alias("d"), "class"), "d").select("pk", "class")

    has = classes.select("class", "n", F.explode("entities").alias("entity"))
    common = has.groupBy("entity").agg(F.count("*").alias("on")).where("on > 1")
    ranked = has.join(common, "entity")
    own = Window.partitionBy("class")
    # entities that no other set has come first and count towards the prefix
    place = F.row_number().over(own.orderBy("on", "entity")) + F.col("n") - F.count("*").over(own)
    offered = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1)
    offered = written(offered.select("entity", "class", "n", "place"), "offered")
    parts = offered.groupBy("entity").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = offered.join(parts, "entity").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))

    def side(name: str, other: Column) -> DataFrame:
        cells = dealt.withColumn("other", F.explode(other))
        lower, upper = ("part", "other") if name == "left" else ("other", "part")
        return cells.select("entity", F.col(lower).alias("i"), F.col(upper).alias("j"), *(F.col(c).alias(f"{name}_{c}") for c in ("class", "n", "place")))

    left = side("left", F.sequence(F.col("part"), F.col("parts") - 1))
    right = side("right", F.sequence(F.lit(0), F.col("part")))
    n, m = F.col("left_n"), F.col("right_n")
    # at the first entity that a pair shares, all that it shares is from there on
    room = F.least(n - F.col("left_place"), m - F.col("right_place")) + 1
    fits = (F.least(n, m) >= t * F.greatest(n, m) - 1e-9) & (room >= t / (1 + t) * (n + m) - 1e-9)
    once = (F.col("i") < F.col("j")) | (F.col("left_class") < F.col("right_class"))
    pairs = left.join(right, ["entity", "i", "j"]).where(once & (F.col("left_class") != F.col("right_class")) & fits)
    pairs = pairs.select(
        F.least("left_class", "right_class").alias("left"), F.greatest("left_class", "right_class").alias("right")
    ).distinct()
    named = lambda s: classes.select(F.col("class").alias(s), F.col("entities").alias(f"{s}_set"))
    both = pairs.join(named("left"), "left").join(named("right"), "right")
    shared = F.size(F.array_intersect("left_set", "right_set"))
    score = shared / (F.size("left_set") + F.size("right_set") - shared)
    return both.select("left", "right", score.alias("score")).where(F.col("score") >= threshold), members


def overlap_edges(chunks: DataFrame, threshold: float = 0.01, most: int = 2_000) -> DataFrame:
    """(left_pk, right_pk, score): all pairs of chunks (pk, entities) with a Jaccard score of `threshold` or more.

    Entities are compared once for all chunks that have the same ones (`overlap_classes`, which to take where such
    groups are large: here each pair of their chunks is a row). Large groups are dealt as entities are.
    """
    pairs, members = overlap_classes(chunks, threshold, most)
    members = written(members, "members")
    same = members.select(F.col("class").alias("left"), F.col("class").alias("right"), F.lit(1.0).alias("score")).distinct()
    # parts of a class, so that neither side of a large one is a single task's
    parts = members.groupBy("class").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = members.join(parts, "class").withColumn("part", F.pmod(F.xxhash64("pk"), F.col("parts")).cast("int"))
    sizes = lambda s: parts.select(F.col("class").alias(s), F.col("parts").alias(f"{s}_parts"))
    cells = pairs.unionAll(same).join(sizes("left"), "left").join(sizes("right"), "right")
    for s in ("left", "right"):
        cells = cells.withColumn(f"{s}_part", F.explode(F.sequence(F.lit(0), F.col(f"{s}_parts") - 1)))
    for s in ("left", "right"):
        cells = cells.join(dealt.select(F.col("class").alias(s), F.col("part").alias(f"{s}_part"), F.col("pk").alias(f"{s}_pk")), [s, f"{s}_part"])
    kept = cells.where((F.col("left") != F.col("right")) | (F.col("left_pk") < F.col("right_pk")))
    return kept.select(
        F.least("left_pk", "right_pk").alias("left_pk"), F.greatest("left_pk", "right_pk").alias("right_pk"), F.round("score", 6).alias("score")
    )
