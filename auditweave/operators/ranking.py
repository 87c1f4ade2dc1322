"""Retrieval quality over rankings (query_id, mode, rank, doc_id, level) and judgements (query_id, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import numbered, share
from .execution import ranked


def _judged(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return rankings.filter(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def grades(qrels: DataFrame) -> DataFrame:
    """query_id, grade, n: how many documents of each grade a query has, which is all that its ideal ranking needs."""
    return qrels.groupBy("query_id", "grade").agg(F.count("*").alias("n"))


def _ideal(sizes: DataFrame, k: int) -> DataFrame:
    """relevant and idcg at k of each query: the grades in falling order, each at the places that it fills."""
    last = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    filled = sizes.filter("n > 0").withColumn("_to", F.least(last, F.lit(k))).withColumn("_from", last - F.col("n") + 1)
    places = F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to")).otherwise(F.array().cast("array<bigint>"))  # k at most
    gain = F.pow(2.0, F.col("grade")) - 1
    summed = F.aggregate(places, F.lit(0.0), lambda s, rank: s + gain / F.log2(rank + 1.0))
    return filled.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("grade") > 0, F.col("n"))), F.lit(0)).alias("relevant"), F.sum(summed).alias("idcg"))


def per_query(rankings: DataFrame, qrels: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """recall, precision, reciprocal rank, hit and nDCG at k of each query and mode, in one pass over the rankings.

    With `sizes` (as `grades` gives them) only judgements of ranked documents need be in `qrels`.
    """
    gain, discount = F.pow(2.0, F.col("grade")) - 1, F.log2(F.col("rank") + 1.0)
    good = F.col("grade") > 0
    got = _judged(rankings, qrels, k).groupBy("query_id", "mode").agg(
        F.count_if(good).alias("found"), F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(gain / discount).alias("dcg")
    )
    ideal = _ideal(grades(qrels) if sizes is None else sizes, k)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return got.join(ideal, "query_id", "left").select(
        "query_id", "mode", zero(share(F.col("found"), F.col("relevant"))).alias("recall"), (F.col("found") / k if k else F.lit(0.0)).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"), F.col("first").isNotNull().cast("double").alias("hit"), F.round(zero(F.try_divide("dcg", "idcg")), 6).alias("ndcg"),
    )


def overlap(rankings: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Jaccard of two modes' first k documents of each query; 1 where both are empty."""
    rows = rankings.filter((F.col("rank") <= k) & F.col("mode").isin(a, b)).groupBy("query_id", "doc_id").agg(F.bool_or(F.col("mode") == a).alias("in_a"), F.bool_or(F.col("mode") == b).alias("in_b"))
    both = F.count_if(F.col("in_a") & F.col("in_b"))
    return rows.groupBy("query_id").agg(F.coalesce(share(both, F.count("*")), F.lit(1.0)).alias("overlap"))


def overlap_table(rankings: DataFrame, pairs: list[tuple[str, str]], k: int) -> DataFrame:
    """One column for each pair of modes."""
    out = rankings.select("query_id").distinct()
    for a, b in pairs:
        out = out.join(overlap(rankings, a, b, k).withColumnRenamed("overlap", f"{a}_{b}"), "query_id", "left")
    return out.select("query_id", *[F.coalesce(f"{a}_{b}", F.lit(1.0)).alias(f"{a}_{b}") for a, b in pairs])


def summary_ratio(rankings: DataFrame) -> DataFrame:
    return rankings.groupBy("mode").agg(F.round(F.avg((F.col("level") > 0).cast("double")), 6).alias("summary_ratio"))


def draw(seed: int, iteration: Column, i: Column, n: Column) -> Column:
    """A place below n, by two steps of a linear congruential generator: the same in any SQL engine."""
    x = (iteration * 7919 + i * 104729 + seed) % 2147483647
    for _ in range(2):
        x = (x * 48271 + 11) % 2147483647
    return x % n


def draws(spark: SparkSession, seen: DataFrame, seed: int, iterations: int, block: int = 4096) -> DataFrame:
    """iteration and place: as many places of the pairs for each iteration as there are pairs (`n` of the one row `seen`), in blocks of numbers."""
    n = F.col("n")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(block).cast("long")))
    blocks = spark.range(iterations).withColumnRenamed("id", "iteration").crossJoin(F.broadcast(seen.select("n"))).withColumn("start", F.explode(starts))
    rows = blocks.withColumn("i", F.explode(F.sequence("start", F.least(F.col("start") + block, n) - 1)))
    return rows.select("iteration", draw(seed, F.col("iteration"), F.col("i"), n).alias("place"))


def bootstrap_p(pairs: DataFrame, seed: int = 7, iterations: int = 10_000) -> DataFrame:
    """Share of resampled mean differences (centred) that are as large as the one observed; 1 of no pairs. pairs: query_id, a, b.

    A pair with one side missing means that the two runs did not answer the same queries, and is an error.
    """
    whole = F.assert_true(F.col("a").isNull() == F.col("b").isNull(), F.lit("paired scores must have equal length"))
    pairs = pairs.withColumn("_checked", whole).filter("_checked is null and a is not null").drop("_checked")
    diffs = numbered(pairs.select("query_id", (F.col("a") - F.col("b")).alias("d")), "query_id", seed, "place").select("place", "d")
    seen = diffs.agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    centred = diffs.crossJoin(F.broadcast(seen)).select("place", (F.col("d") - F.col("mean")).alias("d"))  # one row
    # The hint keeps the draws, as many as iterations times pairs, from being taken for small, gathered by the driver and broadcast.
    drawn = draws(pairs.sparkSession, seen, seed, iterations).join(centred.hint("shuffle_hash"), "place")
    means = drawn.groupBy("iteration").agg(F.avg("d").alias("m"))
    large = means.crossJoin(F.broadcast(seen)).agg(F.count_if(F.round(F.abs("m"), 9) >= F.round(F.abs("mean"), 9)).alias("large"), F.count("*").alias("of"))
    return seen.crossJoin(F.broadcast(large)).select("n", F.round("mean", 6).alias("mean"), F.coalesce(share(F.col("large"), F.col("of")), F.lit(1.0)).alias("p_value"))


def paired(scores: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """query_id, a and b: the value of each query in two modes; null where a mode lacks the query."""
    of = lambda mode, name: scores.filter(F.col("mode") == mode).select("query_id", F.col(value).alias(name))
    return of(a, "a").join(of(b, "b"), "query_id", "full")


def report(scores: DataFrame, metrics: list[str], modes: tuple[str, str]) -> DataFrame:
    """One row a metric: the mean of each mode and their difference."""
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    long = scores.selectExpr("mode", f"stack({len(metrics)}, {pairs}) AS (metric, value)")
    wide = long.groupBy("metric").pivot("mode", list(modes)).agg(F.round(F.avg("value"), 4))
    return wide.withColumn("delta", F.round(F.col(modes[0]) - F.col(modes[1]), 4))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p95 and p99 as exact ranks (n div 2, int(.95 n), int(.99 n), from 0) and the mean."""
    at = lambda f: F.max(F.when(F.col("place") == F.floor(F.col("n") * f).cast("int") + 1, F.col(value)))
    return ranked(rows, value, by).groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.round(F.avg(value), 3).alias("mean"))


def ship(criteria: DataFrame) -> DataFrame:
    """Whether all criteria (name, value, least) are met."""
    ok = F.col("value") >= F.col("least")
    return criteria.agg(F.bool_and(ok).alias("ship"), F.count_if(ok).alias("met"), F.count("*").alias("criteria"))
