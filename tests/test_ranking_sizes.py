"""Ideal rankings from counts of grades, and judgements counted without pairs."""

import math

import pytest
from pyspark.sql import functions as F

from auditweave.operators import ranking
from auditweave.plans import ranking as plans
from auditweave.plans.views import Views


def test_ideal_from_counts(spark):
    sizes = spark.createDataFrame([("a", 2, 2), ("a", 1, 5), ("a", 0, 9), ("b", 1, 1_000_000_000), ("c", 2, 0), ("d", 0, 3)], "query_id string, grade int, n long")
    got = {r["query_id"]: (r["relevant"], r["idcg"]) for r in ranking._ideal(sizes, 3).collect()}
    want = {"a": (7, 3 / math.log2(2) + 3 / math.log2(3) + 1 / math.log2(4)), "b": (1_000_000_000, sum(1 / math.log2(i + 1) for i in (1, 2, 3))), "d": (3 * 0, 0.0)}
    assert got == {q: (n, pytest.approx(x)) for q, (n, x) in want.items()}


def test_counts_of_judgements_equal_those_of_all_pairs(spark, sf_dir):
    v = Views(spark, sf_dir)
    own = v.query_vectors.select("query_id", (F.col("query_id") % 10).alias("label"))
    pairs = own.join(v.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("doc_id <> query_id")
    of = lambda df: sorted(tuple(r) for r in df.filter("n > 0").select("query_id", "grade", "n").collect())
    assert of(plans._sizes(v)) == of(ranking.grades(plans._graded(pairs)))


def test_draws_are_not_broadcast(spark):
    """They are as many as iterations times pairs, which the planner cannot know: it took them for the smaller side."""
    pairs = spark.range(300).select(F.col("id").alias("query_id"), (F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 5 / 5.0).alias("b"))
    joined = ranking.bootstrap_p(pairs.repartition(3), iterations=50)
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [place" in plan and "BroadcastHashJoin [place" not in plan
    diffs = [(i % 7) / 7.0 - (i % 5) / 5.0 for i in sorted(range(300), key=lambda i: ((i * 7919 + 7) % 2147483647 * 48271 + 11) % 2147483647)]
    mean, large = sum(diffs) / 300, 0
    for it in range(50):
        x = [(it * 7919 + i * 104729 + 7) % 2147483647 for i in range(300)]
        places = [((y * 48271 + 11) % 2147483647 * 48271 + 11) % 2147483647 % 300 for y in x]
        large += round(abs(sum(diffs[j] - mean for j in places) / 300), 9) >= round(abs(mean), 9)
    assert tuple(joined.first()) == (300, round(mean, 6), large / 50)


def test_draws_in_blocks(spark):
    seen = spark.range(1).select(F.lit(10).cast("long").alias("n"))
    of = lambda **more: sorted(tuple(r) for r in ranking.draws(spark, seen, 7, 6, **more).collect())
    assert len(of()) == 60 and of(block=3) == of(block=10) == of(block=1) == of()
