"""Scores of steps that share texts equal those of their pairs."""

from pyspark.sql import functions as F

from auditweave.operators import retrieval
from auditweave.plans import retrieval as plans
from auditweave.plans.views import Views

ROWS = ["response_id", "step_index", "chunk_id"]


def of(df):
    return sorted(tuple(r) for r in df.select(*ROWS, "score").collect())


def test_shared_texts_score_as_pairs_do(spark):
    steps = spark.createDataFrame([("t", "Turn the valve"), ("u", 'See <cite page="3">'), ("none", "a b")], "text_id string, step_text string")
    chunks = spark.createDataFrame([("a", "the valve leaks", 12, "valve"), ("b", "", 3, None), ("c", None, None, "turn")], "chunk_id string, chunk_text string, page int, header string")
    keys = [(r, s, c, t, tags) for r, (t, tags) in enumerate([("t", '<cite page="012, 4">'), ("t", ""), ("u", '<cite page="12">'), ("none", ""), ("lost", "")]) for s in (0, 1) for c in ("a", "b", "c", "lost")]
    pairs = spark.createDataFrame(keys, "response_id int, step_index int, chunk_id string, text_id string, tags string")
    captions = F.when(F.col("page") == 12, F.array("header", F.lit(None).cast("string"), F.lit("turn it")))
    got = {tuple(r[c] for c in ROWS): r["score"] for r in retrieval.shared_lexical_scores(pairs, steps, chunks, captions).collect()}
    assert len(got) == 4 * 2 * 3
    assert got[0, 0, "a"] == round(0.55 * 2 / 4 + 0.25 + 0.2 * 1 / 3, 6) and got[1, 0, "a"] == round(0.55 * 2 / 4 + 0.2 * 1 / 3, 6)
    assert got[2, 1, "b"] == 0.25 and got[2, 1, "a"] == 0.25 and got[2, 0, "c"] == 0.0 and got[3, 0, "a"] == 0.0


def test_the_query_scores_as_pairs_do(spark, sf_dir):
    v = Views(spark, sf_dir)
    assert of(plans._lexical(v)) == of(retrieval.lexical_scores(plans._pairs(v)))


def test_a_step_with_a_low_score_keeps_its_chunk(spark, sf_dir):
    v = Views(spark, sf_dir)
    best = plans._lexical(v).groupBy("response_id", "step_index").agg(F.max("score").alias("s"))
    got = dict((name, plan) for name, plan, _ in plans.PLANS)["rt28_assign"](v)
    assert got.filter("score <= 0.1").count() == best.filter("s > 0.02 and s <= 0.1").count() > 0
