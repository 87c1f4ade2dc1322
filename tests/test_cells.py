"""Search by cells against brute force: clustered rows, ties, tags, conditions, floors, inner products, odd vectors, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave.operators import cells
from auditweave.operators import retrieval as rt

DIM = 8


def clustered(n, groups, seed=3):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, DIM))
    return (heads[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, DIM))).astype(float)


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), i % 3, f"t{i % 5}") for i, v in enumerate(vectors)], "id long, vector array<double>, level int, tag string")


def brute(vectors, queries, k, ok=lambda q, i: True, inner=False, digits=None, floor=-np.inf):
    out = set()
    for n, q in enumerate(queries):
        score = vectors @ q / np.linalg.norm(q)
        score = score if inner else score / np.linalg.norm(vectors, axis=1)
        score = np.round(score, digits or 9)
        best = sorted((-s, i) for i, s in enumerate(score) if ok(n, i) and s >= floor)[:k]
        out |= {(n, i, place) for place, (_, i) in enumerate(best, 1)}
    return out


def rows(found):
    return {(r["query_id"], r["id"], r["place"]) for r in found.collect()}


@pytest.fixture(scope="module")
def data(spark):
    vectors = clustered(1500, 25)
    vectors[700:720] = vectors[3]  # copies: ties go to the smaller id
    queries = np.vstack([vectors[[3, 50, 999]] + 0.01, -vectors[:2], clustered(12, 4, 9)])
    asked = spark.createDataFrame([(i, q.tolist(), [f"t{i % 5}", "t0"]) for i, q in enumerate(queries)], "query_id long, query_vector array<double>, tags array<string>")
    return vectors, queries, frame(spark, vectors), asked


def test_equal_to_all_pairs_and_reads_little(data):
    vectors, queries, table, asked = data
    index = cells.build(table, DIM, ["level"], ring_rows=20)
    assert len(index.centres) > 10 and index.rings["n"].sum() == len(vectors)
    found, work = cells.search(index, asked.drop("tags"), 10)
    assert rows(found) == brute(vectors, queries, 10)
    compared = {r["query_id"]: r["n_compared"] / r["n_rows"] for r in work.collect()}
    assert len(compared) == len(queries) and np.mean([compared[i] for i in (0, 1, 2)]) < 0.2


def test_condition_tags_floor_and_places(data):
    vectors, queries, table, asked = data
    index = cells.build(table, DIM, ["level"], tag="tag", ring_rows=20)
    found, _ = cells.search(index, asked, 7, where="level = 1", floor=0.8, digits=3)
    assert rows(found) == brute(vectors, queries, 7, lambda q, i: i % 3 == 1 and i % 5 in (0, q % 5), digits=3, floor=0.8)
    none, _ = cells.search(index, asked, 7, where="level = 9")
    assert none.count() == 0


def test_blocks_and_chunks_of_queries(data, monkeypatch):
    """Small blocks and few queries at once: the same rows, once each."""
    vectors, queries, table, asked = data
    monkeypatch.setattr(cells, "BLOCK", 7)
    monkeypatch.setattr(cells, "QUERIES", 4)
    found, _ = cells.search(cells.build(table, DIM, ring_rows=100), asked.drop("tags"), 10)
    assert found.count() == len(queries) * 10 and rows(found) == brute(vectors, queries, 10)


def test_more_wanted_than_rows(spark, data):
    _, queries, _, asked = data
    few = clustered(6, 2)
    found, work = cells.search(cells.build(frame(spark, few), DIM), asked.drop("tags"), 10)
    assert rows(found) == brute(few, queries, 10) and {r["n_compared"] for r in work.collect()} == {6}


def test_inner_products_with_zero_vectors(spark, data):
    _, queries, _, asked = data
    vectors = clustered(400, 10, 5) * np.linspace(0.0, 30.0, 400)[:, None]
    index = cells.build(frame(spark, vectors), DIM, inner=True, ring_rows=20)
    found, _ = cells.search(index, asked.drop("tags"), 5)
    assert rows(found) == brute(vectors, queries, 5, inner=True)


def test_odd_vectors_and_empty_tables(spark, data):
    _, _, table, asked = data
    odd = [(1, None), (2, []), (3, [0.0] * DIM), (4, [1.0] * (DIM - 1) + [None]), (5, [float("nan")] * DIM), (6, [float("inf")] * DIM), (7, [1.0] * DIM), (8, [1.0] * (DIM + 1))]
    rows_ = spark.createDataFrame(odd, "id long, vector array<double>")
    queries = rows_.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    found, work = cells.search(cells.build(rows_, DIM), queries, 3)
    assert rows(found) == {(7, 7, 1)} and [tuple(r) for r in work.collect()] == [(7, 1, 1)]
    nothing, work = cells.search(cells.build(table.limit(0), DIM), asked, 3)
    assert nothing.count() == 0 and {r["n_compared"] for r in work.collect()} == {0}
    assert cells.search(cells.build(table, DIM), asked.limit(0), 3)[0].count() == 0


def test_best_document_is_the_mean_distance(spark, data):
    vectors, queries, _, asked = data
    chunks = spark.createDataFrame([(i % 90, i % 4, v.tolist()) for i, v in enumerate(vectors)], "document_id long, level int, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    wanted = set()
    for n, q in enumerate(queries):
        distance = 1 - unit @ (q / np.linalg.norm(q))
        mean = {d: distance[[i for i in range(len(vectors)) if i % 90 == d and i % 4]].mean() for d in range(90)}
        best = min(mean, key=lambda d: (round(mean[d], 6), d))
        wanted.add((n, best, round(mean[best], 6)))
    assert {tuple(r) for r in rt.best_document(asked.drop("tags"), chunks, DIM, ring_rows=8).collect()} == wanted


def test_examples_of_one_category_and_device(spark):
    """A device of none serves every query, GENERAL every category; the limit stands after the first `k`."""
    live = [(1, "a", None), (2, "GENERAL", "x"), (3, "b", None), (4, "a", "y"), (5, None, None), (6, "GENERAL", None), (7, "a", "x")]
    examples = spark.createDataFrame([(i, [1.0, 0.0 if i != 7 else 9.0], c, d, True, i == 6, "abcdef") for i, c, d in live], "example_id long, vector array<double>, category string, for_device string, is_active boolean, is_superseded boolean, text string")
    queries = spark.createDataFrame([(1, [1.0, 0.0], "a", "x"), (2, [1.0, 0.0], "b", None), (3, [1.0, 0.0], None, "x")], "query_id long, query_vector array<double>, category string, device string")
    found = {(r["query_id"], r["example_id"], r["distance"], r["place"], r["text"]) for r in rt.example_search(queries, examples, 2, cut=3).collect()}
    assert found == {(1, 1, 0.0, 1, "abc"), (1, 2, 0.0, 2, "abc"), (2, 3, 0.0, 1, "abc"), (3, 2, 0.0, 1, "abc")}


def test_rows_stay_in_their_rings(spark):
    """The rings' edges are approximate quantiles: worked out again from other parts, they are others, and a search that reads the rows twice loses some."""
    ids = spark.range(60_000, numPartitions=16)
    vectors = ids.select("id", F.array(*[F.randn(i) for i in range(DIM)]).alias("vector"), (F.col("id") % 3).cast("int").alias("level"))
    index = cells.build(vectors, DIM, ["level"], ring_rows=5000)
    name = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(name)
    try:
        for size in ("200k", "1m"):
            spark.conf.set(name, size)
            counted = {(r["cell"], r["ring"]): r["count"] for r in index.rows.groupBy("cell", "ring").count().collect()}
            assert counted == {(r.cell, r.ring): r.n for r in index.rings.itertuples()}
    finally:
        spark.conf.set(name, usual)
