"""Hand-computed cases of what a model is shown."""

from auditweave.operators import context as cx

CHUNK = "id string, document_id int, name string, doc_path string, pages int, page_start int, sequence_index int, section_header string, level int, text string, images array<struct<path:string,caption:string>>"


def chunk(id, doc, seq, text, page=1, level=0, header=None, images=None, name="N"):
    return (id, doc, name, "p", page, page, seq, header, level, text, images)


def test_neighbours_in_reading_order(spark):
    """Place 0 comes last; texts that begin alike, empty texts, other documents and places below 0 are no neighbours."""
    long = "x" * 80
    chunks = spark.createDataFrame(
        [chunk("a0", 1, 0, "zero"), chunk("a1", 1, 1, "one"), chunk("a2", 1, 2, long + "!"), chunk("a3", 1, 3, long + "?"), chunk("a4", 1, 4, "four"), chunk("a5", 1, 5, None), chunk("a6", 1, 6, "six"), chunk("a7", 1, 7, "seven"), chunk("b1", 2, 1, "other")], CHUNK
    )
    hits = spark.createDataFrame([(1, "a0"), (1, "a2"), (1, "a4"), (1, "a4"), (1, "a6"), (1, "b1"), (2, "b1"), (3, "a1")], "query_id int, chunk_id string")
    chosen = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "query_id int, document_id int")
    rows, counts = cx.with_neighbours(hits, chosen, chunks)
    got = {(r["query_id"], r["place"], r["chunk_id"], r["is_neighbour"]) for r in rows.collect()}
    assert got == {(1, 1, "a1", True), (1, 2, "a2", False), (1, 3, "a4", False), (1, 4, "a6", False), (1, 5, "a7", True), (1, 6, "a0", False), (2, 1, "b1", False)}
    assert {tuple(r) for r in counts.collect()} == {(1, 4, 2, 2), (2, 2, 0, 0)}


def test_blocks_context_and_overview(spark):
    pictures = [("a.png", None), ("http://x/b.png", "B"), (None, "lost")]
    chunks = spark.createDataFrame(
        [chunk("c", 1, 3, "text", images=pictures), chunk("d", 1, None, None, page=None, name=None, images=[("a.png", "again")]), chunk("s", 1, None, "sum", 4, 1, "Oil"), chunk("t", 1, None, "top", None, 2, ""), chunk("u", 1, None, "r", 2, 1)], CHUNK
    )
    found = {r["chunk_id"]: r["block"] for r in cx.blocks(chunks, "https://f/").collect()}
    assert found["c"] == "---[N | doc: p | Page 1 | Seq 3]---\ntext\n\nRelevant Diagrams:\n![Diagram](https://f/a.png)\n![B](http://x/b.png)\n"
    assert found["d"] == "---[- | doc: p | Page -]---\n\n\nRelevant Diagrams:\n![again](https://f/a.png)\n"
    matches = spark.createDataFrame([(1, "d", 1), (1, "c", 2)], "query_id int, chunk_id string, place int")
    row = cx.cited_context(matches, chunks, "https://f").first()
    assert row["context"] == found["d"] + "\n\n" + found["c"] and row["image_keys"] == ["a.png", "http://x/b.png"]
    assert cx.overview(chunks).first()["overview"] == "--- MANUAL OVERVIEW ---\n\n[Chapter Summary (pp. -)]\ntop\n\n[Section Summary (pp. 2)]\nr\n\n[Section Summary — Oil (pp. 4)]\nsum"
    assert cx.cited_context(matches.limit(0), chunks, "b").count() == 0 and cx.overview(chunks.filter("level = 0")).count() == 0


def test_images_once_and_funnel(spark):
    assigned = spark.createDataFrame([(1, 0, 1, "c"), (1, 2, 0, "d"), (2, 0, 0, "none")], "response_id int, step_index int, chunk_at int, chunk_id string")
    images = spark.createDataFrame([("c", 0, "u", "one"), ("d", 0, "u", "two"), ("d", 1, "v", None), ("e", 0, "w", None)], "chunk_id string, position int, url string, caption string")
    shown = spark.createDataFrame([(1, "c"), (1, "d"), (1, "e"), (1, "e"), (2, "none")], "response_id int, chunk_id string")
    used, counts = cx.step_images(assigned, shown, images)
    assert {tuple(r) for r in used.collect()} == {(1, 0, 1, "u", "one"), (1, 2, 1, "v", None)}
    assert {tuple(r) for r in counts.collect()} == {(1, 2, 1), (2, 0, 0)}
    matches = spark.createDataFrame([(1, "c", 0.5), (1, "d", 0.4), (1, "e", 0.3)], "query_id int, chunk_id string, score double")
    cache = spark.createDataFrame([("c", 1.0, 0.0, 1.0), ("d", 1.0, 1.0, 0.0)], "chunk_id string, positive double, negative double, net double")
    scores, totals = cx.funnel(matches, cache, spark.createDataFrame([(1, "c", 7), (1, "e", None)], "query_id int, chunk_id string, reranker_score int"))
    assert {tuple(r) for r in scores.collect()} == {(1, "c", 0.5, 0.55, 7), (1, "e", 0.3, 0.3, None)}
    assert [tuple(r) for r in totals.collect()] == [(1, 3, 2, 1)]
