"""Hand-computed cases of the annotation round trip."""

from auditweave.sources import annotation as an
from auditweave.sources.files import verdict_rows


def test_expectations_in_order_over_ranges(spark):
    """Ids follow the positions over any number of ranges; an unknown source has no device, a missing system no safety."""
    rows = [(200_001, "S", "part_replacement", "Fuel", False), (5, "T", "operational_anomaly", None, None), (7, "S", "other", "Fuel", True)]
    corpus = spark.createDataFrame(rows, "position long, source string, observation_type string, system string, is_obscure boolean")
    got = [tuple(r) for r in an.labelled(corpus, {"S": "dev"}, ["Fuel"]).orderBy("position").collect()]
    assert got == [
        ("EQ-001", 5, None, "troubleshoot", 4, False, "Full troubleshoot path — "),
        ("EQ-002", 7, "dev", "troubleshoot", 3, True, "Variant #3 — obscure system (Fuel), expecting troubleshoot short-circuit; should retrieve safety procedures"),
        ("EQ-003", 200_001, "dev", "replace_part", 5, True, "Full replace_part path — Fuel; should retrieve safety procedures"),
    ]
    more = spark.range(1200).selectExpr("id AS position")
    assert [r["no"] for r in an.in_sequence(more, "position", "no", 100).orderBy("position").collect()] == list(range(1, 1201))
    assert tuple(an.safety_counts(an.labelled(corpus.limit(0), {}, [])).first()) == (0, 0, "BELOW MIN")
    assert {tuple(r) for r in an.system_counts(corpus, 1).collect()} == {("Fuel", 2, True), (None, 1, False)}


def test_correction_text_skips_blanks(spark):
    rows = spark.createDataFrame([("yes", " ", None, " more "), (" ", None, "", "  "), (None, "all", "ok", None)], "a string, b string, c string, d string")
    assert [r[0] for r in rows.select(an.correction_text("a", "b", "c", "d")).collect()] == ["correctness=yes; more", None, "completeness=all; safety=ok"]


def test_import_updates_inserts_and_skips(spark):
    """Known keys keep thread, device, category and weight and take nulls too; of a key's rows the last with a verdict counts."""
    old = spark.createDataFrame([(1, 0, 9, 70, "d", "C", "ACCEPT", "was", "low", 2.0), (1, 1, 9, 70, "d", "C", "SKIP", "was", "low", 2.0)], "response_id int, step_index int, user_id int, thread_id int, device string, category string, action string, correction_text string, severity string, weight double")
    sheet = spark.createDataFrame(
        [(1, 0, 9, " modify ", " ", "high", 1), (1, 0, 9, "", "late", "", 2), (2, 0, 9, "accept", "x", "", 3), (2, 0, 9, "incorrect", "y", "", 4), (3, 0, 8, "ACCEPT", "", "", 5)],
        "response_id int, step_index int, user_id int, action string, correction_text string, severity string, place int",
    )
    context = spark.createDataFrame([(1, 71, "e"), (2, 72, "f")], "response_id int, thread_id int, device string")
    keys = ["response_id", "step_index", "user_id"]
    new = verdict_rows(sheet, keys, "action", "place")
    got = {tuple(r) for r in an.imported(old, new, context, keys, ["action", "correction_text", "severity"]).collect()}
    assert got == {
        (1, 0, 9, 70, "d", "C", "MODIFY", None, "high", 2.0), (1, 1, 9, 70, "d", "C", "SKIP", "was", "low", 2.0), (2, 0, 9, 72, "f", "GENERAL", "INCORRECT", "y", None, 1.0),
    }
    assert {tuple(r) for r in an.import_counts(new, context, "action").collect()} == {(9, 2, 2, 0), (8, 0, 0, 1)}
    assert {tuple(r) for r in an.imported(old, new.limit(0), context, keys, ["action", "correction_text", "severity"]).collect()} == {tuple(r) for r in old.collect()}


def test_bundle_of_runs_without_rows(spark):
    """A run without trace, links, evaluation or query has zeros, nulls and says what is missing; texts and metadata are cut at 500."""
    runs = spark.createDataFrame([(1, 10, 100, "t"), (2, 20, 100, None)], "query_id int, response_id int, thread_id int, trace_id string")
    queries = spark.createDataFrame([(1, "why", None)], "query_id int, text string, device string")
    evals = spark.createDataFrame([(1, 10, "red", 0.1), (2, 10, "green", None)], "id int, response_id int, badge string, s double").selectExpr("*", "s AS sync_faithfulness", "s AS sync_answer_relevance", "s AS sync_context_relevance", "s AS sync_completeness")
    logs = spark.createDataFrame([("t", 2, "B", "node", 5, 50, "m" * 900), ("t", 1, "A", "node", None, 60, None)], "trace_id string, id int, node_name string, operation_type string, latency_ms int, started_ms int, metadata string")
    links = spark.createDataFrame([("l1", 10, "c", 0), ("l2", 10, "c", None), ("l3", 10, "gone", 0), ("l4", 30, "c", 0)], "id string, response_id int, chunk_id string, step_index int")
    chunks = spark.createDataFrame([("c", 1, "h", True, "x" * 501)], "id string, document_id int, section_header string, has_safety_content boolean, text string")
    got = {r["response_id"]: r for r in an.bundle(runs, queries, evals, logs, links, chunks).collect()}
    assert tuple(got[10])[4:] == ("why", "unknown", "green", None, None, None, None, 2, 2, 2)
    assert tuple(got[20])[4:] == ("MISSING: 2", "unknown", None, None, None, None, None, 0, 0, 0)
    assert [(r["place"], r["node_name"], len(r["meta_summary"] or "")) for r in an.log_rows(runs, logs).orderBy("place").collect()] == [(1, "B", 500), (2, "A", 0)]
    assert {(r["link_id"], len(r["preview"])) for r in an.linked_chunks(runs, links, chunks).collect()} == {("l1", 500), ("l2", 500)}
