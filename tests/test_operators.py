"""Hand-computed cases: published ratios, null and zero branches, tampering."""

import math

import pytest
from pyspark.sql import functions as F

from auditweave.functions.columns import numbered
from auditweave.operators import chains, corpus, execution, feedback, mining, ranking, retrieval, review, safety, tamper
from auditweave.sources import files, tables


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_manifest_chain_flags_the_altered_entry_only(spark):
    rows = spark.createDataFrame([(1, k, f'{{"k": {k}}}') for k in range(3)], "document_id int, entry_sequence long, entry_json string")
    chain = chains.chained(rows)
    assert one(chains.verify(chain)) == {"document_id": 1, "is_valid": True, "entries_checked": 3, "first_failure": None}
    bad = chain.withColumn("entry_json", F.when(F.col("entry_sequence") == 1, "{}").otherwise(F.col("entry_json")))
    assert one(chains.verify(bad)) == {"document_id": 1, "is_valid": False, "entries_checked": 2, "first_failure": 1}


def test_log_chain_payload_change_marks_later_rows_and_hash_change_only_its_own(spark):
    rows = [("c", i, "node", None, "n", i, "m") for i in range(4)]
    logs = spark.createDataFrame(rows, "chain_id string, id long, operation_type string, document string, node_name string, started_ms long, metadata string")
    chain = chains.log_chain(logs)
    payload = chain.withColumn("metadata", F.when(F.col("id") == 1, "x").otherwise(F.col("metadata")))
    assert sorted(r["id"] for r in chains.verify_log_chain(payload).collect()) == [1, 2, 3]
    stored = chain.withColumn("record_hash", F.when(F.col("id") == 1, "x").otherwise(F.col("record_hash")))
    assert [r["id"] for r in chains.verify_log_chain(stored).collect()] == [1]


def test_leaf_coverage_with_a_cycle_and_an_unreachable_leaf(spark):
    chunks = spark.createDataFrame([(1, "r", 2), (1, "a", 1), (1, "x", 0), (1, "y", 0), (2, "z", 0)], "document_id int, id string, level int")
    edges = spark.createDataFrame([(1, "r", "a"), (1, "a", "r"), (1, "a", "x"), (1, "a", "none")], "document_id int, parent string, child string")
    got = {r["document_id"]: (r["depth"], r["leaves"], r["reached"], r["coverage"]) for r in corpus.leaf_coverage(chunks, edges, tables.stage_table).collect()}
    assert got == {1: (2, 2, 1, 0.5), 2: (0, 1, 1, 1.0)}


def test_published_concordance_and_rebuild_ratios(spark):
    cells = [("UP", "green")] * 65 + [("DOWN", "red")] * 16 + [("DOWN", "green")] * 8 + [("UP", "yellow")] * 12
    fb = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(cells)], "response_id int, feedback_type string")
    ev = spark.createDataFrame([(i, 1, b) for i, (_, b) in enumerate(cells)], "response_id int, attempt_number int, badge string")
    got = one(feedback.concordance(fb, ev))
    assert got["n"] == 101 and got["agreement"] == pytest.approx(81 / 101) and (got["too_lenient"], got["too_strict"]) == (8, 12)
    m = spark.createDataFrame([(87, 4356, 5, "chunk_created")], "document_id int, total_chunks int, entry_sequence int, entry_type string")
    c = spark.range(4410).select(F.lit(87).alias("document_id"))
    assert round(one(corpus.reconstructability(m, c))["score"], 4) == 0.9878


def test_published_detection_scores_and_interval(spark):
    rows = [("TP", "a", "a")] * 5 + [("TN", None, None)] * 5 + [("FP", None, "b")] + [("FN", "b", None)]
    got = one(tamper.scores(spark.createDataFrame(rows, "outcome string, kind string, guess string")))
    assert [round(got[k], 4) for k in ("accuracy", "precision", "recall", "f1")] == [0.8333] * 4
    ci = one(tamper.binomial_interval(spark.createDataFrame([(10, 12)], "hits int, n int")))
    assert (round(ci["lower"], 4), round(ci["upper"], 4)) == (0.5159, 0.9791)
    assert round(one(tamper.binomial_interval(spark.createDataFrame([(12, 12)], "hits int, n int")))["lower"], 4) == 0.7354


def test_inject_then_revert_gives_the_table_back(spark):
    links = spark.createDataFrame([(1, 10, 0), (2, 10, 1), (3, 11, 0)], "id int, response_id int, step_index int")
    assigned = spark.createDataFrame([(10, "chunk_deletion")], "response_id int, kind string")
    left, backup = tamper.without(links, tamper.link_targets(assigned, links))
    assert sorted(r["id"] for r in left.collect()) == [2, 3]
    assert sorted(map(tuple, tamper.revert(left, backup).collect())) == sorted(map(tuple, links.collect()))


def test_ranking_metrics_by_hand(spark):
    ranks = spark.createDataFrame([("q", "m", 1, "a", 0), ("q", "m", 2, "b", 1), ("q", "m", 3, "c", 0)], "query_id string, mode string, rank int, doc_id string, level int")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "d", 1)], "query_id string, doc_id string, grade int")
    got = one(ranking.per_query(ranks, qrels, 3))
    ndcg = (3 / math.log2(3)) / (3 / math.log2(2) + 1 / math.log2(3))
    assert (got["recall"], got["precision"], got["mrr"], got["hit"]) == (0.5, 1 / 3, 0.5, 1.0)
    assert got["ndcg"] == pytest.approx(ndcg, abs=1e-6)


def test_bootstrap_is_one_for_equal_and_small_for_clear_differences(spark):
    same = spark.createDataFrame([(i, 0.5, 0.5) for i in range(20)], "query_id int, a double, b double")
    assert one(ranking.bootstrap_p(same, iterations=200))["p_value"] == 1.0
    assert one(ranking.bootstrap_p(same.limit(0), iterations=200))["p_value"] == 1.0
    uneven = ranking.paired(spark.createDataFrame([(1, "h", 0.5), (2, "h", 0.6), (1, "r", 0.5)], "query_id int, mode string, ndcg double"), "ndcg", "h", "r")
    with pytest.raises(Exception, match="equal length"):
        ranking.bootstrap_p(uneven, iterations=20).collect()
    clear = spark.createDataFrame([(i, 0.9 + i % 3 / 100, 0.1) for i in range(20)], "query_id int, a double, b double")
    assert one(ranking.bootstrap_p(clear, iterations=200))["p_value"] < 0.05


@pytest.mark.parametrize(("a", "b", "bad", "want"), [(0.9, 0.8, 0.0, "green"), (0.9, 0.8, 0.1, "yellow"), (0.9, 0.8, 0.3, "red"), (0.9, 0.5, 0.0, "yellow"), (0.9, 0.3, 0.0, "red"), (None, 0.9, 0.5, "gray")])
def test_quality_badge(spark, a, b, bad, want):
    df = spark.createDataFrame([(a, b, bad)], "a double, b double, bad double")
    assert one(df.select(review.quality_badge([F.col("a"), F.col("b")], F.col("bad")).alias("x")))["x"] == want


def test_kappa_extremes(spark):
    rows = lambda pairs: spark.createDataFrame(pairs, "a string, b string")
    assert one(feedback.label_kappa(rows([("x", "x")] * 3)))["kappa"] == 1.0
    assert one(feedback.label_kappa(rows([("x", "x")]), least=2))["kappa"] is None
    assert one(feedback.label_kappa(rows([("x", "x")])))["kappa"] == 1.0 and one(feedback.label_kappa(rows([("x", "y")])))["kappa"] == 0.0
    assert one(feedback.label_kappa(rows([])))["kappa"] == 0.0
    assert one(feedback.label_kappa(rows([("x", "y"), ("y", "x")])))["band"] == "poor"


def test_toggle_fold(spark):
    ev = spark.createDataFrame([(1, 1, "UP"), (1, 2, "UP"), (2, 1, "UP"), (2, 2, "DOWN"), (3, 1, None)], "k int, place int, v string")
    got = {r["k"]: r["state"] for r in feedback.fold_toggles(ev, ["k"], "place", "v").collect()}
    assert got == {1: None, 2: "DOWN", 3: None}


def test_chi_squared_tail_is_that_of_tables(spark):
    df = spark.createDataFrame([(1, 3.841459), (4, 9.487729), (0, 5.0), (2, 0.0)], "df int, statistic double")
    assert [round(r["p_value"], 4) for r in mining.chi_squared_p(df).collect()] == [0.05, 0.05, 1.0, 1.0]


def test_mmr_keeps_all_of_few_and_prefers_other_directions(spark):
    m = spark.createDataFrame([("q", c, s, p) for c, s, p in (("a", 0.9, 1), ("b", 0.89, 2), ("c", 0.5, 3))], "query_id string, chunk_id string, score double, place int")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.001]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    assert [r["chunk_id"] for r in retrieval.mmr(m, v, 2).orderBy("pick").collect()] == ["a", "c"]
    assert retrieval.mmr(m, v, 5).count() == 3


def test_protocol_survival_branches(spark):
    df = spark.createDataFrame([("wear gloves always", "gloves always help"), ("do it", "do it now"), ("", "x"), (None, "x"), ("disconnect power supply", "nothing")], "p string, t string")
    assert [r["x"] for r in df.select(safety.survives(F.col("p"), F.col("t")).alias("x")).collect()] == [True, True, True, True, False]


def test_run_log_traps(spark):
    rows = [("1", "", "v2"), ("2", None, None), ("timeout", "v1", None), (None, "v1", None)]
    df = spark.createDataFrame(rows, "response_id string, actual_variant string, expected_variant string")
    assert sorted(r["variant"] for r in files.usable_runs(df).collect()) == ["unknown", "v2"]


def test_no_rows(spark):
    none = spark.createDataFrame([], "response_id int, step_index int, user_id int, action string, correction_type string, retracted boolean, id int, weight double")
    assert one(feedback.schema_coverage(none))["coverage"] == 0.0
    assert one(execution.logged_chunks(spark.createDataFrame([], "node_name string, metadata string"), spark.createDataFrame([], "id string")))["score"] == 1.0


def test_run_log_and_sheets_read_and_write(spark, tmp_path):
    (tmp_path / "run.json").write_text('[{"response_id": "1", "actual_variant": "", "expected_variant": "v"}]')
    assert files.usable_runs(files.read_run_log(spark, str(tmp_path / "run.json"))).first()["variant"] == "v"
    sheet = spark.createDataFrame([("1", 'a, "b"\nc')], "id string, text string")
    files.write_sheet(sheet, str(tmp_path / "sheet"))
    assert [tuple(r) for r in files.read_sheet(spark, str(tmp_path / "sheet")).collect()] == [("1", 'a, "b"\nc')]


def test_steps_take_chunks_in_order_and_images_are_rescued(spark):
    rows = [(1, 0, "a", 0.9, 5, False), (1, 0, "b", 0.9, 3, False), (1, 1, "c", 0.8, 4, False), (1, 1, "d", 0.5, 6, True), (1, 2, "e", 0.05, 9, True), (1, 9, "f", 0.05, 9, True), (2, 0, "a", None, 1, True), (2, 1, "b", 0.2, None, False)]
    scores = spark.createDataFrame(rows, "response_id long, step_index int, chunk_id string, score double, chunk_at int, has_image boolean")
    got = sorted(tuple(r) for r in retrieval.assign_in_order(scores).collect())
    assert got == [(1, 0, "a", 0.9, False), (1, 1, "d", 0.5, False), (1, 1, "e", 0.0, True)]
    assert retrieval.assign_in_order(scores.limit(0)).count() == 0


def test_rows_are_numbered_as_by_one_window(spark):
    ids = [7 * i + 3 for i in range(500)]
    order = sorted(ids, key=lambda q: ((((q * 7919 + 9) % 2147483647) * 48271 + 11) % 2147483647, q))
    got = {r["q"]: r["n"] for r in numbered(spark.createDataFrame([(i,) for i in ids], "q long"), "q", 9, "n").collect()}
    assert got == {q: n for n, q in enumerate(order)}


FULL = "IntentRouter DeterministicRuleChecker SymptomAnalyzer KnowledgeRetriever SafetyExtractor RepairPlanner SafetyJudgeGate"
PATHS = [
    ("IntentRouter FollowUpResponder InlineEvaluator", True, None, "followup"),
    ("IntentRouter DeterministicRuleChecker", True, None, "troubleshoot_deterministic_exit"),
    ("IntentRouter IntentRouter DeterministicRuleChecker", True, None, "troubleshoot_deterministic_exit"),
    ("IntentRouter DeterministicRuleChecker DirectReplacementAnalyzer KnowledgeRetriever SafetyExtractor RepairPlanner SafetyJudgeGate InlineEvaluator", True, None, "replace_part"),
    ("IntentRouter DeterministicRuleChecker SymptomAnalyzer KnowledgeRetriever RootCauseAnalyzer", True, None, "troubleshoot_short_circuit"),
    (f"{FULL} InlineEvaluator", True, None, "troubleshoot_full"),
    (f"{FULL} RepairPlanner SafetyJudgeGate InlineEvaluator", True, None, "troubleshoot_safety_retry"),
    (f"{FULL} InlineEvaluator RepairPlanner SafetyJudgeGate InlineEvaluator", False, "InlineEvaluator>RepairPlanner", "troubleshoot_eval_retry"),
    (FULL.replace("IntentRouter", "IntentRouter UnsafeMethodGate") + " InlineEvaluator", True, None, "unsafe_method_redirect"),
    (FULL, True, None, None),
    ("DeterministicRuleChecker", False, "START>DeterministicRuleChecker", "troubleshoot_deterministic_exit"),
    ("IntentRouter", False, "IntentRouter>END", None),
    ("health_dispatch", True, None, None),
]


def test_variants_and_conformance_of_each_path(spark):
    from auditweave.plans.views import MODEL_EDGES

    assert len(MODEL_EDGES) == 22
    rows = [(f"t{i:02d}", n + (":sub" if k % 2 else ""), k, k, "node") for i, (path, *_) in enumerate(PATHS) for k, n in enumerate(path.split())]
    logs = spark.createDataFrame(rows, "trace_id string, node_name string, started_ms long, id long, operation_type string")
    model = spark.createDataFrame(MODEL_EDGES, "src string, dst string")
    trace = mining.traces(logs, model)
    got = sorted(tuple(r) for r in mining.variants(trace, model, logs).collect())
    assert got == [(f"t{i:02d}", ok, edge, label) for i, (_, ok, edge, label) in enumerate(PATHS)]
    edges = mining.steps(trace, model)
    assert {r["trace_id"]: r["edges"] for r in mining.deviations(edges).collect()} == {"t07": "InlineEvaluator>RepairPlanner", "t10": "START>DeterministicRuleChecker", "t11": "IntentRouter>END"}
    few, enough = one(mining.fitness(edges)), one(mining.fitness(edges, 12))
    assert few["fitness"] is None and few["deviant"] == 3 and enough["conformance_rate"] == 0.75
    assert one(mining.precision(edges, model))["precision"] is None
    exact = one(mining.precision(edges, model, 1))
    assert (exact["observed"], exact["precision"], exact["unexercised"]) == (20, round(20 / 22, 4), "RootCauseAnalyzer>SafetyExtractor,UnsafeMethodGate>FollowUpResponder")
    answers = spark.createDataFrame([("t00", 2), ("t05", 3), ("t07", 4), ("t08", 7), ("t04", 4), ("t09", 1), ("t01", 9)], "trace_id string, expected int")
    agreed = {r["expected"]: (r["n"], r["agree"]) for r in mining.variant_agreement(mining.variants(trace, model), answers).collect()}
    assert agreed == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (2, 1), 7: (1, 1), 9: (1, 0)}


@pytest.mark.parametrize(
    ("facts", "want"),
    [
        ({"risks": ["PINCH_POINT", "LOTO"]}, "P0"), ({"faithfulness": 0.29}, "P0"), ({"source": "AUTO_EVAL", "badge": "red"}, "P0"), ({"source": "AUTO_EVAL", "badge": "red", "quality_badge": "green"}, "P3"),
        ({"source": "AUTO_EVAL", "badge": "red", "quality_badge": ""}, "P0"), ({"safety_badge": "red"}, "P1"), ({"answer_relevance": 0.5, "completeness": 0.59}, "P1"), ({"risks": ["PINCH_POINT"]}, "P1"),
        ({"has_correction": True, "source": "MANUAL_FLAG"}, "P1"), ({"has_correction": True}, "P3"), ({"context_relevance": 0.1}, "P2"), ({"faithfulness": 0.3}, "P2"), ({"source": "MANUAL_FLAG", "badge": "gray"}, "P2"),
        ({"badge": "red"}, "P3"), ({"completeness": 0.6, "risks": []}, "P3"), ({"source": None}, "P3"),
    ],
)
def test_review_priority_rules_in_order(spark, facts, want):
    row = {"id": 1, "source": "AUTO_SAFETY", "risks": None, "has_correction": None, "badge": None, "quality_badge": None, "safety_badge": None, **dict.fromkeys(review.METRICS), **facts}
    types = "id int, source string, risks array<string>, has_correction boolean, badge string, quality_badge string, safety_badge string, " + ", ".join(f"{m} double" for m in review.METRICS)
    got = one(review.reviewed(spark.createDataFrame([tuple(row.values())], types)))
    assert got == {"id": 1, "priority": want, "sla_hours": {"P0": 4, "P1": 24, "P2": 72, "P3": 168}[want]}


def test_step_scores_by_hand(spark):
    types = "response_id int, step_index int, chunk_id string, step_text string, chunk_text string, captions array<string>, header string, page int"
    cite = '<cite doc="m" page="3, 012-14">'
    rows = [
        (1, 0, "a", f"Turn the valve {cite}", "the valve leaks", ["valve photo", None, "Turn valve"], "Valve section", 12),
        (1, 0, "b", f"Turn the valve {cite}", "", None, None, 1),
        (1, 1, "b", "a b", "a b", ["a b"], "valve", 1),
        (2, 0, "a", "größe prüfen", "Größe", [], "Größe", None),
    ]
    pairs = spark.createDataFrame(rows, types)
    lexical = {(r["response_id"], r["step_index"], r["chunk_id"]): r["score"] for r in retrieval.lexical_scores(pairs).collect()}
    # words of the first step: turn the valve cite doc page 012; two of eight with the text, two of seven with the best caption
    assert lexical == {(1, 0, "a"): round(0.55 * 2 / 8 + 0.25 + 0.2 * 2 / 7, 6), (1, 0, "b"): 0.0, (1, 1, "b"): 0.0, (2, 0, "a"): round(0.55 / 2, 6)}
    placed = retrieval.in_reading_order(pairs)
    near = {(r["response_id"], r["step_index"], r["chunk_id"]): r["score"] for r in retrieval.positional_scores(placed).collect()}
    # reading order of response 1: b (page 1), then a (page 12)
    assert near == {(1, 0, "a"): round(0.3 + 0.2 / 2, 6), (1, 0, "b"): 0.5, (1, 1, "b"): 0.0, (2, 0, "a"): 0.7}
    lone = placed.filter("response_id = 1 and step_index = 0").withColumn("n_steps", F.lit(1))
    assert {r["chunk_id"]: r["score"] for r in retrieval.positional_scores(lone).collect()} == {"a": round(0.25 + 0.3 + 0.1, 6), "b": 0.25}


def test_a_safety_session_loses_a_chunk(spark):
    for safe in (None, 3, 17, 30):
        rows = spark.createDataFrame([(q, q, q, safe is not None and q >= safe) for q in range(40)], "query_id long, response_id long, thread_id long, safety_found boolean")
        got = tamper.assigned(rows, 9).collect()
        injected = [r for r in got if r["is_injected"]]
        assert len(got) == 40 and len(injected) == 20 and all(r["kind"] is None for r in got if not r["is_injected"])
        assert all(sum(r["kind"] == k for r in injected) == 5 for k in tamper.KINDS)
        if safe is not None:
            assert any(r["kind"] == "chunk_deletion" and r["query_id"] >= safe for r in injected)


def test_routing_retries_and_decisions_by_hand(spark):
    rows = [
        (1, "route_from_knowledge", "edge_decision", '{"intent": "Troubleshoot", "target": "x"}', False), (1, "route_from_knowledge", "edge_decision", '{"target": "skip_safety_eval"}', False),
        (1, "route_from_knowledge", "edge_decision", '{"intent": "chat"}', False), (1, "route_from_knowledge", "edge_decision", None, False),
        (1, "IntentRouter", "node", '{"intent": "PROCEDURAL"}', False), (2, "IntentRouter", "node", "{}", False), (1, "SafetyExtractor", "node", None, False),
        (1, "edge:route_from_safety_judge", "edge_decision", '{"decision": "RepairPlanner"}', False), (2, "edge:route_from_safety_judge", "edge_decision", '{"decision": "InlineEvaluator"}', False),
        (1, "edge:route_from_inline_evaluator", "edge_decision", '{"decision": "RepairPlanner"}', False), (2, "edge:route_from_inline_evaluator", "edge_decision", '{"decision": "RepairPlanner"}', False),
        (1, "RepairPlanner", "node", '{"attempt_number": 2}', False), (2, "RepairPlanner", "llm_call", None, True), (3, "RepairPlanner", "node", None, False), (4, "RepairPlanner", "edge_decision", None, True),
        (1, "edge:route_from_intent", "edge_decision", '{"decision": "FollowUpResponder"}', False), (2, "edge:route_from_intent", "edge_decision", None, False),
    ]
    logs = spark.createDataFrame(rows, "thread_id int, node_name string, operation_type string, metadata string, is_retry boolean")
    assert one(execution.routing_by_edges(logs)) == {"total": 3, "correct": 2, "missed": 0, "score": 2 / 3}
    assert one(execution.routing_by_nodes(logs, ("SafetyExtractor",))) == {"total": 2, "correct": 2, "missed": 0, "score": 1.0}
    assert one(execution.retry_triggers(logs)) == {"by_first": 1, "by_second": 2, "first_share": 0.3333, "second_share": 0.6667}
    assert one(execution.retry_triggers(logs.limit(0))) == {"by_first": 0, "by_second": 0, "first_share": None, "second_share": None}
    assert one(execution.retry_rate(logs)) == {"threads": 3, "retried": 2, "rate": 2 / 3}
    assert one(execution.decision_rate(logs, "edge:route_from_intent", "FollowUpResponder")) == {"total": 2, "hits": 1, "rate": 0.5}


def test_chi_squared_tail_far_out(spark):
    tests = spark.createDataFrame([(1, 3.841459), (2, 100.0), (4, 60.0), (0, 1.0), (3, 0.0)], "df int, statistic double")
    got = {(r["df"], r["statistic"]): r["p_value"] for r in mining.chi_squared_p(tests).collect()}
    assert math.isclose(got[1, 3.841459], 0.05, rel_tol=1e-5) and math.isclose(got[2, 100.0], math.exp(-50), rel_tol=1e-9)
    assert math.isclose(got[4, 60.0], math.exp(-30) * 31, rel_tol=1e-9) and got[0, 1.0] == got[3, 0.0] == 1.0


def test_streams_of_several_batches(spark, tmp_path):
    """State and watermarks carry over batches; a row behind the watermark is dropped, log records are put in order.

    Spark drops late rows by the watermark that the batch before was run with, so a batch lies between.
    """
    import time

    from auditweave.streaming import incremental

    def arrive(name, batches, types):
        for rows in batches:
            spark.createDataFrame(rows, types).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(0.05)
        return incremental.stream_of(spark, str(tmp_path / name))

    batches = [[(1, "a", 0, 1.0), (2, "b", 10, 2.0)], [(3, "a", 9000, 3.0)], [(6, "b", 9002, 1.0)], [(4, "a", 20, 4.0), (5, "a", 9001, 5.0)]]
    stream = arrive("events", batches, "id long, node string, s long, value double")
    got = incremental.drain(incremental.node_activity(stream, "ts", "node", F.col("value") > 2, "value"), "update", ["window_start", "node"])
    seen = sorted((int(r["at"]), r["node"], r["rows"], r["errors"], r["total"]) for r in got.withColumn("at", F.unix_seconds("window_start")).collect())
    assert seen == [(0, "a", 1, 0, 1.0), (0, "b", 1, 0, 2.0), (7200, "a", 2, 2, 8.0), (7200, "b", 1, 0, 1.0)]

    rows = [("c", i, "node", None, "n", i, "m") for i in range(6)] + [("d", 0, "node", "x", "n", 0, None)]
    logs = chains.log_chain(spark.createDataFrame(rows, "chain_id string, id long, operation_type string, document string, node_name string, started_ms long, metadata string"))
    changed = logs.withColumn("metadata", F.when((F.col("chain_id") == "c") & (F.col("id") == 3), "x").otherwise(F.col("metadata"))).cache()
    for ids in ("id in (0, 2)", "id in (1, 3)"):
        changed.filter(ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "logs"))
        time.sleep(0.05)
    with incremental.rocksdb_state(spark):
        stream = incremental.broken_records(incremental.stream_of(spark, str(tmp_path / "logs")), "0 seconds")
        found = sorted((r["chain_id"], r["id"], r["state"]) for r in incremental.drain(stream).collect())
    assert found == [("c", 3, "broken")]  # 2 waited for the next batch, which brought 1; 3 was changed
