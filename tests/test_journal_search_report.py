"""The change journal, substring search, rule matching and the nested report on small made tables."""

import random

import pytest
from pyspark.sql import functions as F

from auditweave.operators import chains, grams, report, retrieval, search
from auditweave.operators import journal as jr


def experiment(spark):
    links = spark.createDataFrame([("a", 1, "c1", 2), ("b", 1, "c2", 1), ("c", 2, "c1", None), ("d", 5, "c3", 0)], "id string, response_id long, chunk_id string, step_index int")
    chunks = spark.createDataFrame([("c1", 7, True), ("c2", 8, False), ("c3", 8, None)], "id string, document_id int, has_safety_content boolean")
    evals = spark.createDataFrame([(10, 3, 0.25), (11, 3, 0.5), (12, 9, None)], "id long, response_id long, sync_faithfulness double")
    logs = spark.createDataFrame([(i, "t", 40, "node", None, f"n{i}", i * 10, "{}") for i in range(4)] + [(9, "u", 41, "node", None, "n", 1, None)], "id long, chain_id string, thread_id long, operation_type string, document string, node_name string, started_ms long, metadata string")
    manifest = spark.createDataFrame([(1, 7, "chunk_created", '{"a": 1}'), (2, 7, "x", "{}"), (3, 8, "x", "{}")], "entry_sequence long, document_id int, entry_type string, entry_json string")
    tables = {"links": links, "evals": evals, "logs": chains.log_chain(logs), "manifest": chains.chained(manifest)}
    sessions = spark.createDataFrame(
        [(1, 1, 0, "chunk_deletion", True), (2, 1, 0, "chunk_deletion", False), (3, 3, 0, "score_perturbation", False), (4, 9, 0, "score_perturbation", False), (5, 0, 40, "log_gap", False),
         (6, 0, 41, "log_gap", False), (7, 1, 0, "manifest_tamper", False), (8, 2, 0, "manifest_tamper", False), (9, 99, 99, "chunk_deletion", False), (10, 5, 0, "chunk_deletion", True)],
        "query_id long, response_id long, thread_id long, kind string, safety_required boolean",
    )
    return tables, sessions, chunks


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_journal_by_hand(spark):
    tables, sessions, chunks = experiment(spark)
    picked = jr.targets(sessions, tables, chunks)
    assert rows(picked.select("query_id", "table_name", "key")) == sorted([("a", 1, "links"), ("b", 2, "links"), ("10", 3, "evals"), ("12", 4, "evals"), ("2", 5, "logs"), ("1", 7, "manifest")], key=repr)
    changes = jr.journal(picked, tables).cache()
    by = {(r["table_name"], r["key"]): (r["column_name"], r["before"], r["after"]) for r in changes.collect()}
    assert by["evals", "10"] == ("sync_faithfulness", "0.25", "0.75") and by["evals", "12"] == ("sync_faithfulness", None, "1.0")
    assert by["manifest", "1"][2] == "TAMPERED_" + by["manifest", "1"][1][:55] and by["links", "a"][0] is None and '"chunk_id":"c1"' in by["links", "a"][1]

    injected = jr.applied(tables, changes)
    assert {n: t.count() for n, t in injected.items()} == {"links": 2, "evals": 3, "logs": 4, "manifest": 3}
    assert rows(jr.applied(injected, changes)["manifest"]) == rows(injected["manifest"])
    # the chains' own checks find what was done
    assert rows(chains.broken_documents(injected["manifest"])) == [(7,)]
    assert rows(chains.verify_log_chain(injected["logs"])) == [("t", 3)]
    told = {(r["table_name"], r["key"]): (r["is_restored"], r["reason"]) for r in jr.verified(injected, changes).collect()}
    assert told["links", "a"] == (False, "links id=a not found") and told["logs", "2"] == (False, "logs id=2 not found")
    assert told["evals", "10"] == (False, "evals id=10: sync_faithfulness is 0.75, expected 0.25") and told["evals", "12"][1].endswith("is 1.0, expected null")
    assert told["manifest", "1"] == (False, "manifest entry_sequence=1: hash still tampered")

    back = jr.reverted(injected, changes)
    assert {n: rows(t) for n, t in back.items()} == {n: rows(t) for n, t in tables.items()}
    assert {n: jr.digest(t).first() for n, t in back.items()} == {n: jr.digest(t.select(*back[n].columns)).first() for n, t in tables.items()}
    assert {n: rows(t) for n, t in jr.reverted(back, changes).items()} == {n: rows(t) for n, t in tables.items()}
    assert all(r["is_restored"] and r["reason"].endswith(" restored") for r in jr.verified(back, changes).collect())
    wrong = back | {"links": back["links"].withColumn("chunk_id", F.lit("other"))}
    assert {r["reason"] for r in jr.verified(wrong, changes).filter("key = 'a'").collect()} == {"links id=a: chunk_id is other, expected c1"}


def test_an_empty_journal_changes_nothing(spark):
    tables, sessions, chunks = experiment(spark)
    changes = jr.journal(jr.targets(sessions.limit(0), tables, chunks), tables)
    assert changes.collect() == [] and {n: rows(t) for n, t in jr.applied(tables, changes).items()} == {n: rows(t) for n, t in tables.items()}
    assert jr.verified(tables, changes).collect() == []


def test_candidates_lose_no_pattern(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab é%") for _ in range(n))
    texts = [(i, word(rng.randint(0, 12))) for i in range(80)]
    patterns = [(i, [word(rng.randint(0, 4)) for _ in range(rng.randint(0, 3))]) for i in range(60)]
    left, right = grams.posted(spark.createDataFrame(texts, "t int, text string"), "text", spark.createDataFrame(patterns, "p int, kw array<string>").withColumn("_pattern", F.col("p")), "kw")
    got = left.join(right, "gram").filter(F.forall("kw", lambda k: F.contains("text", k))).select("t", "p").collect()
    assert sorted(map(tuple, got)) == sorted((t, p) for t, text in texts for p, kw in patterns if all(k in text for k in kw))


def test_rules_by_category_device_priority_and_age(spark):
    rules = [
        (1, "c1", None, ["Hot", "oil"], 5, 10, True, True, None), (2, "GENERAL", None, ["oil"], 5, 11, True, True, None), (3, "c1", "d1", ["oil"], 9, 1, True, True, None), (4, "c1", "d2", ["oil"], 99, 1, True, True, None),
        (5, "c2", None, ["oil"], 99, 1, True, True, None), (6, "c1", None, ["oil"], 99, 1, False, True, None), (7, "c1", None, ["oil"], 99, 1, True, False, None), (8, "c1", None, ["oil"], 99, 1, True, True, 100),
        (9, "c1", None, [], 1, 1, True, True, 101), (10, "c1", None, ["x"], 50, 1, True, True, None), (11, "c1", None, ["OIL", "hot"], 5, 12, True, True, None),
    ]
    rules = spark.createDataFrame(rules, "rule_id int, category string, device string, keywords array<string>, priority int, created_s int, is_active boolean, is_approved boolean, expires int")
    asked = spark.createDataFrame([(1, "c1", "d1", "HOT OILY"), (2, "c1", "d3", "boil it hot"), (3, "c1", "d3", "cold oil"), (4, "c1", "d3", ""), (5, "c9", "d1", "nothing"), (6, "c1", None, "axe")], "query_id int, category string, device string, text string")
    got = {r["query_id"]: r["rule_id"] for r in retrieval.match_rules(asked, rules, 100).collect()}
    assert got == {1: 3, 2: 11, 3: 2, 4: 9, 6: 10}


def test_sections_by_parts_of_words(spark):
    chunks = spark.createDataFrame(
        [(1, "a", 0, "7-1. Disassembly", 3, 0), (1, "b", 0, "Speaker Part", 1, 0), (1, "c", 0, None, 2, 0), (1, "d", 1, "Speaker Part", 0, 0), (2, "e", 0, "Intro", 1, 0)],
        "document_id int, id string, level int, section_header string, page_start int, sequence_index int",
    )
    asked = spark.createDataFrame([(1, 1, "where is the SPEAKER part"), (2, 1, "assembly"), (3, 1, "the of"), (4, 2, "speaker"), (5, 1, "manual section")], "query_id int, document_id int, text string")
    got = {}
    for r in retrieval.sections(asked, chunks).orderBy("query_id", "place").collect():
        got.setdefault((r["query_id"], r["is_fallback"]), []).append(r["id"])
    assert got == {(1, False): ["b"], (2, False): ["a"], (3, True): ["b", "c", "a"], (4, True): ["e"], (5, True): ["b", "c", "a"]}


@pytest.fixture(scope="module")
def sessions(spark, tmp_path_factory):
    rng = random.Random(6)
    texts = ["Pump_1", "pump%1", "pu\\mp", "PUMP", "é_É", "", "p", "a%b_c\\d"]
    made = [(i, rng.choice([*texts, None]), rng.choice([*texts, None]), i % 3 == 0, rng.choice([None, 1, 2]), i % 7, rng.choice(["A", "B"])) for i in range(120)]
    df = spark.createDataFrame(made, "id long, device string, email string, is_escalated boolean, risk_tier int, created_s long, review_state string")
    path = str(tmp_path_factory.mktemp("search"))
    search.build_index(df, ["device", "email", "id"], path)
    return df, path


@pytest.mark.parametrize("term", ["pump", "%", "_", "\\", "p", "Pu", "b_c\\", "É", "12", "none such", ""])
def test_search_equals_a_full_scan(spark, sessions, term):
    df, path = sessions
    like = "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    full = df.filter(F.col("device").ilike(like) | F.col("email").ilike(like) | F.col("id").cast("string").ilike(like)) if term else df
    got = search.found(spark, path, ["device", "email", "id"], term)
    assert rows(got) == rows(full.select(*got.columns))


def test_a_selective_search_reads_few_files(spark, sessions):
    _, path = sessions
    got = search.found(spark, path, ["device", "email", "id"], "119")
    assert [r["id"] for r in got.collect()] == [119]
    scans = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "/rows]" in line or "postings" in line]
    assert scans and all("PartitionFilters: [" in line and "bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_review_queue_order_and_latest_evaluation(spark, sessions):
    df, _ = sessions
    evals = spark.createDataFrame([(1, 3, "red", 0.1, 0.2), (5, 3, "green", 0.9, None)], "id long, thread_id long, badge string, sync_faithfulness double, sync_answer_relevance double")
    want = sorted((r for r in df.collect() if r["review_state"] == "A"), key=lambda r: (not r["is_escalated"], -(r["risk_tier"] or 0), -r["created_s"], r["id"]))
    got = search.review_queue(df, evals, "A", size=10, number=1).orderBy("place").collect()
    assert [r["id"] for r in got] == [r["id"] for r in want[10:20]] and {r["total"] for r in got} == {len(want)}
    all_rows = search.review_queue(df, evals, None, "device", False, 500).collect()
    assert len(all_rows) == 120 and [(r["badge"], r["sync_faithfulness"]) for r in all_rows if r["id"] == 3] == [("green", 0.9)]


def test_nested_report_of_responses_with_and_without_parts(spark):
    evals = spark.createDataFrame([(1, 10, 5, "red", 0.5), (2, 10, 5, "green", 0.75), (3, 11, 6, "gray", None)], "id long, response_id long, thread_id long, badge string, sync_faithfulness double")
    links = spark.createDataFrame([("x", 10, "c2", 1, "verbatim", 0.5), ("y", 10, "c1", 0, "ungrounded", 0.25), ("z", 10, "gone", None, "verbatim", 0.1)], "id string, response_id long, chunk_id string, step_index int, grounding_label string, similarity_score double")
    chunks = spark.createDataFrame([("c1", 1), ("c2", 2)], "id string, document_id int")
    documents = spark.createDataFrame([(1, 0.5), (2, 1.0)], "document_id int, score double")
    step_fb = spark.createDataFrame([(10, "ACCEPT"), (10, "MODIFY")], "response_id long, action string")
    resp_fb = spark.createDataFrame([(10, "UP", False), (10, "DOWN", True)], "response_id long, feedback_type string, retracted boolean")
    logs = spark.createDataFrame(
        [(1, 5, "t1", "A", "node", 10, 7), (2, 5, "t1", "B:sub", "llm_call", 5, 3), (3, 5, "t1", "edge:x", "edge_decision", 1, 100), (4, 5, "t1", "B", "node", 20, None), (0, 5, "t0", "Z", "node", 0, 9)],
        "id long, thread_id long, trace_id string, node_name string, operation_type string, started_ms long, latency_ms long",
    )
    fits = spark.createDataFrame([("t1", False, "A>B", None)], "trace_id string, is_conforming boolean, first_deviation string, variant string")
    got = {r["response_id"]: r for r in report.trace_report(evals, links, chunks, documents, step_fb, resp_fb, logs, fits).collect()}
    a, b = got[10], got[11]
    assert a["attempts"] == 2 and a["scores"]["badge"] == "green" and [x["chunk_id"] for x in a["evidence"]["attribution"]] == ["c1", "c2", "gone"]
    assert a["evidence"]["resolved"] == 2 and a["evidence"]["rebuildable"] == 0.75 and (a["feedback"]["accept"], a["feedback"]["modify"], a["feedback"]["up"], a["feedback"]["down"]) == (1, 1, 1, 0)
    assert a["trace"]["nodes"] == ["B", "A"] and a["trace"]["total_ms"] == 10 and a["trace"]["first_deviation"] == "A>B"
    assert b["evidence"]["attribution"] is None and b["trace"]["trace_id"] is None and b["feedback"]["up"] is None
    plan = report.trace_report(evals, links, chunks, documents, step_fb, resp_fb, logs, fits)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 8
