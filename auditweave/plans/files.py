import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import to_envelope
from ..operators import provenance as xl
from ..sources import annotation, files, tables
from .provenance import _RESOLVED, _resolved

_CORPUS = "co AS (SELECT p_partkey AS query_no, p_type AS observation_type, p_brand AS system, CASE WHEN p_size % 2 = 0 THEN 'manual' ELSE 'user' END AS origin, p_name AS variant FROM part)"
_T = "split_part(node_name, ':', 1)"
_RUNS = """SELECT thread_id, CASE WHEN query_id % 13 = 0 THEN NULL ELSE response_id END AS response_id, query_id % 7 = 0 AS gate_rejected, CASE WHEN query_id % 4 = 0 THEN 'troubleshoot_deterministic_exit' ELSE trace_variant END AS trace_variant FROM run_log"""


def _corpus(v):
    return v.part.selectExpr("p_partkey AS query_no", "p_type AS observation_type", "p_brand AS system", "CASE WHEN p_size % 2 = 0 THEN 'manual' ELSE 'user' END AS origin", "p_name AS variant")


def _minimum(v):
    return v.part.groupBy(F.col("p_name").alias("variant")).agg(F.max("p_size").alias("least"))


def _sheet(v):
    return v.lineitem.selectExpr(
        "l_orderkey AS response_id", "l_linenumber AS step_index", "CASE WHEN l_tax = 0 THEN ' ' ELSE concat(' ', lower(l_returnflag), ' ') END AS verdict",
        "CASE WHEN l_discount = 0 THEN '  ' ELSE concat(' ', l_linestatus, ' ') END AS severity", "l_partkey * 100000 + l_suppkey * 100 + CAST(l_quantity AS INT) AS place",
    )


_SHEET = """sh AS (SELECT l_orderkey AS response_id, l_linenumber AS step_index, CASE WHEN l_tax = 0 THEN NULL ELSE l_returnflag END AS verdict, CASE WHEN l_discount = 0 THEN NULL ELSE l_linestatus END AS severity,
  l_partkey * 100000 + l_suppkey * 100 + CAST(floor(l_quantity) AS INT) AS place FROM lineitem)"""


def _refs(v):
    return v.links.filter("step_index is not null").select(F.col("response_id").alias("thread_id"), F.col("step_index").cast("int").alias("step_index"), "chunk_id")


def _upsert(v):
    old = v.step_fb.select("response_id", "step_index", "user_id", "action", "id")
    return files.upserted(old, old.filter("response_id % 6 = 0").withColumn("action", F.lit("ACCEPT")), ["response_id", "step_index", "user_id"], "id")


def _queries(v):
    return v.orders.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") + 1).alias("parent_query_id"))


_RUN = """SELECT r.query_id, r.response_id, r.thread_id, t.trace_id FROM run_log r LEFT JOIN (SELECT thread_id, min(trace_id) AS trace_id FROM exec_logs GROUP BY thread_id) t ON t.thread_id = r.thread_id"""
_ASKED = "SELECT query_id, 'question ' || variant AS text, CASE WHEN query_id % 3 = 0 THEN NULL ELSE 'dev' || CAST(query_id % 3 AS VARCHAR(9)) END AS device FROM run_log WHERE query_id % 10 <> 0"
_TEXTS = "SELECT c.id, c.document_id, c.section_header, c.has_safety_content, l.text FROM chunks c LEFT JOIN leaves l ON l.id = c.id"
_CONTEXT = "SELECT response_id, thread_id, 'dev' || CAST(response_id % 3 AS VARCHAR(9)) AS device FROM run_log"
_STEP_ROWS = """SELECT l_orderkey AS response_id, l_linenumber - 1 AS step_index, CASE WHEN l_partkey % 4 = 0 THEN l_suppkey ELSE -1 - l_suppkey % 2 END AS user_id,
  CASE WHEN l_tax = 0 THEN '  ' ELSE ' ' || CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'N' THEN 'Modify' ELSE 'INCORRECT' END END AS action,
  CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE ' fix ' || CAST(l_partkey % 7 AS VARCHAR(9)) || ' ' END AS correction_text, CASE WHEN l_discount = 0 THEN '' ELSE l_linestatus END AS severity,
  l_partkey * 10000000 + l_suppkey * 1000 + CAST(floor(l_quantity) AS BIGINT) AS place FROM lineitem"""
_STEP_OLD = "SELECT response_id, step_index, user_id, response_id % 100 AS thread_id, 'old' AS device, 'C1' AS category, action, 'was' AS correction_text, 'high' AS severity, weight FROM step_fb"
_ANSWER_ROWS = """SELECT l_orderkey AS response_id, CASE WHEN l_linenumber % 2 = 0 THEN o_custkey ELSE -1 - l_suppkey % 2 END AS user_id,
  CASE WHEN l_tax = 0 THEN '' WHEN l_returnflag = 'A' THEN 'thumbs_up' ELSE ' THUMBS_DOWN ' END AS feedback_type, CASE WHEN l_partkey % 2 = 0 THEN ' ' ELSE 'correct' END AS correctness,
  CASE WHEN l_partkey % 5 < 2 THEN '' ELSE ' partial' END AS completeness, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'safe' END AS safety_assessment,
  CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE ' see ' || CAST(l_partkey % 7 AS VARCHAR(9)) || ' ' END AS note, l_partkey * 10000000 + l_suppkey * 1000 + l_linenumber * 100 + CAST(floor(l_quantity) AS BIGINT) AS place
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
_ANSWER_OLD = "SELECT response_id, user_id, response_id % 100 AS thread_id, 'old' AS device, 'C1' AS category, feedback_type, 'was' AS correction_text, weight FROM resp_fb"
_ASK = """SELECT p_partkey AS position, 'M' || CAST(p_partkey % 3 AS VARCHAR(9)) AS source, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'part_replacement' ELSE 'operational_anomaly' END AS observation_type,
  CASE WHEN p_partkey % 17 <> 0 THEN p_brand || '/' || CAST(p_size % 9 AS VARCHAR(9)) END AS system, p_size % 6 = 0 AS is_obscure FROM part"""


def _step_rows(v):
    return files.verdict_rows(v.sql(_STEP_ROWS), ["response_id", "step_index", "user_id"], "action", "place")


def _answer_rows(v):
    rows = files.verdict_rows(v.sql(_ANSWER_ROWS), ["response_id", "user_id"], "feedback_type", "place")
    return rows.withColumn("correction_text", annotation.correction_text("correctness", "completeness", "safety_assessment", "note"))


def _expected(v):
    return annotation.labelled(v.sql(_ASK), {"M1": "first", "M2": "second"}, ["Brand#1/3", "Brand#2/4", "Brand#3/5"])


_GIVEN = f"""g AS (SELECT response_id, step_index, user_id, upper(trim(action)) AS action, nullif(trim(correction_text), '') AS correction_text, nullif(trim(severity), '') AS severity
  FROM (SELECT *, row_number() OVER (PARTITION BY response_id, step_index, user_id ORDER BY place DESC) AS n FROM ({_STEP_ROWS}) WHERE trim(action) <> '') WHERE n = 1), c AS ({_CONTEXT})"""
_EXPECTED = f"""ex AS (SELECT *, coalesce(system, '') AS s, coalesce(system IN ('Brand#1/3', 'Brand#2/4', 'Brand#3/5'), false) AS safe, row_number() OVER (ORDER BY position) AS n FROM ({_ASK}))"""

_SEED = T.StructType([T.StructField("document_id", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("section_header", T.StringType()), T.StructField("text", T.StringType())])


def _seed_load(v):
    """All documents are loaded as they are, then every third with other headings, twice."""
    base = f"{tables.shared_folder(v.spark)}/seed-{uuid.uuid4().hex}"
    whole = v.leaves.select("document_id", "doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("section_header")).alias("section_header"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise("").alias("text"))
    some = whole.filter("document_id % 3 = 0 and doc_id % 7 <> 0").withColumn("section_header", F.lit('new, "quoted"\n heading '))
    for rows, name in ((whole, "whole"), (some, "some"), (some, "some")):
        tables.write_seed(rows, f"{base}/{name}")
        tables.load_seed(v.spark, f"{base}/{name}", _SEED, "document_id", f"{base}/table")
    return tables.seeded_table(v.spark, f"{base}/table", _SEED).select("document_id", "doc_id", "section_header", F.sha2("text", 256).alias("text_sha256"))


PLANS = [
    ("src2_seed_load", _seed_load, """
WITH w AS (SELECT document_id, doc_id, CASE WHEN doc_id % 5 <> 0 THEN section_header END AS section_header, sha256(CASE WHEN doc_id % 9 <> 0 THEN text ELSE '' END) AS text_sha256 FROM leaves)
SELECT document_id, doc_id, CASE WHEN document_id % 3 = 0 THEN 'new, "quoted"' || chr(10) || ' heading ' ELSE section_header END AS section_header, text_sha256
FROM w WHERE document_id % 3 <> 0 OR doc_id % 7 <> 0"""),
    ("src1_unknown_values", lambda v: tables.unknown_values(v.docs.unionByName(v.docs.withColumn("status", F.lit("LOST"))), "status"), """
SELECT status AS value, count(*) AS n, status IN ('PENDING', 'PROCESSING', 'READY', 'FAILED') AS is_allowed FROM (SELECT status FROM docs UNION ALL SELECT 'LOST' FROM docs) GROUP BY 1"""),
    ("src2_replace_rows", lambda v: tables.replace_rows(v.chunks.select("document_id", "id"), v.chunks.filter("document_id % 3 = 0 and level = 0").select("document_id", F.concat("id", F.lit("-new")).alias("id")), "document_id"), """
SELECT document_id, id FROM chunks WHERE document_id % 3 <> 0 UNION ALL SELECT document_id, id || '-new' FROM chunks WHERE document_id % 3 = 0 AND level = 0"""),
    ("src3_usable_runs", lambda v: files.usable_runs(v.run_log.withColumn("expected_variant", F.when(F.col("query_id") % 5 == 0, "").otherwise(F.col("variant"))).withColumn("response_id", F.when(F.col("query_id") % 13 == 0, "timeout").otherwise(F.col("response_id").cast("string")))).select("query_id", "variant"), """
SELECT query_id, coalesce(nullif(actual_variant, ''), CASE WHEN query_id % 5 = 0 THEN NULL ELSE variant END, 'unknown') AS variant FROM run_log WHERE query_id % 13 <> 0"""),
    ("src4_response_sheet_rows", lambda v: files.verdict_rows(_sheet(v).drop("step_index"), ["response_id"], "verdict", "place"), f"""
WITH {_SHEET} SELECT response_id, verdict, severity, place FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY place DESC) AS n FROM sh WHERE verdict IS NOT NULL) WHERE n = 1"""),
    ("src5_step_sheet_rows", lambda v: files.verdict_rows(_sheet(v), ["response_id", "step_index"], "verdict", "place"), f"""
WITH {_SHEET} SELECT response_id, step_index, verdict, severity, place FROM (SELECT *, row_number() OVER (PARTITION BY response_id, step_index ORDER BY place DESC) AS n FROM sh WHERE verdict IS NOT NULL) WHERE n = 1"""),
    ("src6_report_envelope", lambda v: to_envelope(xl.completeness(_resolved(v)).select("completeness"), "provenance_completeness", None, "completeness").select("metric_name", "value"), f"""
WITH {_RESOLVED} SELECT 'provenance_completeness' AS metric_name, round(count(*) FILTER (WHERE has_chunk AND has_manifest) / CAST(count(*) AS DOUBLE), 4) AS value FROM f"""),
    ("src7_response_sheet", lambda v: files.response_sheet(v.plans), "SELECT thread_id, turn, left(text, 5000) AS text, '' AS verdict FROM plans"),
    ("src8_step_sheet", lambda v: files.step_sheet(v.plans, _refs(v)), """
WITH s AS (SELECT thread_id, turn, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM plans), e AS (SELECT thread_id, turn, unnest(range(len(l))) AS i, l FROM s UNION ALL SELECT thread_id, turn, 0, [NULL] FROM s WHERE len(l) = 0),
r AS (SELECT response_id AS thread_id, step_index, string_agg(DISTINCT chunk_id, ';' ORDER BY chunk_id) AS refs FROM links WHERE step_index IS NOT NULL GROUP BY 1, 2)
SELECT e.thread_id, turn, CAST(i AS INT) AS step_index, left(l[i + 1], 2000) AS step_text, coalesce(refs, '') AS chunk_refs FROM e LEFT JOIN r ON r.thread_id = e.thread_id AND r.step_index = i"""),
    ("src9_pseudonyms", lambda v: files.pseudonyms(v.exec_logs, "trace_id", "id", "trace"), """
WITH f AS (SELECT trace_id, min(id) AS first_id FROM exec_logs GROUP BY 1), n AS (SELECT trace_id, row_number() OVER (ORDER BY first_id, trace_id) AS n FROM f)
SELECT trace_id, 'trace-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS pseudonym FROM n"""),
    ("src10_row_counts", lambda v: tables.row_counts({"chunks": v.chunks, "evals": v.evals, "links": v.links}), "SELECT 'chunks' AS table_name, count(*) AS n FROM chunks UNION ALL SELECT 'evals', count(*) FROM evals UNION ALL SELECT 'links', count(*) FROM links"),
    ("src11_session_kinds", lambda v: files.session_kinds(v.sql(_RUNS), v.exec_logs), f"""
WITH u AS ({_RUNS}), p AS (SELECT DISTINCT thread_id FROM exec_logs WHERE {_T} = 'RepairPlanner')
SELECT CASE WHEN response_id IS NOT NULL AND thread_id IN (SELECT thread_id FROM p) THEN 'evaluable' WHEN gate_rejected OR response_id IS NULL THEN 'gate_rejected' WHEN ends_with(trace_variant, 'deterministic_exit') THEN 'deterministic_exit' ELSE 'other' END AS kind,
  count(*) AS sessions FROM u GROUP BY 1"""),
    ("src12_evidence", lambda v: files.evidence(v.evals, v.links, v.chunks), """
WITH e AS (SELECT response_id, arg_max(badge, id) AS badge, count(*) AS attempts FROM evals GROUP BY 1), l AS (SELECT response_id, count(*) AS links, count(*) FILTER (WHERE has_safety_content) AS safety_links, string_agg(DISTINCT chunk_id, ';' ORDER BY chunk_id) AS chunk_ids
  FROM links JOIN chunks c ON c.id = chunk_id GROUP BY 1) SELECT * FROM e LEFT JOIN l USING (response_id)"""),
    ("src12_log_rows", lambda v: annotation.log_rows(v.sql(_RUN), v.exec_logs), f"""
SELECT response_id, CAST(row_number() OVER (PARTITION BY response_id ORDER BY started_ms, id) AS INT) AS place, node_name, operation_type, latency_ms, left(metadata, 500) AS meta_summary FROM ({_RUN}) r JOIN exec_logs l ON l.trace_id = r.trace_id"""),
    ("src12_linked_chunks", lambda v: annotation.linked_chunks(v.sql(_RUN), v.links, v.sql(_TEXTS)), f"""
SELECT response_id, k.id AS link_id, chunk_id, left(coalesce(text, ''), 500) AS preview, document_id, section_header, has_safety_content, step_index FROM links k JOIN ({_TEXTS}) t ON t.id = k.chunk_id WHERE response_id IN (SELECT response_id FROM run_log)"""),
    ("src12_bundle", lambda v: annotation.bundle(v.sql(_RUN), v.sql(_ASKED), v.evals, v.exec_logs, v.links, v.sql(_TEXTS)), f"""
WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY id DESC) AS n FROM evals) WHERE n = 1)
SELECT r.query_id, r.response_id, r.thread_id, r.trace_id, coalesce(q.text, 'MISSING: ' || r.query_id) AS query_text, coalesce(q.device, 'unknown') AS device, badge, sync_faithfulness, sync_answer_relevance, sync_context_relevance, sync_completeness,
  (SELECT count(*) FROM exec_logs l WHERE l.trace_id = r.trace_id) AS log_rows, (SELECT count(*) FROM links k JOIN chunks c ON c.id = k.chunk_id WHERE k.response_id = r.response_id) AS chunks_retrieved,
  (SELECT count(*) FROM links k JOIN chunks c ON c.id = k.chunk_id WHERE k.response_id = r.response_id AND c.has_safety_content) AS safety_chunks
FROM ({_RUN}) r LEFT JOIN ({_ASKED}) q ON q.query_id = r.query_id LEFT JOIN e ON e.response_id = r.response_id"""),
    ("src13_system_counts", lambda v: annotation.system_counts(v.sql(_ASK)), f"SELECT system, count(*) AS n, count(*) > 4 AS is_over_cap FROM ({_ASK}) GROUP BY 1"),
    ("src13_safety_counts", lambda v: annotation.safety_counts(_expected(v)), f"""
WITH {_EXPECTED} SELECT count(*) FILTER (WHERE safe) AS expected, count(*) FILTER (WHERE NOT safe) AS not_expected, CASE WHEN count(*) FILTER (WHERE safe) >= 6 THEN 'OK' ELSE 'BELOW MIN' END AS state FROM ex"""),
    ("src15_step_import", lambda v: annotation.imported(v.sql(_STEP_OLD), _step_rows(v), v.sql(_CONTEXT), ["response_id", "step_index", "user_id"], ["action", "correction_text", "severity"]), f"""
WITH {_GIVEN}, k AS (SELECT g.*, thread_id, device FROM g JOIN c USING (response_id)), o AS ({_STEP_OLD})
SELECT response_id, step_index, user_id, o.thread_id, o.device, o.category, coalesce(k.action, o.action) AS action, CASE WHEN k.action IS NULL THEN o.correction_text ELSE k.correction_text END AS correction_text, CASE WHEN k.action IS NULL THEN o.severity ELSE k.severity END AS severity, o.weight
FROM o LEFT JOIN k USING (response_id, step_index, user_id)
UNION ALL SELECT response_id, step_index, user_id, thread_id, device, 'GENERAL', action, correction_text, severity, 1.0e0 FROM k ANTI JOIN o USING (response_id, step_index, user_id)"""),
    ("src15_response_import", lambda v: annotation.imported(v.sql(_ANSWER_OLD), _answer_rows(v), v.sql(_CONTEXT), ["response_id", "user_id"], ["feedback_type", "correction_text"]), f"""
WITH w AS (SELECT *, upper(trim(feedback_type)) AS ft FROM ({_ANSWER_ROWS}) WHERE trim(feedback_type) <> ''), c AS ({_CONTEXT}), o AS ({_ANSWER_OLD}),
k AS (SELECT response_id, user_id, ft, nullif(trim(concat_ws('; ', 'correctness=' || nullif(trim(correctness), ''), 'completeness=' || nullif(trim(completeness), ''), 'safety=' || nullif(trim(safety_assessment), ''), nullif(trim(note), ''))), '') AS t, thread_id, device
  FROM (SELECT *, row_number() OVER (PARTITION BY response_id, user_id ORDER BY place DESC) AS n FROM w) JOIN c USING (response_id) WHERE n = 1)
SELECT response_id, user_id, o.thread_id, o.device, o.category, coalesce(k.ft, o.feedback_type) AS feedback_type, CASE WHEN k.ft IS NULL THEN o.correction_text ELSE k.t END AS correction_text, o.weight FROM o LEFT JOIN k USING (response_id, user_id)
UNION ALL SELECT response_id, user_id, thread_id, device, 'GENERAL', ft, t, 1.0e0 FROM k ANTI JOIN o USING (response_id, user_id)"""),
    ("src15_import_counts", lambda v: annotation.import_counts(_step_rows(v), v.sql(_CONTEXT), "action"), f"""
WITH {_GIVEN} SELECT user_id, count(*) FILTER (WHERE known) AS imported, count(*) FILTER (WHERE known AND action IN ('MODIFY', 'INCORRECT')) AS corrections, count(*) FILTER (WHERE NOT known) AS skipped
FROM (SELECT *, response_id IN (SELECT response_id FROM c) AS known FROM g) GROUP BY 1"""),
    ("src17_expectations", _expected, f"""
WITH {_EXPECTED} SELECT 'EQ-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id, position, CASE source WHEN 'M1' THEN 'first' WHEN 'M2' THEN 'second' END AS device,
  CASE observation_type WHEN 'part_replacement' THEN 'replace_part' ELSE 'troubleshoot' END AS expected_intent, CASE WHEN is_obscure THEN 3 WHEN observation_type = 'part_replacement' THEN 5 ELSE 4 END AS expected_variant, safe AS safety_expected,
  CASE WHEN is_obscure THEN 'Variant #3 — obscure system (' || s || '), expecting troubleshoot short-circuit' WHEN observation_type = 'part_replacement' THEN 'Full replace_part path — ' || s ELSE 'Full troubleshoot path — ' || s END
  || CASE WHEN safe THEN '; should retrieve safety procedures' ELSE '' END AS notes FROM ex"""),
    ("src13_coverage_report", lambda v: files.coverage_report(_corpus(v)), f"WITH {_CORPUS} SELECT origin, observation_type, count(*) AS n FROM co GROUP BY CUBE (origin, observation_type)"),
    ("src13_against_minimum", lambda v: files.against_minimum(_corpus(v), _minimum(v)), f"""
WITH {_CORPUS}, n AS (SELECT variant, count(*) AS n FROM co GROUP BY 1), m AS (SELECT p_name AS variant, max(p_size) AS least FROM part GROUP BY 1) SELECT variant, least, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= least THEN 'OK' ELSE 'BELOW MIN' END AS state FROM m LEFT JOIN n USING (variant)"""),
    ("src14_earliest", lambda v: files.earliest(v.exec_logs.select("thread_id", "id", "node_name"), "thread_id", "id"), "SELECT thread_id, min(id) AS id, arg_min(node_name, id) AS node_name FROM exec_logs GROUP BY 1"),
    ("src15_upsert", _upsert, "SELECT response_id, step_index, user_id, CASE WHEN response_id % 6 = 0 THEN 'ACCEPT' ELSE action END AS action, id FROM step_fb"),
    ("src16_run_plan", lambda v: files.run_plan(_queries(v), v.run_log.select("query_id", "thread_id")), """
SELECT o_orderkey AS query_id, p.thread_id, CASE WHEN o_orderkey % 4 = 0 AND p.thread_id IS NULL THEN 'FAIL' ELSE 'RUN' END AS status FROM orders LEFT JOIN run_log p ON o_orderkey % 4 = 0 AND p.query_id = o_orderkey + 1
WHERE o_orderkey NOT IN (SELECT query_id FROM run_log)"""),
    ("src17_labelled", lambda v: files.labelled(_corpus(v), v.part.groupBy(F.col("p_type").alias("observation_type")).agg(F.upper(F.min("p_type")).alias("intent")), ["Brand#1", "Brand#2"]), f"""
WITH {_CORPUS} SELECT 'EQ-' || CASE WHEN query_no < 100 THEN lpad(CAST(query_no AS VARCHAR), 3, '0') ELSE CAST(query_no AS VARCHAR) END AS id, upper(observation_type) AS intent, system IN ('Brand#1', 'Brand#2') AS safety_expected FROM co"""),
]
