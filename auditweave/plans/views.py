"""Audit tables derived from the given parquet tables.

Each view is one SELECT that Spark and DuckDB both run (LIST(...) and DIV are the only spellings that differ),
so a query and its oracle stand on the same rows. `Views` gives the Spark DataFrames; `with_views` puts the
views that a SQL text names before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The nodes of the process model and those that may follow each.
MODEL = {
    "START": ("IntentRouter",),
    "IntentRouter": ("UnsafeMethodGate", "DeterministicRuleChecker", "FollowUpResponder"),
    "UnsafeMethodGate": ("DeterministicRuleChecker", "FollowUpResponder"),
    "DeterministicRuleChecker": ("SymptomAnalyzer", "DirectReplacementAnalyzer", "END"),
    "SymptomAnalyzer": ("KnowledgeRetriever",),
    "DirectReplacementAnalyzer": ("KnowledgeRetriever",),
    "KnowledgeRetriever": ("RootCauseAnalyzer", "SafetyExtractor"),
    "RootCauseAnalyzer": ("SafetyExtractor", "END"),
    "SafetyExtractor": ("RepairPlanner",),
    "RepairPlanner": ("SafetyJudgeGate",),
    "SafetyJudgeGate": ("InlineEvaluator", "RepairPlanner", "END"),
    "FollowUpResponder": ("InlineEvaluator",),
    "InlineEvaluator": ("END",),
}
MODEL_EDGES = tuple((src, dst) for src, after in MODEL.items() for dst in after)
_EDGES = " UNION ALL ".join(f"SELECT '{a}' AS src, '{b}' AS dst" for a, b in MODEL_EDGES)

VIEWS = {
    "docs": """
        SELECT id, 'manual' AS doc_type, CASE WHEN id % 7 = 6 THEN 'FAILED' ELSE 'READY' END AS status,
               CASE WHEN id % 2 = 0 THEN NULL ELSE LIST('dev' || CAST(id % 3 AS VARCHAR(9)), 'any') END AS compatible_models,
               'hash' || CAST(id % 15 AS VARCHAR(9)) AS file_hash
        FROM (SELECT DISTINCT CAST(substr(source, 4) AS INT) AS id FROM documents)""",
    "vectors": "SELECT vec_id, embedding, label FROM embeddings",
    "leaves": """
        SELECT d.doc_id, 'L0-' || CAST(d.doc_id AS VARCHAR(19)) AS id, CAST(substr(d.source, 4) AS INT) AS document_id, 0 AS level, d.lang AS section_header,
               CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS INT) AS sequence_index,
               CAST((row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1) DIV 5 AS INT) AS page_start,
               coalesce(l.toxic, 0) = 1 AS has_safety_content, coalesce(l.quality, 1) = 0 AS is_blacklisted,
               CASE WHEN d.doc_id % 50 = 0 THEN 'L1-none' ELSE 'L1-' || d.source || '-' || d.lang END AS parent_id,
               d.text, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.doc_id % 4 END AS n_signals, d.source
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "nodes": """
        SELECT doc_id, id, document_id, level, section_header, sequence_index, page_start, has_safety_content, is_blacklisted, parent_id, n_signals FROM leaves
        UNION ALL
        SELECT min(doc_id) + 1, 'L1-' || source || '-' || section_header, min(document_id), 1, section_header, NULL, CAST(min(page_start) AS INT), false, false, 'L2-' || source, NULL
        FROM leaves GROUP BY source, section_header
        UNION ALL
        SELECT min(doc_id) + 2, 'L2-' || source, min(document_id), 2, 'all', NULL, NULL, false, false, NULL, NULL FROM leaves GROUP BY source""",
    "chunks": """
        SELECT n.doc_id, n.id, n.document_id, n.level, n.section_header, n.sequence_index, n.page_start, n.has_safety_content, n.is_blacklisted, n.parent_id, n.n_signals,
               CASE WHEN n.doc_id % 23 = 0 THEN NULL ELSE v.embedding END AS embedding
        FROM nodes n LEFT JOIN vectors v ON v.vec_id = n.doc_id""",
    "tree_edges": """
        SELECT document_id, parent_id AS parent, id AS child FROM nodes WHERE parent_id IS NOT NULL AND (level > 0 OR doc_id % 7 <> 0)""",
    "manifest": """
        SELECT CAST(id * 3 + k AS BIGINT) AS entry_sequence, id AS document_id, CASE k WHEN 0 THEN 'registered' WHEN 1 THEN 'chunk_created' ELSE 'embedding_generated' END AS entry_type,
               CASE k WHEN 1 THEN n - id % 3 END AS total_chunks,
               CASE k WHEN 0 THEN '{"filename": "' || CAST(id AS VARCHAR(9)) || '.pdf"}' WHEN 1 THEN '{"overlap": 200, "size": 1000, "total": ' || CAST(n - id % 3 AS VARCHAR(19)) || '}'
                      ELSE '{"dimension": 64, "model": "m' || CAST(id % 2 AS VARCHAR(9)) || '"}' END AS entry_json,
               1704067200 + 3600 * (id * 3 + k) AS created_s
        FROM (SELECT document_id AS id, count(*) AS n FROM nodes GROUP BY document_id) CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2)
        WHERE id % 9 <> 8""",
    "links": """
        SELECT CAST(l_orderkey AS VARCHAR(19)) || '-' || CAST(l_partkey AS VARCHAR(19)) || '-' || CAST(l_suppkey AS VARCHAR(19)) || '-' || CAST(l_linenumber AS VARCHAR(9)) AS id,
               l_orderkey AS response_id,
               'L0-' || CAST(l_partkey % (n * 51 DIV 50) AS VARCHAR(19)) AS chunk_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber - 1 END AS step_index,
               CASE l_returnflag WHEN 'A' THEN 'verbatim' WHEN 'N' THEN 'paraphrased' ELSE 'synthesized' END AS grounding_label,
               1 - l_discount AS similarity_score, CAST(floor(l_tax * 100 + 0.5) AS INT) AS reranker_score
        FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM documents)""",
    "evals": """
        SELECT o_orderkey * 2 AS id, o_orderkey AS response_id, o_custkey AS thread_id, 1 AS attempt_number,
               CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'P' THEN 'yellow' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'gray' ELSE 'red' END END AS badge,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 7 % 101) / 100.0e0 END AS sync_faithfulness,
               CASE WHEN o_orderkey % 13 = 1 THEN NULL ELSE (o_orderkey * 11 % 101) / 100.0e0 END AS sync_answer_relevance,
               CASE WHEN o_orderkey % 13 = 2 THEN NULL ELSE (o_orderkey * 17 % 101) / 100.0e0 END AS async_faithfulness,
               CASE WHEN o_orderkey % 13 = 3 THEN NULL ELSE (o_orderkey * 19 % 101) / 100.0e0 END AS async_answer_relevance,
               CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderkey % 8 AS INT) END AS n_verdicts, CAST(o_orderkey % 29 AS INT) AS async_delay_s,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey * 31 % 101) / 100.0e0 END AS sync_context_relevance, CASE WHEN o_orderkey % 5 = 1 THEN (o_orderkey * 37 % 101) / 100.0e0 END AS async_context_relevance,
               (o_orderkey * 41 % 101) / 100.0e0 AS sync_completeness, CAST(NULL AS DOUBLE) AS async_completeness
        FROM orders
        UNION ALL
        SELECT o_orderkey * 2 + 1, o_orderkey, o_custkey, 2, CASE WHEN o_orderkey % 3 = 0 THEN 'green' ELSE 'yellow' END,
               (o_orderkey * 23 % 101) / 100.0e0, (o_orderkey * 29 % 101) / 100.0e0, NULL, NULL, CAST(o_orderkey % 8 AS INT), CAST(o_orderkey % 29 AS INT), NULL, NULL, NULL, NULL
        FROM orders WHERE o_orderkey % 10 = 0""",
    "threads": """
        SELECT c_custkey AS id, 'dev' || CAST(c_nationkey % 3 AS VARCHAR(9)) AS device, c_acctbal < 0 AS is_escalated,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'COMPLETED' WHEN 'MACHINERY' THEN 'ABANDONED' ELSE 'ACTIVE' END AS state,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'APPROVED' WHEN 'HOUSEHOLD' THEN 'PENDING' ELSE 'NONE' END AS review_state, c_name AS title,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE lower(c_name) || CASE c_custkey % 5 WHEN 0 THEN '_a' WHEN 1 THEN '%b' WHEN 2 THEN chr(92) || 'c' ELSE '' END || '@Mail' || CAST(c_custkey % 40 AS VARCHAR(9)) || '.org' END AS email,
               CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS INT) END AS risk_tier, 1704067200 + c_custkey * 7919 % 86400 AS created_s
        FROM customer""",
    "flags": """
        SELECT o_orderkey AS id, o_custkey AS thread_id, CASE WHEN o_orderkey % 3 = 0 THEN 'AUTO_SAFETY' WHEN o_orderkey % 3 = 1 THEN 'AUTO_EVAL' ELSE 'MANUAL' END AS reason,
               CASE WHEN o_orderkey % 4 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS status
        FROM orders""",
    "model_edges": _EDGES,
    "exec_paths": """
        SELECT event_id, user_id, event_type, value, CAST(user_id AS VARCHAR(19)) || '-' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR(10)) AS trace_id,
               CASE (user_id * 5 + CAST(extract(day FROM date_trunc('week', ts)) AS BIGINT)) % 9
                    WHEN 0 THEN 'IntentRouter FollowUpResponder InlineEvaluator'
                    WHEN 1 THEN 'IntentRouter DeterministicRuleChecker'
                    WHEN 2 THEN 'IntentRouter DeterministicRuleChecker DirectReplacementAnalyzer KnowledgeRetriever SafetyExtractor RepairPlanner SafetyJudgeGate InlineEvaluator'
                    WHEN 3 THEN 'IntentRouter DeterministicRuleChecker SymptomAnalyzer KnowledgeRetriever RootCauseAnalyzer'
                    WHEN 4 THEN 'IntentRouter DeterministicRuleChecker SymptomAnalyzer KnowledgeRetriever RootCauseAnalyzer SafetyExtractor RepairPlanner SafetyJudgeGate InlineEvaluator'
                    WHEN 5 THEN 'IntentRouter DeterministicRuleChecker SymptomAnalyzer KnowledgeRetriever SafetyExtractor RepairPlanner SafetyJudgeGate RepairPlanner SafetyJudgeGate InlineEvaluator'
                    WHEN 6 THEN 'IntentRouter UnsafeMethodGate DeterministicRuleChecker SymptomAnalyzer KnowledgeRetriever SafetyExtractor RepairPlanner SafetyJudgeGate InlineEvaluator'
                    WHEN 7 THEN 'IntentRouter DeterministicRuleChecker SymptomAnalyzer KnowledgeRetriever SafetyExtractor RepairPlanner SafetyJudgeGate InlineEvaluator RepairPlanner SafetyJudgeGate InlineEvaluator'
                    ELSE 'IntentRouter UnsafeMethodGate FollowUpResponder' END AS path,
               CAST(row_number() OVER (PARTITION BY user_id, date_trunc('week', ts), event_id % 4 = 2 ORDER BY event_id) AS INT) AS place
        FROM events""",
    "exec_logs": """
        SELECT event_id AS id, user_id AS thread_id, trace_id,
               CASE WHEN event_id % 4 = 2 THEN CASE event_id % 3 WHEN 0 THEN 'route_from_knowledge' WHEN 1 THEN 'edge:route_from_safety_judge' ELSE CASE WHEN event_id % 5 < 2 THEN 'edge:route_from_intent' ELSE 'edge:route_from_inline_evaluator' END END
                    WHEN event_id % 61 = 0 THEN CASE event_type WHEN 'view' THEN 'SymptomAnalyzer' WHEN 'click' THEN 'RootCauseAnalyzer' ELSE 'health_dispatch' END
                    ELSE split_part(path, ' ', CAST(least(place, length(path) - length(replace(path, ' ', '')) + 1) AS INT)) END || CASE WHEN event_id % 9 = 0 AND event_id % 4 <> 2 THEN ':sub' ELSE '' END AS node_name,
               CASE event_id % 4 WHEN 0 THEN 'llm_call' WHEN 1 THEN 'node' WHEN 2 THEN 'edge_decision' ELSE 'node' END AS operation_type,
               event_id * 1000 AS started_ms, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id * 1000 + CAST(floor(value) AS BIGINT) END AS completed_ms,
               CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(floor(value * 1000) AS BIGINT) END AS latency_ms,
               CASE WHEN event_id % 53 = 0 THEN NULL ELSE '{"retrieved_chunk_ids": ["L0-' || CAST(event_id * 13 % 1050 AS VARCHAR(19)) || '", "L0-' || CAST(event_id * 7 % 990 AS VARCHAR(19)) || '"], '
                    || CASE event_id % 5 WHEN 0 THEN '"intent": "Troubleshoot", ' WHEN 1 THEN '"intent": "replace_part", ' WHEN 2 THEN '"intent": "procedural", ' WHEN 3 THEN '"intent": "chat", ' ELSE CASE WHEN event_id % 7 = 0 THEN '' ELSE '"intent": "chat", ' END END
                    || CASE event_id % 6 WHEN 0 THEN '"target": "skip_safety_eval", ' WHEN 1 THEN '' ELSE '"target": "safety_extractor", ' END
                    || CASE event_id % 11 WHEN 0 THEN '"decision": "FollowUpResponder", ' WHEN 1 THEN '' ELSE CASE WHEN event_id % 11 < 7 THEN '"decision": "RepairPlanner", ' ELSE '"decision": "InlineEvaluator", ' END END
                    || CASE WHEN event_id % 7 = 3 THEN '"attempt_number": 2, ' ELSE '' END || '"path_b": ' || CAST(event_id % 4 AS VARCHAR(19)) || ', "complement_count": ' || CAST(event_id % 3 AS VARCHAR(19)) || ', "retrieval_path": "'
                    || CASE event_id % 3 WHEN 0 THEN 'full_document' WHEN 1 THEN 'section' ELSE 'vector' END || '"}' END AS metadata, CAST(event_id * 7 % 900 AS INT) AS tokens, event_id % 40 = 0 AS is_retry,
               trace_id || CASE WHEN event_id % 20 = 0 THEN '-retry' ELSE '' END AS chain_id
        FROM exec_paths""",
    "meta_logs": """
        SELECT id, thread_id, trace_id, started_ms,
               CASE id % 13 WHEN 5 THEN 'edge:route_from_deterministic_check' WHEN 7 THEN 'SafetyExtractor' WHEN 9 THEN 'IntentRouter' WHEN 10 THEN 'UnsafeMethodGate' WHEN 11 THEN 'DeterministicRuleChecker' ELSE node_name END AS node_name,
               CASE WHEN id % 13 = 5 THEN 'edge_decision' WHEN id % 13 = 7 AND id % 3 <> 0 THEN 'node' ELSE operation_type END AS operation_type,
               CASE id % 20 WHEN 0 THEN NULL WHEN 1 THEN '{"retrieved_chunk_ids": null, "complement_count": 2, "path_b_count": null, "has_override": null, "classified_intent": null}'
                    WHEN 2 THEN '{"retrieved_chunk_ids": "L0-1", "complement_count": 1, "path_b_count": 0, "has_override": "true", "routing_decision": "chat"}'
                    WHEN 3 THEN '{"retrieved_chunk_ids": ["L0-1", "complement_count": ' WHEN 4 THEN '["retrieved_chunk_ids"]'
                    WHEN 5 THEN '{"retrieved_chunk_ids": [], "complement_count": null, "path_b_count": 4, "has_override": false, "rule_matched": false, "classified_intent": ""}'
                    WHEN 6 THEN '{"retrieved_chunk_ids": ["L0-3", null, "L0-999999999"], "path_b_count": 3, "has_override": "yes", "is_procedural": true, "rule_matched": true}'
                    ELSE '{"retrieved_chunk_ids": ["L0-' || CAST(id * 13 % 1050 AS VARCHAR(19)) || '", "L0-' || CAST(id * 7 % 990 AS VARCHAR(19)) || '"], "complement_count": ' || CAST(id % 3 AS VARCHAR(19)) || ', "path_b_count": ' || CAST(id % 4 AS VARCHAR(19))
                         || ', "has_override": ' || CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END || ', "classified_intent": "' || CASE WHEN id % 2 = 0 THEN 'troubleshoot' ELSE 'chat' END || '", ' || CASE WHEN id % 7 = 0 THEN '' ELSE '"equipment_type": "pump", ' END
                         || '"is_procedural": ' || CASE WHEN id % 5 = 0 THEN 'true' ELSE 'false' END || ', "routing_decision": "chat", "reason": "r' || CAST(id % 6 AS VARCHAR(19)) || '", "redirect_to": ' || CASE WHEN id % 4 = 0 THEN 'null' ELSE '"manual"' END
                         || ', "rule_matched": ' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END || ', "rule_id": ' || CAST(id % 9 AS VARCHAR(19)) || ', "trigger_keywords": ["hot", "oil ' || CAST(id % 5 AS VARCHAR(19)) || '"], "override_response": "'
                         || repeat('stop the pump. ', CAST(id % 30 AS INT)) || '"}' END AS metadata
        FROM exec_logs""",
    "verdict_json": """
        SELECT id, response_id,
               CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN '{"faithful": true}' WHEN 2 THEN '[]' WHEN 3 THEN 'null' WHEN 4 THEN '[{"faithful": tr'
                    ELSE '[' || CASE id % 3 WHEN 0 THEN '{"step_id": "s0"}' WHEN 1 THEN '{"faithful": true}' ELSE '{"faithful": false, "step_index": 5}' END || ', {"faithful": ' || CASE WHEN id % 4 < 3 THEN 'true' ELSE 'false' END
                         || CASE WHEN id % 5 = 0 THEN ', "step_index": 0' WHEN id % 5 = 1 THEN ', "step_index": null' ELSE '' END || '}, ' || CASE id % 2 WHEN 0 THEN '"no object"' ELSE '{"faithful": null}' END
                         || CASE WHEN id % 8 < 5 THEN ', {"step_index": 7, "faithful": true}' ELSE '' END || ']' END AS step_verdicts,
               CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{"other": 1}' WHEN 2 THEN '{"step_cross_validation": null}' WHEN 3 THEN '{"step_cross_validation": {"agreement_rate": 1}}'
                    ELSE '{"step_cross_validation": {"verdicts": [{"step_index": 0, "faithful": ' || CASE WHEN id % 9 < 5 THEN 'true' ELSE 'null' END || '}, "no object", {"faithful": true}, {"step_index": 1' || CASE WHEN id % 6 = 0 THEN ', "faithful": false' ELSE '' END
                         || '}, {"step_index": 7, "faithful": false}' || CASE WHEN id % 10 < 4 THEN ', {"step_index": 0, "faithful": false}' ELSE '' END || ']}}' END AS async_evidence
        FROM evals""",
    "kb_entries": """
        SELECT doc_id AS entry_sequence, CAST(substr(source, 4) AS INT) AS document_id, CASE WHEN doc_id % 5 = 0 OR CAST(substr(source, 4) AS INT) % 9 = 7 THEN 'registered' ELSE 'chunk_created' END AS entry_type,
               1704067200 + 3600 * (doc_id * 7 % 50) AS created_s, CASE WHEN doc_id % 8 = 7 THEN NULL ELSE doc_id % 40 END AS total_chunks
        FROM documents WHERE CAST(substr(source, 4) AS INT) % 9 <> 8""",
    "kb_questions": """
        SELECT o_orderkey AS question_id, CAST(o_orderkey % 23 AS INT) AS document_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 1704063600 + 1800 * (o_orderkey % 120) END AS at_s FROM orders""",
    "step_fb": """
        SELECT response_id, step_index, user_id, min(action) AS action, min(correction_type) AS correction_type, min(weight) AS weight, bool_or(retracted) AS retracted, min(id) AS id
        FROM (SELECT l_orderkey AS response_id, l_linenumber - 1 AS step_index, l_suppkey AS user_id,
                     CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'INCORRECT' WHEN l_returnflag = 'R' THEN 'MODIFY' WHEN l_linestatus = 'O' THEN 'SKIP' ELSE 'ACCEPT' END AS action,
                     CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'WRONG_VALUE' WHEN 2 THEN 'MISSING_STEP' WHEN 3 THEN 'WRONG_SEQUENCE' WHEN 4 THEN 'SAFETY_VIOLATION' WHEN 5 THEN 'other' ELSE 'text' END AS correction_type,
                     CASE WHEN l_partkey % 19 = 0 THEN 0.0e0 ELSE 1 + l_tax END AS weight, l_quantity = 50 AS retracted, l_orderkey * 1000 + l_partkey % 1000 AS id
              FROM lineitem) GROUP BY response_id, step_index, user_id""",
    "resp_fb": """
        SELECT o_orderkey AS response_id, o_custkey AS user_id, CASE WHEN o_orderkey % 5 = 0 THEN 'UP' ELSE 'DOWN' END AS feedback_type, 1.0e0 AS weight,
               o_orderkey % 41 = 0 AS retracted, CASE o_orderkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' ELSE 'incorrect' END AS correctness, o_orderkey AS id
        FROM orders WHERE o_orderkey % 2 = 0""",
    "run_log": """
        SELECT o_orderkey AS query_id, o_orderkey AS response_id, o_custkey AS thread_id, o_orderpriority AS variant, o_orderkey % 2 = 0 AS safety_found, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms,
               CASE WHEN o_orderkey % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, o_orderkey % 9 <> 0 AS shadow_completed,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'troubleshoot' ELSE 'replace_part' END AS actual_intent,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'procedural' WHEN o_orderkey % 3 = 0 THEN 'troubleshoot' ELSE 'replace_part' END AS expected_intent,
               CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS actual_variant, CAST(o_orderkey % 12 AS INT) AS chunks_retrieved,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'green' WHEN o_orderkey % 4 = 2 THEN 'yellow' ELSE 'red' END AS badge,
               CASE o_orderkey % 5 WHEN 0 THEN 'troubleshoot_full' WHEN 1 THEN 'deterministic_override' ELSE 'direct_replacement' END AS trace_variant,
               CASE o_orderkey % 4 WHEN 0 THEN 'full_document' WHEN 1 THEN 'vector' WHEN 2 THEN 'full_manual' END AS retrieval_path, o_orderkey % 2 = 1 AS is_audited, CAST(floor(o_totalprice) AS BIGINT) DIV 3 AS stream_ms
        FROM orders WHERE o_orderkey % 3 <> 2""",
    "verdicts": """
        SELECT e.id AS eval_id, e.response_id, k AS step_index, (e.response_id + k) % 4 <> 0 AS inline_faithful, CASE WHEN (e.response_id + k) % 9 = 0 THEN NULL ELSE (e.response_id * 3 + k) % 5 <> 0 END AS shadow_faithful
        FROM evals e CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6)
        WHERE k < e.n_verdicts""",
    "plans": """
        SELECT conv_id AS thread_id, turn, text FROM conversations WHERE role = 'assistant'""",
    "protocols": """
        SELECT item_id, text FROM benchmark""",
    "query_vectors": "SELECT vec_id AS query_id, embedding AS query_vector, 'dev' || CAST(vec_id % 3 AS VARCHAR(9)) AS device FROM embeddings WHERE vec_id % 20 = 0",
}


def for_spark(sql: str) -> str:
    return sql.replace("LIST(", "array(").replace(" DIV ", " div ").replace("VARCHAR(9)", "STRING").replace("VARCHAR(10)", "STRING").replace("VARCHAR(19)", "STRING")


def for_duckdb(sql: str) -> str:
    return sql.replace("LIST(", "list_value(").replace(" DIV ", " // ")


def _names_in(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN|,)\s+{n}\b", sql)]


def with_views(sql: str) -> str:
    """`sql` for DuckDB, after the views that it names; it may itself start with WITH."""
    wanted: dict[str, None] = {}

    def add(text: str) -> None:
        for name in _names_in(text):
            if name not in wanted:
                add(VIEWS[name])
                wanted[name] = None

    add(sql)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in wanted]
    body = sql.strip()
    if m := re.match(r"WITH(\s+RECURSIVE)?\s+", body):
        return for_duckdb(f"WITH RECURSIVE {', '.join([*ctes, body[m.end():]])}")
    return for_duckdb((f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + body)


class Views:
    """The views as DataFrames; nothing is read until a query needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in TABLES else self.sql(VIEWS[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """A SELECT over views and tables."""
        found = {n for n in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", text) if n in VIEWS or n in TABLES}
        bound = for_spark(text).replace("{", "{{").replace("}", "}}")
        for n in sorted(found, key=len, reverse=True):
            bound = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}} AS {n}_view" if not re.search(rf"\b(?:FROM|JOIN)\s+{n}\s+(?!WHERE|GROUP|ORDER|CROSS|LEFT|JOIN|UNION|ON|USING|FULL|INNER)[A-Za-z]", bound) else rf"\1 {{{n}}}", bound)
        return self.spark.sql(bound, **{n: getattr(self, n) for n in found})


