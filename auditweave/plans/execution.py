from pyspark.sql import functions as F

from ..operators import execution as l2
from ..operators import review

_BASE = "split_part(node_name, ':', 1)"
_J = "json_extract_string(metadata, '$.{}')"
_META = "ml AS (SELECT *, CASE WHEN json_valid(metadata) THEN CAST(metadata AS JSON) END AS m FROM meta_logs)"
_M = "json_extract_string(m, '$.{}')"
_RATE = "SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) AS rate FROM (SELECT thread_id, bool_or({}) AS hit FROM exec_logs GROUP BY 1)"
_ROUTING = "SELECT count(*) AS total, count(*) FILTER (WHERE should = did) AS correct, count(*) FILTER (WHERE should AND NOT did) AS missed, count(*) FILTER (WHERE should = did) / CAST(count(*) AS DOUBLE) AS score FROM r"
_SAFETY = "('troubleshoot', 'replace_part', 'procedural')"


def _done(v):
    return v.exec_logs.filter("completed_ms is not null").groupBy("thread_id").agg(F.max("completed_ms").alias("done_s"))


def _shadow(v):
    return v.evals.filter("attempt_number = 1").select("thread_id", (F.col("id") * 20000 + F.col("async_delay_s")).alias("completed_s"), "badge")


def _patches(v):
    return v.evals.filter("response_id % 3 = 0 and attempt_number = 1").select("response_id", F.lit(0.5).alias("async_faithfulness"), F.when(F.col("response_id") % 2 == 0, 0.25).alias("async_answer_relevance"))


PLANS = [
    ("l2_1_logged_chunks", lambda v: l2.logged_chunks(v.meta_logs, v.chunks), f"""
WITH {_META}, i AS (SELECT DISTINCT unnest(from_json(json_extract(m, '$.retrieved_chunk_ids'), '["VARCHAR"]')) AS id FROM ml WHERE json_type(m, '$.retrieved_chunk_ids') = 'ARRAY')
SELECT count(*) AS logged, count(c.id) AS existing, count(*) - count(c.id) AS broken, round(coalesce(count(c.id) / CAST(nullif(count(*), 0) AS DOUBLE), 1.0), 4) AS score FROM i LEFT JOIN chunks c ON c.id = i.id"""),
    ("l2_2_required_nodes", lambda v: l2.required_nodes(v.exec_logs, ("KnowledgeRetriever", "RootCauseAnalyzer", "SafetyExtractor")), f"""
WITH s AS (SELECT thread_id, bool_or({_BASE} = 'KnowledgeRetriever') AS a, bool_or({_BASE} = 'RootCauseAnalyzer') AS b, bool_or({_BASE} = 'SafetyExtractor') AS c FROM exec_logs GROUP BY 1)
SELECT thread_id, concat_ws(',', CASE WHEN a THEN 'KnowledgeRetriever' END, CASE WHEN b THEN 'RootCauseAnalyzer' END, CASE WHEN c THEN 'SafetyExtractor' END) AS present,
  concat_ws(',', CASE WHEN NOT a THEN 'KnowledgeRetriever' END, CASE WHEN NOT b THEN 'RootCauseAnalyzer' END, CASE WHEN NOT c THEN 'SafetyExtractor' END) AS missing, (CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT)) / 3.0e0 AS score FROM s"""),
    ("l2_3_escalation_rate", lambda v: l2.escalation_rate(v.threads, v.flags), """
WITH r AS (SELECT is_escalated OR id IN (SELECT thread_id FROM flags WHERE reason IN ('AUTO_SAFETY', 'AUTO_EVAL')) AS hit FROM threads)
SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS escalated, count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) AS rate FROM r"""),
    ("l2_4_escalation_latency", lambda v: l2.escalation_latency(_done(v), _shadow(v), "badge"), """
WITH d AS (SELECT thread_id, max(completed_ms) AS done_s FROM exec_logs WHERE completed_ms IS NOT NULL GROUP BY 1), r AS (SELECT e.badge, e.id * 20000 + e.async_delay_s - done_s AS delay FROM evals e JOIN d USING (thread_id) WHERE attempt_number = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY badge ORDER BY delay) AS place, count(*) OVER (PARTITION BY badge) AS n FROM r WHERE delay >= 0)
SELECT badge, count(*) AS pairs, round(avg(delay), 2) AS mean, min(delay) AS least, max(delay) AS most, max(delay) FILTER (WHERE place = greatest(0, CAST(floor(n * 0.95e0) AS INT) - 1) + 1) AS p95 FROM p GROUP BY badge"""),
    ("l2_5_calibration_drift", lambda v: l2.calibration_drift(v.evals), f"""
WITH d AS ({" UNION ALL ".join(f"SELECT '{d}' AS dimension, count(sync_{d} - async_{d}) AS pairs, round(avg(sync_{d} - async_{d}), 4) AS drift FROM evals" for d in l2.DIMENSIONS)})
SELECT * FROM d UNION ALL SELECT 'overall', CAST(sum(pairs) AS BIGINT), round(avg(drift), 4) FROM d"""),
    ("l2_6_step_kappa", lambda v: l2.step_kappa(v.verdicts), """
WITH c AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE inline_faithful AND shadow_faithful) AS both_yes, count(*) FILTER (WHERE NOT inline_faithful AND NOT shadow_faithful) AS neither,
  count(*) FILTER (WHERE inline_faithful AND NOT shadow_faithful) AS inline_only, count(*) FILTER (WHERE NOT inline_faithful AND shadow_faithful) AS shadow_only FROM verdicts WHERE shadow_faithful IS NOT NULL),
p AS (SELECT *, ((both_yes + inline_only) * CAST(both_yes + shadow_only AS DOUBLE) + (neither + shadow_only) * CAST(neither + inline_only AS DOUBLE)) / (CAST(pairs AS DOUBLE) * pairs) AS pe FROM c)
SELECT pairs, both_yes AS "both", neither, inline_only, shadow_only, round(CASE WHEN pairs = 0 THEN 0.0 WHEN pe >= 1 THEN 1.0 ELSE ((both_yes + neither) / CAST(pairs AS DOUBLE) - pe) / (1 - pe) END, 6) AS kappa FROM p"""),
    ("l2_6_verdict_kappa", lambda v: l2.verdict_kappa(v.verdict_json), """
WITH b AS (SELECT id, step_verdicts AS sv, async_evidence AS ae FROM verdict_json WHERE CASE WHEN json_valid(step_verdicts) AND json_valid(async_evidence) THEN json_exists(async_evidence, '$.step_cross_validation') ELSE false END),
i AS (SELECT id, unnest(range(CAST(json_array_length(sv) AS BIGINT))) AS pos, sv FROM b WHERE json_type(sv) = 'ARRAY'), ix AS (SELECT id, pos, json_extract(sv, '$[' || pos || ']') AS x FROM i),
il AS (SELECT id, pos, CASE WHEN json_exists(x, '$.step_index') THEN CAST(json_extract_string(x, '$.step_index') AS INT) ELSE pos END AS own,
  CASE WHEN json_exists(x, '$.faithful') THEN coalesce(CAST(json_extract_string(x, '$.faithful') AS BOOLEAN), false) ELSE true END AS a FROM ix WHERE json_type(x) = 'OBJECT'),
s AS (SELECT id, unnest(range(CAST(json_array_length(ae, '$.step_cross_validation.verdicts') AS BIGINT))) AS pos, ae FROM b WHERE json_type(ae, '$.step_cross_validation.verdicts') = 'ARRAY'),
sx AS (SELECT id, pos, json_extract(ae, '$.step_cross_validation.verdicts[' || pos || ']') AS x FROM s),
so AS (SELECT id, CASE WHEN json_exists(x, '$.step_index') THEN CAST(json_extract_string(x, '$.step_index') AS INT) ELSE -1 END AS step, pos,
  CASE WHEN json_exists(x, '$.faithful') THEN CAST(json_extract_string(x, '$.faithful') AS BOOLEAN) ELSE true END AS f FROM sx WHERE json_type(x) = 'OBJECT'),
sl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, step ORDER BY pos DESC) AS n FROM so) WHERE n = 1),
r AS (SELECT a, CASE WHEN p.id IS NOT NULL THEN p.f ELSE q.f END AS b FROM il LEFT JOIN sl p ON p.id = il.id AND p.step = il.pos LEFT JOIN sl q ON q.id = il.id AND q.step = il.own),
c AS (SELECT count(*) AS steps, count(*) FILTER (WHERE a AND b) AS both_yes, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, count(*) FILTER (WHERE a AND NOT b) AS inline_only, count(*) FILTER (WHERE NOT a AND b) AS shadow_only FROM r WHERE b IS NOT NULL),
e AS (SELECT *, (both_yes + neither) / CAST(steps AS DOUBLE) AS o, ((both_yes + inline_only) * CAST(both_yes + shadow_only AS DOUBLE) + (neither + shadow_only) * CAST(neither + inline_only AS DOUBLE)) / (CAST(steps AS DOUBLE) * steps) AS pe FROM c)
SELECT steps, both_yes AS "both", neither, inline_only, shadow_only, round(o, 4) AS observed, round(pe, 4) AS expected, round(CASE WHEN pe >= 1 THEN 1.0 ELSE (o - pe) / (1 - pe) END, 4) AS kappa, (SELECT count(*) FROM b) AS evaluations FROM e"""),
    ("l2_7_routing_by_edges", lambda v: l2.routing_by_edges(v.exec_logs), f"""
WITH r AS (SELECT lower(coalesce({_J.format('intent')}, '')) IN {_SAFETY} AS should, coalesce({_J.format('target')} <> 'skip_safety_eval', true) AS did FROM exec_logs WHERE metadata IS NOT NULL AND node_name = 'route_from_knowledge') {_ROUTING}"""),
    ("l2_8_routing_by_nodes", lambda v: l2.routing_by_nodes(v.exec_logs, ("SafetyExtractor", "SafetyEvaluator")), f"""
WITH r AS (SELECT lower(coalesce({_J.format('intent')}, '')) IN {_SAFETY} AS should, thread_id IN (SELECT thread_id FROM exec_logs WHERE {_BASE} IN ('SafetyExtractor', 'SafetyEvaluator')) AS did FROM exec_logs WHERE {_BASE} = 'IntentRouter' AND metadata IS NOT NULL) {_ROUTING}"""),
    ("l2_9_complement_rate", lambda v: l2.complement_rate(v.meta_logs), f"""
WITH {_META}, r AS (SELECT CAST({_M.format('path_b_count')} AS BIGINT) AS b, CAST({_M.format('complement_count')} AS BIGINT) AS c FROM ml WHERE node_name = 'SafetyExtractor' AND operation_type = 'node' AND json_exists(m, '$.path_b_count') AND json_exists(m, '$.complement_count'))
SELECT count(*) AS rows, count(*) FILTER (WHERE b > 0) AS with_path_b, round(coalesce(avg(c / CAST(b AS DOUBLE)) FILTER (WHERE b > 0), 0.0), 4) AS rate FROM r"""),
    ("l2_10_short_circuit_rate", lambda v: l2.short_circuit_rate(v.meta_logs), f"""
WITH {_META}, r AS (SELECT coalesce({_M.format('has_override')} = 'true', false) AS hit FROM ml WHERE node_name = 'edge:route_from_deterministic_check' AND operation_type = 'edge_decision')
SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE), 4) AS rate FROM r"""),
    ("l2_10_threads_with_rule_check", lambda v: l2.thread_rate(v.exec_logs, l2.base_name() == "DeterministicRuleChecker"), _RATE.format(f"{_BASE} = 'DeterministicRuleChecker'")),
    ("l2_11_path_distribution", lambda v: l2.path_distribution(v.exec_logs), f"""
WITH r AS (SELECT {_J.format('retrieval_path')} AS path FROM exec_logs WHERE metadata IS NOT NULL) SELECT path, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM r GROUP BY path"""),
    ("l2_12_follow_up_rate", lambda v: l2.decision_rate(v.exec_logs, "edge:route_from_intent", "FollowUpResponder"), f"""
WITH r AS (SELECT coalesce({_J.format('decision')} = 'FollowUpResponder', false) AS hit FROM exec_logs WHERE node_name = 'edge:route_from_intent')
SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE), 4) AS rate FROM r"""),
    ("l2_13_retry_rate", lambda v: l2.retry_rate(v.exec_logs), f"""
WITH r AS (SELECT thread_id, is_retry OR coalesce(CAST({_J.format('attempt_number')} AS INT) > 1, false) AS again FROM exec_logs WHERE {_BASE} = 'RepairPlanner' AND operation_type IN ('llm_call', 'node'))
SELECT count(DISTINCT thread_id) AS threads, count(DISTINCT thread_id) FILTER (WHERE again) AS retried, count(DISTINCT thread_id) FILTER (WHERE again) / CAST(nullif(count(DISTINCT thread_id), 0) AS DOUBLE) AS rate FROM r"""),
    ("l2_14_retry_triggers", lambda v: l2.retry_triggers(v.exec_logs), f"""
WITH r AS (SELECT count(*) FILTER (WHERE node_name = 'edge:route_from_safety_judge') AS a, count(*) FILTER (WHERE node_name = 'edge:route_from_inline_evaluator') AS b FROM exec_logs WHERE {_J.format('decision')} = 'RepairPlanner')
SELECT a AS by_first, b AS by_second, round(a / CAST(nullif(a + b, 0) AS DOUBLE), 4) AS first_share, round(b / CAST(nullif(a + b, 0) AS DOUBLE), 4) AS second_share FROM r"""),
    ("l2_15_execution_summary", lambda v: l2.execution_summary(v.exec_logs, "thread_id", "node_name"), """
SELECT thread_id, node_name, count(*) AS calls, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, CAST(sum(coalesce(latency_ms, 0)) AS BIGINT) AS latency_ms FROM exec_logs WHERE operation_type = 'llm_call' GROUP BY 1, 2"""),
    ("l2_16_natural_retries", lambda v: l2.natural_retries(v.exec_logs), "SELECT trace_id, count(DISTINCT chain_id) AS chains FROM exec_logs GROUP BY 1 HAVING count(DISTINCT chain_id) > 1"),
    ("l2_16_rerun_candidates", lambda v: l2.rerun_candidates(v.run_log).select("query_id", "thread_id", "duration_ms"), "SELECT query_id, thread_id, duration_ms FROM run_log WHERE trace_variant = 'troubleshoot_full' AND badge = 'green' ORDER BY query_id LIMIT 5"),
    ("l2_17_overhead", lambda v: l2.overhead(v.run_log, "duration_ms", "variant"), """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY duration_ms) AS place, count(*) OVER (PARTITION BY variant) AS n FROM run_log)
SELECT variant, count(*) AS runs, median(duration_ms) AS median, round(avg(duration_ms), 3) AS mean, max(duration_ms) FILTER (WHERE place = CAST(floor(n * 0.95e0) AS INT) + 1) AS p95 FROM p GROUP BY 1"""),
    ("l2_17_overhead_difference", lambda v: l2.overhead_difference(v.run_log, "duration_ms", F.col("is_audited")), """
WITH m AS (SELECT count(*) FILTER (WHERE is_audited) AS n_with, median(duration_ms) FILTER (WHERE is_audited) AS with_median, count(*) FILTER (WHERE NOT is_audited) AS n_without, median(duration_ms) FILTER (WHERE NOT is_audited) AS without_median FROM run_log)
SELECT *, with_median - without_median AS overhead, round(100 * (with_median - without_median) / without_median, 6) AS overhead_percent FROM m"""),
    ("l2_18_run_summary", lambda v: l2.run_summary(v.run_log), """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE actual_intent IS NOT DISTINCT FROM expected_intent) AS intent_match,
  count(*) FILTER (WHERE shadow_completed) AS shadow_done, count(response_id) AS shadow_eligible, min(duration_ms) AS fastest, max(duration_ms) AS slowest, CAST(sum(duration_ms) AS BIGINT) AS total_ms, CAST(sum(stream_ms) AS BIGINT) AS stream_ms FROM run_log"""),
    ("l2_18_badge_counts", lambda v: l2.badge_counts(v.run_log), "SELECT badge, count(*) AS runs FROM run_log WHERE badge IS NOT NULL GROUP BY 1"),
    ("l2_19_step_agreement", lambda v: l2.step_agreement(v.verdicts), """
SELECT eval_id, count(*) FILTER (WHERE shadow_faithful IS NOT NULL) AS steps, count(*) FILTER (WHERE inline_faithful = shadow_faithful) AS agreed,
  coalesce(string_agg(step_index, ',' ORDER BY step_index) FILTER (WHERE inline_faithful <> shadow_faithful), '') AS disagreements,
  round(coalesce(count(*) FILTER (WHERE inline_faithful = shadow_faithful) / CAST(nullif(count(*) FILTER (WHERE shadow_faithful IS NOT NULL), 0) AS DOUBLE), 1.0), 3) AS rate FROM verdicts GROUP BY 1"""),
    ("l2_20_latest_evaluation", lambda v: l2.latest(v.evals, "response_id").select("response_id", "id", "badge", "attempt_number"), """
SELECT response_id, id, badge, attempt_number FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY id DESC) AS n FROM evals) WHERE n = 1"""),
    ("l2_21_patch_latest", lambda v: l2.patch_latest(v.evals, _patches(v), ("async_faithfulness", "async_answer_relevance")).select("id", "async_faithfulness", "async_answer_relevance"), """
WITH p AS (SELECT response_id FROM evals WHERE response_id % 3 = 0 AND attempt_number = 1), m AS (SELECT *, max(id) OVER (PARTITION BY response_id) = id AND response_id IN (SELECT response_id FROM p) AS hit FROM evals)
SELECT id, CASE WHEN hit THEN 0.5 ELSE async_faithfulness END AS async_faithfulness, CASE WHEN hit AND response_id % 2 = 0 THEN 0.25 ELSE async_answer_relevance END AS async_answer_relevance FROM m"""),
    ("l2_22_shadow_escalation", lambda v: review.shadow_escalation(v.evals, l2.step_agreement(v.verdicts)), """
WITH b AS (SELECT id, badge, CASE WHEN async_faithfulness IS NULL AND async_answer_relevance IS NULL THEN NULL WHEN coalesce(async_faithfulness, 1) < 0.4 OR coalesce(async_answer_relevance, 1) < 0.4 THEN 'red'
  WHEN coalesce(async_faithfulness, 1) < 0.7 OR coalesce(async_answer_relevance, 1) < 0.7 THEN 'yellow' ELSE 'green' END AS shadow FROM evals),
r AS (SELECT *, CASE badge WHEN 'green' THEN 0 WHEN 'yellow' THEN 1 WHEN 'red' THEN 2 ELSE 3 END AS i, CASE shadow WHEN 'green' THEN 0 WHEN 'yellow' THEN 1 WHEN 'red' THEN 2 END AS s FROM b),
a AS (SELECT eval_id, round(coalesce(count(*) FILTER (WHERE inline_faithful = shadow_faithful) / CAST(nullif(count(*) FILTER (WHERE shadow_faithful IS NOT NULL), 0) AS DOUBLE), 1.0), 3) AS rate FROM verdicts GROUP BY 1)
SELECT id AS eval_id, 'SHADOW_WORSE' AS reason, 'P2' AS priority FROM r WHERE s > i UNION ALL SELECT eval_id, 'LOW_AGREEMENT', 'P1' FROM a WHERE rate < 0.8"""),
    ("l2_23_evaluator_deltas", lambda v: l2.evaluator_deltas(v.evals), """
WITH d AS (SELECT id, 'faithfulness' AS dimension, round(sync_faithfulness - async_faithfulness, 4) AS delta FROM evals UNION ALL SELECT id, 'answer_relevance', round(sync_answer_relevance - async_answer_relevance, 4) FROM evals)
SELECT id, dimension, delta, abs(delta) > 0.15 AS is_flagged FROM d WHERE delta IS NOT NULL"""),
    ("l2_24_node_sequence", lambda v: l2.node_sequence(v.exec_logs), f"""
WITH f AS (SELECT trace_id, {_BASE} AS node, min(started_ms) AS first_ms FROM exec_logs WHERE operation_type <> 'edge_decision' AND NOT ends_with({_BASE}, '_dispatch') GROUP BY 1, 2) SELECT trace_id, string_agg(node, '>' ORDER BY first_ms) AS nodes FROM f GROUP BY 1"""),
    ("l2_25_routing_facts", lambda v: l2.routing_facts(v.meta_logs), f"""
WITH {_META}, w AS (SELECT *, row_number() OVER (PARTITION BY trace_id, node_name ORDER BY started_ms, id) AS n FROM ml), t AS (SELECT DISTINCT trace_id FROM meta_logs),
i AS (SELECT trace_id, nullif({_M.format('classified_intent')}, '') AS ci, nullif({_M.format('routing_decision')}, '') AS rd, m FROM w WHERE n = 1 AND node_name = 'IntentRouter'),
g AS (SELECT trace_id, true AS flagged, m FROM w WHERE n = 1 AND node_name = 'UnsafeMethodGate'), r AS (SELECT trace_id, m FROM w WHERE n = 1 AND node_name = 'DeterministicRuleChecker' AND coalesce({_M.format('rule_matched')} = 'true', false))
SELECT t.trace_id, nullif(concat_ws(' | ', 'Classified intent: ' || ci, 'Equipment type: ' || json_extract_string(i.m, '$.equipment_type'), CASE WHEN json_extract_string(i.m, '$.is_procedural') = 'true' THEN 'Query is procedural' END,
    CASE WHEN rd IS DISTINCT FROM ci THEN 'Routing decision overridden to: ' || rd END), '') AS rationale, flagged IS NOT NULL AS gate_flagged, json_extract_string(g.m, '$.reason') AS gate_reason, json_extract_string(g.m, '$.redirect_to') AS gate_redirect,
  json_extract_string(r.m, '$.rule_id') AS rule_id, array_to_string(from_json(json_extract(r.m, '$.trigger_keywords'), '["VARCHAR"]'), ',') AS rule_keywords, CASE WHEN r.trace_id IS NOT NULL THEN left(coalesce(json_extract_string(r.m, '$.override_response'), ''), 200) END AS rule_preview
FROM t LEFT JOIN i ON i.trace_id = t.trace_id LEFT JOIN g ON g.trace_id = t.trace_id LEFT JOIN r ON r.trace_id = t.trace_id"""),
]
