from pyspark.sql import functions as F

from ..operators import mining as pm

_T = """k AS (SELECT src AS node FROM model_edges UNION SELECT dst FROM model_edges),
a AS (SELECT trace_id, split_part(node_name, ':', 1) AS node, started_ms, id FROM exec_logs WHERE operation_type IN ('llm_call', 'node')),
b AS (SELECT *, lag(node) OVER (PARTITION BY trace_id ORDER BY started_ms, id) AS before FROM a WHERE node IN (SELECT node FROM k)),
t AS (SELECT trace_id, node, row_number() OVER (PARTITION BY trace_id ORDER BY started_ms, id) AS place FROM b WHERE before IS NULL OR before <> node),
s0 AS (SELECT trace_id, place, lag(node, 1, 'START') OVER (PARTITION BY trace_id ORDER BY place) AS src, node AS dst FROM t UNION ALL SELECT trace_id, max(place) + 1, arg_max(node, place), 'END' FROM t GROUP BY 1),
s AS (SELECT s0.*, m.src IS NOT NULL AS known FROM s0 LEFT JOIN model_edges m ON m.src = s0.src AND m.dst = s0.dst)"""
_V = f"""WITH {_T}, p AS (SELECT trace_id, bool_and(known) AS is_conforming, arg_min(src || '>' || dst, place) FILTER (WHERE NOT known) AS first_deviation, arg_max(src, place) AS e, list(src) AS h,
  bool_or(src = 'InlineEvaluator' AND dst = 'RepairPlanner') AS er, bool_or(src = 'SafetyJudgeGate' AND dst = 'RepairPlanner') AS sr FROM s GROUP BY 1),
v AS (SELECT trace_id, is_conforming, first_deviation, CASE
  WHEN list_has_all(h, ['FollowUpResponder', 'InlineEvaluator']) AND e = 'InlineEvaluator' THEN 'followup'
  WHEN e = 'DeterministicRuleChecker' THEN 'troubleshoot_deterministic_exit'
  WHEN list_has_all(h, ['DirectReplacementAnalyzer', 'InlineEvaluator']) AND e = 'InlineEvaluator' THEN 'replace_part'
  WHEN list_has_all(h, ['SymptomAnalyzer', 'RootCauseAnalyzer']) AND e = 'RootCauseAnalyzer' THEN 'troubleshoot_short_circuit'
  WHEN e <> 'InlineEvaluator' THEN NULL WHEN list_contains(h, 'UnsafeMethodGate') THEN 'unsafe_method_redirect' WHEN er THEN 'troubleshoot_eval_retry' WHEN sr THEN 'troubleshoot_safety_retry'
  ELSE 'troubleshoot_full' END AS variant FROM p)"""
_CHI = """WITH d AS (SELECT node_name AS node, json_extract_string(metadata, '$.decision') AS target, {what} AS x FROM exec_logs WHERE operation_type = 'edge_decision' AND node_name LIKE 'edge:%' AND target IS NOT NULL AND x IS NOT NULL),
c AS (SELECT node, target, x, count(*) AS o FROM d GROUP BY ALL), r AS (SELECT node, target, sum(o) AS rn FROM c GROUP BY ALL), q AS (SELECT node, x, sum(o) AS cn FROM c GROUP BY ALL), n AS (SELECT node, sum(rn) AS n FROM r GROUP BY 1),
g AS (SELECT r.node, r.target, q.x, rn * CAST(cn AS DOUBLE) / n AS e, coalesce(o, 0) AS o, n FROM r JOIN q USING (node) JOIN n USING (node) LEFT JOIN c ON c.node = r.node AND c.target = r.target AND c.x = q.x)
SELECT node, CAST(max(n) AS BIGINT) AS n, (count(DISTINCT target) - 1) * (count(DISTINCT x) - 1) AS df, round(sum((o - e) * (o - e) / e), 6) AS statistic FROM g GROUP BY node HAVING df > 0"""


def _trace(v):
    return pm.traces(v.exec_logs, v.model_edges)


def _expected(v):
    return _trace(v).select("trace_id").distinct().withColumn("expected", F.expr("cast(substr(trace_id, 1, 1) as int)") % 8)


PLANS = [
    ("pm1_traces", _trace, f"WITH {_T} SELECT trace_id, node, place FROM t"),
    ("pm2_variants", lambda v: pm.variants(_trace(v), v.model_edges, v.exec_logs), f"""
{_V} SELECT trace_id, coalesce(is_conforming, true) AS is_conforming, first_deviation, variant FROM (SELECT DISTINCT trace_id FROM exec_logs) LEFT JOIN v USING (trace_id)"""),
    ("pm3_fitness", lambda v: pm.fitness(pm.steps(_trace(v), v.model_edges)), f"""
WITH {_T}, p AS (SELECT trace_id, count(*) FILTER (WHERE known) AS ok, count(*) FILTER (WHERE NOT known) AS bad FROM s GROUP BY 1)
SELECT count(*) AS traces, CAST(sum(ok) AS BIGINT) AS valid, CAST(sum(bad) AS BIGINT) AS deviant, round(sum(ok) / CAST(sum(ok) + sum(bad) AS DOUBLE), 4) AS fitness, round(count(*) FILTER (WHERE bad = 0) / CAST(count(*) AS DOUBLE), 4) AS conformance_rate FROM p HAVING count(*) >= 20"""),
    ("pm3_deviations", lambda v: pm.deviations(pm.steps(_trace(v), v.model_edges)), f"WITH {_T} SELECT trace_id, string_agg(src || '>' || dst, ',' ORDER BY place) AS edges FROM s WHERE NOT known GROUP BY 1"),
    ("pm4_precision", lambda v: pm.precision(pm.steps(_trace(v), v.model_edges), v.model_edges), f"""
WITH {_T}, r AS (SELECT m.src, m.dst, EXISTS (SELECT 1 FROM s WHERE s.src = m.src AND s.dst = m.dst) AS seen FROM model_edges m)
SELECT count(*) AS model, count(*) FILTER (WHERE seen) AS observed, round(count(*) FILTER (WHERE seen) / CAST(count(*) AS DOUBLE), 4) AS precision,
  coalesce(string_agg(src || '>' || dst, ',' ORDER BY src || '>' || dst) FILTER (WHERE NOT seen), '') AS unexercised FROM r"""),
    ("pm5_decision_mining", lambda v: pm.testable(pm.chi_squared(pm.decisions(v.exec_logs), "node", "target", "intent")), _CHI.format(what="json_extract_string(metadata, '$.intent')")),
    ("pm5_decision_procedural", lambda v: pm.testable(pm.chi_squared(pm.decisions(v.exec_logs), "node", "target", "is_procedural")), _CHI.format(what="json_extract_string(metadata, '$.intent') = 'procedural'")),
    ("pm6_chi_squared_p", lambda v: pm.chi_squared_p(pm.chi_squared(pm.decisions(v.exec_logs), "node", "target", "intent")), None),
    ("pm7_variant_agreement", lambda v: pm.variant_agreement(pm.variants(_trace(v), v.model_edges), _expected(v)), f"""
{_V}, x AS (SELECT variant, CAST(substr(trace_id, 1, 1) AS INT) % 8 AS expected FROM v)
SELECT CAST(expected AS INT) AS expected, count(*) AS n, count(*) FILTER (WHERE CASE expected WHEN 1 THEN variant = 'troubleshoot_deterministic_exit' WHEN 2 THEN variant = 'followup' WHEN 3 THEN variant IN ('troubleshoot_short_circuit', 'troubleshoot_full')
  WHEN 4 THEN variant IN ('troubleshoot_full', 'troubleshoot_safety_retry', 'troubleshoot_eval_retry') WHEN 5 THEN variant = 'replace_part' WHEN 6 THEN variant = 'unsafe_method_redirect' WHEN 7 THEN variant = 'unsafe_method_redirect' END) AS agree,
  count(DISTINCT variant) AS observed_variants FROM x GROUP BY 1"""),
]
