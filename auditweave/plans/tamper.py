from pyspark.sql import functions as F

from ..operators import chains
from ..operators import journal as jr
from ..operators import tamper as fi
from ..sources.tables import stage_table
from .chains import _CHAIN, _LOG_CHAIN, _logs

_ORD = "(((query_id * 7919 + {}) % 2147483647) * 48271 + 11) % 2147483647"
_BASE = "split_part(node_name, ':', 1)"
_E = f"""nn AS (SELECT thread_id, count(DISTINCT {_BASE}) AS n FROM exec_logs GROUP BY 1),
el AS (SELECT query_id, response_id, thread_id, variant, safety_found, actual_intent FROM run_log WHERE status = 'PASS' AND chunks_retrieved >= 3 AND thread_id IN (SELECT thread_id FROM nn WHERE n >= 5))"""
_A = f"""{_E}, ra AS (SELECT *, row_number() OVER (ORDER BY {_ORD.format(9)}, query_id) - 1 AS k FROM el),
fs AS (SELECT min(k // 2) AS f FROM ra WHERE safety_found AND k % 2 = 0), rk AS (SELECT ra.*, CASE WHEN k // 2 = f THEN 0 WHEN k // 2 < f THEN k // 2 + 1 ELSE k // 2 END AS i FROM ra, fs),
asg AS (SELECT query_id, response_id, thread_id, k % 2 = 0 AS is_injected, CASE WHEN k % 2 = 0 THEN ['chunk_deletion', 'score_perturbation', 'log_gap', 'manifest_tamper'][i % 4 + 1] END AS kind FROM rk)"""
_O = f"""{_A}, oc AS (SELECT *, CASE WHEN is_injected AND query_id % 5 <> 0 THEN 'TP' WHEN NOT is_injected AND query_id % 7 <> 0 THEN 'TN' WHEN NOT is_injected THEN 'FP' ELSE 'FN' END AS outcome,
  CASE WHEN query_id % 3 = 0 THEN 'other' WHEN query_id % 3 = 1 THEN kind ELSE 'log_gap' END AS guess FROM asg)"""


def _eligible(v):
    from ..operators.execution import base_name

    return fi.eligible_sessions(v.run_log, v.exec_logs.groupBy("thread_id").agg(F.count_distinct(base_name()).alias("n_nodes")))


def _assigned(v):
    return fi.assigned(_eligible(v), 9)


def _outcomes(v):
    a = _assigned(v)
    seen = F.when(F.col("is_injected"), F.col("query_id") % 5 != 0).otherwise(F.col("query_id") % 7 == 0)
    guess = F.when(F.col("query_id") % 3 == 0, "other").when(F.col("query_id") % 3 == 1, F.col("kind")).otherwise("log_gap")
    return fi.classified(a, a.select("query_id", seen.alias("is_detected"), guess.alias("guess")))


def _without(v):
    return fi.without(v.links, fi.link_targets(_assigned(v), v.links))


_J = f"""{_CHAIN.replace("o AS (", "mo AS (").replace("FROM o ", "FROM mo ").replace("JOIN o ON o.", "JOIN mo o ON o.").replace("h AS (", "mh AS (", 1).replace("FROM h JOIN", "FROM mh h JOIN").split(chr(10) + "t AS")[0].rstrip(",")},
{_LOG_CHAIN.replace("o AS (", "lo AS (").replace("FROM o ", "FROM lo ").replace("JOIN o ON o.", "JOIN lo o ON o.").replace("h AS (SELECT chain_id, id", "lh0 AS (SELECT chain_id, id").replace("FROM h JOIN", "FROM lh0 h JOIN")},
lh AS (SELECT lh0.chain_id, lh0.id, node_name, record_hash FROM lh0 JOIN exec_logs x ON x.id = lh0.id), {_A}, ss AS (SELECT asg.*, safety_found AS safety FROM asg JOIN run_log USING (query_id) WHERE is_injected),
k1 AS (SELECT query_id, kind, 'links' AS table_name, arg_min(l.id, (coalesce(step_index, 99), l.id)) AS key FROM ss JOIN links l USING (response_id) LEFT JOIN chunks c ON c.id = l.chunk_id WHERE kind = 'chunk_deletion' AND (NOT safety OR coalesce(has_safety_content, false)) GROUP BY ALL),
k2 AS (SELECT query_id, kind, 'evals' AS table_name, CAST(min(e.id) AS VARCHAR) AS key FROM ss JOIN evals e USING (response_id) WHERE kind = 'score_perturbation' GROUP BY ALL),
k3 AS (SELECT query_id, kind, 'logs' AS table_name, CAST(id AS VARCHAR) AS key FROM (SELECT query_id, kind, x.id, row_number() OVER (PARTITION BY query_id ORDER BY started_ms, x.id) - 1 AS n, count(*) OVER (PARTITION BY query_id) AS k FROM ss JOIN exec_logs x ON x.thread_id = ss.thread_id WHERE kind = 'log_gap') WHERE k >= 3 AND n = k // 2),
k4 AS (SELECT query_id, kind, 'manifest' AS table_name, CAST(min(m.entry_sequence) AS VARCHAR) AS key FROM (SELECT query_id, kind, min(document_id) AS document_id FROM ss JOIN links l USING (response_id) JOIN chunks c ON c.id = l.chunk_id WHERE kind = 'manifest_tamper' GROUP BY ALL) d JOIN manifest m USING (document_id) GROUP BY ALL),
ka AS (SELECT arg_min(kind, query_id) AS kind, min(query_id) AS query_id, table_name, key FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4) GROUP BY table_name, key),
jo AS (SELECT query_id, kind, table_name, key, CASE table_name WHEN 'evals' THEN 'sync_faithfulness' WHEN 'manifest' THEN 'entry_hash' END AS column_name, CASE table_name WHEN 'evals' THEN CAST(sync_faithfulness AS VARCHAR) WHEN 'manifest' THEN entry_hash END AS before,
  CASE table_name WHEN 'evals' THEN CAST(round(1 - coalesce(sync_faithfulness, 0), 6) AS VARCHAR) WHEN 'manifest' THEN 'TAMPERED_' || left(entry_hash, 55) END AS after
  FROM ka LEFT JOIN evals e ON table_name = 'evals' AND CAST(e.id AS VARCHAR) = key LEFT JOIN mh ON table_name = 'manifest' AND CAST(mh.entry_sequence AS VARCHAR) = key)"""
_LT = f"{_A}, lt AS (SELECT response_id, arg_min(l.id, (coalesce(step_index, 99), l.id)) AS id FROM links l JOIN asg USING (response_id) WHERE kind = 'chunk_deletion' GROUP BY 1)"

def _tables(v):
    """The four tables of the experiment, with their chains as they should be."""
    links = v.links.select("id", "response_id", "chunk_id", "step_index", "grounding_label", "similarity_score", "reranker_score")
    evals = v.evals.select("id", "response_id", "thread_id", "badge", "sync_faithfulness", "async_faithfulness")
    logs = chains.log_chain(_logs(v)).select("id", "chain_id", "thread_id", "operation_type", "document", "node_name", "started_ms", "metadata", "record_hash")
    manifest = chains.chained(v.manifest).select("entry_sequence", "document_id", "entry_type", "entry_json", "prev_hash", "entry_hash")
    return {"links": links, "evals": evals, "logs": stage_table(logs), "manifest": stage_table(manifest)}


def _experiment(v):
    tables = _tables(v)
    sessions = _assigned(v).filter("is_injected").join(v.run_log.select("query_id", F.col("safety_found").alias("safety_required")), "query_id")
    return tables, stage_table(jr.journal(jr.targets(sessions, tables, v.chunks), tables))


def _journal(v):
    return _experiment(v)[1].withColumn("before", F.when(F.col("column_name").isNotNull(), F.col("before")))


_DIGESTED = {"links": ["id", "chunk_id", "response_id", "grounding_label"], "evals": ["id", "response_id", "sync_faithfulness"], "logs": ["id", "node_name", "record_hash"], "manifest": ["entry_sequence", "entry_hash"]}


def _digests(v):
    """Scores count as whole millionths, which both engines print alike."""
    tables, changes = _experiment(v)
    injected = {n: stage_table(t) for n, t in jr.applied(tables, changes).items()}
    whole = lambda state: state | {"evals": state["evals"].withColumn("sync_faithfulness", F.round(F.col("sync_faithfulness") * 1e6).cast("long"))}
    return jr.digests({"original": whole(tables), "injected": whole(injected), "reverted": whole(jr.reverted(injected, changes))}, _DIGESTED)


def _verified(v):
    """After a revert of all but every third session's change."""
    tables, changes = _experiment(v)
    injected = jr.applied(tables, changes)
    return jr.verified(jr.reverted(injected, changes.filter("query_id % 3 <> 0")), changes).select("query_id", "kind", "key", "is_restored", "reason")


def _detected(v):
    """What the checks of the chains find in the injected tables."""
    tables, changes = _experiment(v)
    injected = jr.applied(tables, changes)
    broken = chains.broken_documents(injected["manifest"]).select(F.lit("manifest").alias("table_name"), F.col("document_id").cast("string").alias("key"))
    return broken.unionByName(chains.verify_log_chain(injected["logs"]).select(F.lit("logs").alias("table_name"), F.col("chain_id").alias("key")).distinct())


PLANS = [
    ("fi1_eligible_sessions", _eligible, f"WITH {_E} SELECT * FROM el"),
    ("fi2_stratified", lambda v: fi.stratified(_eligible(v), [(F.col("safety_found"), 4), (F.col("variant") == "1-URGENT", 2), (F.col("variant") == "5-LOW", 2)], 12, 3).select("query_id"), f"""
WITH {_E}, o AS (SELECT *, {_ORD.format(3)} AS o FROM el), r AS (SELECT *, CASE WHEN safety_found THEN row_number() OVER (PARTITION BY safety_found ORDER BY o, query_id) END AS a,
  CASE WHEN variant = '1-URGENT' THEN row_number() OVER (PARTITION BY variant = '1-URGENT' ORDER BY o, query_id) END AS b, CASE WHEN variant = '5-LOW' THEN row_number() OVER (PARTITION BY variant = '5-LOW' ORDER BY o, query_id) END AS c FROM o)
SELECT query_id FROM r ORDER BY NOT coalesce(a <= 4 OR b <= 2 OR c <= 2, false), NOT (coalesce(a <= 4, false) OR coalesce(b <= 2, false) OR coalesce(c <= 2, false)), o, query_id LIMIT 12"""),
    ("fi3_assignment", _assigned, f"WITH {_A} SELECT * FROM asg"),
    ("fi4_link_targets", lambda v: fi.link_targets(_assigned(v), v.links), f"WITH {_LT} SELECT response_id, id FROM lt"),
    ("fi4_log_targets", lambda v: fi.log_targets(_assigned(v), v.exec_logs), f"""
WITH {_A}, p AS (SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY started_ms, id) - 1 AS n, count(*) OVER (PARTITION BY thread_id) AS k FROM exec_logs WHERE thread_id IN (SELECT thread_id FROM asg WHERE kind = 'log_gap'))
SELECT thread_id, id FROM p WHERE k >= 3 AND n = k // 2"""),
    ("fi5_delete_links", lambda v: _without(v)[0].groupBy("response_id").agg(F.count("*").alias("n")), f"WITH {_LT} SELECT response_id, count(*) AS n FROM links WHERE id NOT IN (SELECT id FROM lt) GROUP BY 1"),
    ("fi5_perturb_scores", lambda v: fi.perturbed(v.evals, _assigned(v)).select("id", "sync_faithfulness"), f"""
WITH {_A} SELECT id, CASE WHEN attempt_number = 1 AND response_id IN (SELECT response_id FROM asg WHERE kind = 'score_perturbation') THEN round(1 - sync_faithfulness, 6) ELSE sync_faithfulness END AS sync_faithfulness FROM evals"""),
    ("fi6_revert", lambda v: fi.revert(*_without(v)).groupBy("response_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id")), "SELECT response_id, count(*) AS n, min(id) AS first_id FROM links GROUP BY 1"),
    ("fi7_verify_revert", lambda v: fi.verify_revert(_without(v)[0].unionByName(_without(v)[1].filter("response_id % 2 = 0")), _without(v)[1], ["response_id", "chunk_id"]), f"WITH {_LT} SELECT id, CASE WHEN response_id % 2 = 0 THEN 'restored' ELSE 'missing' END AS state FROM lt"),
    ("fi4_fi5_journal", _journal, f"WITH RECURSIVE {_J} SELECT query_id, kind, table_name, key, column_name, before, after FROM jo"),
    ("fi5_fi6_digests", _digests, f"""
WITH RECURSIVE {_J}, st AS (SELECT 'original' AS state UNION ALL SELECT 'reverted'), t1 AS (SELECT 'links' AS table_name, concat_ws(chr(31), chunk_id, grounding_label, id, response_id) AS x, id AS key FROM links
  UNION ALL SELECT 'evals', concat_ws(chr(31), id, response_id, coalesce(CAST(CAST(round(sync_faithfulness * 1000000) AS BIGINT) AS VARCHAR), chr(0))), CAST(id AS VARCHAR) FROM evals
  UNION ALL SELECT 'logs', concat_ws(chr(31), id, node_name, record_hash), CAST(id AS VARCHAR) FROM lh UNION ALL SELECT 'manifest', concat_ws(chr(31), entry_hash, entry_sequence), CAST(entry_sequence AS VARCHAR) FROM mh),
t2 AS (SELECT t1.table_name, CASE WHEN j.key IS NULL THEN x WHEN t1.table_name = 'evals' THEN concat_ws(chr(31), t1.key, e.response_id, CAST(round(CAST(after AS DOUBLE) * 1000000) AS BIGINT)) ELSE concat_ws(chr(31), after, t1.key) END AS x
  FROM t1 LEFT JOIN jo j ON j.table_name = t1.table_name AND j.key = t1.key LEFT JOIN evals e ON t1.table_name = 'evals' AND CAST(e.id AS VARCHAR) = t1.key WHERE j.key IS NULL OR j.column_name IS NOT NULL),
al AS (SELECT state, table_name, x FROM st, t1 UNION ALL SELECT 'injected', table_name, x FROM t2)
SELECT state, table_name, count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || left(sha256(x), 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM al GROUP BY 1, 2"""),
    ("fi7_verified", _verified, f"""
WITH RECURSIVE {_J}, w AS (SELECT *, query_id % 3 <> 0 AS ok, table_name || CASE table_name WHEN 'manifest' THEN ' entry_sequence=' ELSE ' id=' END || key AS label FROM jo)
SELECT query_id, kind, key, ok OR (kind = 'score_perturbation' AND before IS NOT DISTINCT FROM after) AS is_restored, label || CASE WHEN ok OR (kind = 'score_perturbation' AND before IS NOT DISTINCT FROM after) THEN ' restored' WHEN column_name IS NULL THEN ' not found'
  WHEN kind = 'manifest_tamper' THEN ': hash still tampered' ELSE ': sync_faithfulness is ' || after || ', expected ' || coalesce(before, 'null') END AS reason FROM w"""),
    ("fi5_detected", _detected, f"""
WITH RECURSIVE {_J} SELECT 'manifest' AS table_name, CAST(document_id AS VARCHAR) AS key FROM mh JOIN jo ON jo.table_name = 'manifest' AND jo.key = CAST(entry_sequence AS VARCHAR) GROUP BY ALL
UNION ALL SELECT 'logs', chain_id FROM lh WHERE EXISTS (SELECT 1 FROM jo JOIN lh g ON CAST(g.id AS VARCHAR) = jo.key WHERE jo.table_name = 'logs' AND g.chain_id = lh.chain_id AND g.id < lh.id)
  AND CAST(id AS VARCHAR) NOT IN (SELECT key FROM jo WHERE table_name = 'logs') GROUP BY ALL"""),
    ("fi8_overview", lambda v: fi.overview(v.exec_logs), f"SELECT thread_id, count(*) AS rows, count(DISTINCT {_BASE}) AS nodes, max(completed_ms) - min(started_ms) AS span_ms FROM exec_logs GROUP BY 1"),
    ("fi9_score_deltas", lambda v: v.evals.groupBy("thread_id").agg((F.round(F.avg(F.col("sync_faithfulness") - F.col("async_faithfulness")), 6) + F.lit(0.0)).alias("faithfulness_delta"), F.count("*").alias("n")), "SELECT thread_id, round(avg(sync_faithfulness - async_faithfulness), 6) + 0.0 AS faithfulness_delta, count(*) AS n FROM evals GROUP BY 1"),
    ("fi10_anomalies", lambda v: fi.anomalies(v.exec_logs), """
WITH l AS (SELECT * FROM exec_logs WHERE operation_type <> 'edge_decision')
SELECT id, 'not_completed' AS anomaly FROM l WHERE completed_ms IS NULL UNION ALL SELECT id, 'no_latency' FROM l WHERE coalesce(latency_ms, 0) = 0 UNION ALL SELECT id, 'slow' FROM l WHERE latency_ms > 120000
UNION ALL SELECT id, 'no_metadata' FROM l WHERE metadata IS NULL"""),
    ("fi11_content_check", lambda v: fi.content_check(v.links, v.chunks), """
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY md5('5:' || id), id) AS n FROM links) WHERE n <= 2)
SELECT response_id, count(*) AS sampled, count(*) FILTER (WHERE c.id IS NULL) AS missing FROM s LEFT JOIN chunks c ON c.id = s.chunk_id GROUP BY 1"""),
    ("fi12_outcomes", lambda v: _outcomes(v).select("query_id", "outcome"), f"WITH {_O} SELECT query_id, outcome FROM oc"),
    ("fi13_scores", lambda v: fi.scores(_outcomes(v)), f"""
WITH {_O}, n AS (SELECT count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'TN') AS tn, count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'FN') AS fn, count(*) FILTER (WHERE outcome = 'TP' AND guess = kind) AS t FROM oc)
SELECT tp, tn, fp, fn, (tp + tn) / CAST(nullif(tp + tn + fp + fn, 0) AS DOUBLE) AS accuracy, tp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS precision, tp / CAST(nullif(tp + fn, 0) AS DOUBLE) AS recall, 2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE) AS f1,
  t / CAST(nullif(tp, 0) AS DOUBLE) AS type_accuracy FROM n"""),
    ("fi13_recall_by_kind", lambda v: fi.recall_by_kind(_outcomes(v)), f"WITH {_O} SELECT kind, count(*) AS injected, count(*) FILTER (WHERE outcome = 'TP') AS detected, count(*) FILTER (WHERE outcome = 'TP') / CAST(count(*) AS DOUBLE) AS recall FROM oc WHERE is_injected GROUP BY 1"),
    ("fi14_confusion", lambda v: fi.confusion(_outcomes(v)), f"""
WITH {_O} SELECT kind, count(*) FILTER (WHERE guess = 'chunk_deletion') AS chunk_deletion, count(*) FILTER (WHERE guess = 'score_perturbation') AS score_perturbation, count(*) FILTER (WHERE guess = 'log_gap') AS log_gap,
  count(*) FILTER (WHERE guess = 'manifest_tamper') AS manifest_tamper, count(*) FILTER (WHERE guess = 'other') AS unknown FROM oc WHERE is_injected GROUP BY 1"""),
    ("fi15_follow_ups", lambda v: fi.follow_ups(_outcomes(v)), f"WITH {_O} SELECT query_id, CASE outcome WHEN 'FN' THEN 'P0' ELSE 'P1' END AS priority FROM oc WHERE outcome IN ('FN', 'FP')"),
    ("fi16_binomial_interval", lambda v: fi.binomial_interval(fi.recall_by_kind(_outcomes(v)).selectExpr("kind", "detected AS hits", "injected AS n")), None),
    ("fi17_blast_radius", lambda v: fi.blast_radius(chains.broken_documents(chains.tampered(chains.chained(v.manifest))), v.links, v.chunks), """
SELECT c.document_id, count(DISTINCT response_id) AS responses FROM links l JOIN chunks c ON c.id = l.chunk_id WHERE document_id % 5 = 0 AND document_id IN (SELECT document_id FROM manifest) GROUP BY 1"""),
    ("fi18_balanced", lambda v: fi.balanced(v.run_log.select("query_id", "variant", "safety_found", F.col("thread_id").alias("system")), ["variant", "safety_found"], "system", 20, 4, 17), f"""
WITH a AS (SELECT query_id, variant, safety_found, thread_id AS system, {_ORD.format(17)} AS o FROM run_log), b AS (SELECT *, row_number() OVER (PARTITION BY variant, safety_found, system ORDER BY o, query_id) AS n FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY variant, safety_found ORDER BY n, o, query_id) AS k FROM b WHERE n <= 4) SELECT query_id, variant, safety_found, system FROM c WHERE k <= 20"""),
]
