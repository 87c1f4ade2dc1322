from pyspark.sql import functions as F

from ..operators import corpus as l1
from ..operators import execution as l2
from ..operators import mining as pm
from ..operators import provenance as xl
from ..operators import report
from ..sources.tables import stage_table
from ..streaming import incremental as st
from .chains import VERIFY_LOGS, _changed_logs
from .mining import _V, _trace
from .provenance import _resolved


def _events(v):
    return v.events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with a zone


def _arriving(v, transform, *how):
    return st.drain_arrivals(_events(v), F.unix_micros("ts"), transform, *how)


def _followed(events):
    rows = events.select(F.col("event_id").alias("id"), "user_id", "ts", "event_type")
    return st.followed_within(rows.filter("event_type = 'purchase'"), rows.filter("event_type = 'error'"), "user_id", "ts", "6 HOURS")


def _activity(events):
    return st.node_activity(events, "ts", "event_type", F.col("value") > 40, "value")


def _broken(v):
    """Records arrive up to 40 seconds out of order, within the delay of two minutes; a heartbeat in a chain of its own ends the wait."""
    logs = stage_table(_changed_logs(v))
    beat = logs.orderBy(F.desc("started_ms")).limit(1).withColumn("chain_id", F.lit("heartbeat")).withColumn("started_ms", F.col("started_ms") + 10 * 60_000)
    shuffled = F.col("id") + F.pmod(F.col("id") * 7919, F.lit(40))
    with st.rocksdb_state(v.spark):
        found = st.drain_arrivals(logs, shuffled, lambda s: st.broken_records(s, "2 minutes"), last=beat)
    return found.filter("state = 'broken'").select("chain_id", "id")


def _trace_report(v):
    """One row a response: latest evaluation, links and where they resolve, feedback, and its documents' rebuildability."""
    last = l2.latest(v.evals, "response_id").select("response_id", "badge", "sync_faithfulness", "thread_id")
    resolved = _resolved(v)
    links = resolved.groupBy("response_id").agg(F.count("*").alias("links"), F.count_if("has_chunk").alias("resolved"), F.count_distinct("document_id").alias("documents"))
    feedback = v.step_fb.groupBy("response_id").agg(F.count("*").alias("feedback"), F.count_if(F.col("action") == "ACCEPT").alias("accepted"))
    known = resolved.filter("has_chunk").select("response_id", "document_id").distinct().join(l1.reconstructability(v.manifest, v.chunks).select("document_id", "score"), "document_id")
    rebuilt = known.groupBy("response_id").agg(F.round(F.avg("score"), 6).alias("reconstructability"))
    per = xl.thread_provenance(v.evals, v.step_fb, v.links).select("thread_id", F.col("score").alias("thread_provenance"))
    return last.join(links, "response_id", "left").join(feedback, "response_id", "left").join(rebuilt, "response_id", "left").join(per, "thread_id", "left")


def _nested_report(v):
    conformance = pm.variants(_trace(v), v.model_edges, v.exec_logs)
    return report.flattened(report.trace_report(v.evals, v.links, v.chunks, l1.reconstructability(v.manifest, v.chunks), v.step_fb, v.resp_fb, v.exec_logs, conformance))


PLANS = [
    ("st1_followed_within", lambda v: _arriving(v, _followed), """
SELECT a.user_id AS key, a.event_id AS first_id, b.event_id AS second_id, date_diff('microsecond', a.ts, b.ts) AS micros FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
WHERE a.event_type = 'purchase' AND b.event_type = 'error'"""),
    ("st2_broken_records", _broken, VERIFY_LOGS),
    ("st3_node_activity", lambda v: _arriving(v, _activity, "update", ["window_start", "node"]).withColumn("window_start", F.col("window_start").cast("string")), """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS node, count(*) AS rows, count(*) FILTER (WHERE value > 40) AS errors, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""),
    ("xl12_nested_report", _nested_report, f"""
{_V}, vv AS (SELECT trace_id, coalesce(is_conforming, true) AS is_conforming, first_deviation, variant FROM (SELECT DISTINCT trace_id FROM exec_logs) x LEFT JOIN v USING (trace_id)), me AS (SELECT document_id, arg_max(total_chunks, entry_sequence) AS n FROM manifest WHERE entry_type = 'chunk_created' GROUP BY 1), cc AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1),
ds AS (SELECT me.document_id, least(me.n, cc.n) / CAST(greatest(me.n, cc.n) AS DOUBLE) AS score FROM me JOIN cc USING (document_id)),
lr AS (SELECT l.*, c.document_id, score FROM links l LEFT JOIN chunks c ON c.id = l.chunk_id LEFT JOIN ds ON ds.document_id = c.document_id),
la AS (SELECT response_id, count(*) AS links, count(document_id) AS resolved, string_agg(chunk_id || ':' || grounding_label, ' ' ORDER BY coalesce(step_index, 1 << 30), id) AS attribution, count(DISTINCT document_id) AS documents FROM lr GROUP BY 1),
lb AS (SELECT response_id, round(avg(score), 6) AS rebuildable FROM (SELECT DISTINCT response_id, document_id, score FROM lr WHERE document_id IS NOT NULL) GROUP BY 1),
sf AS (SELECT response_id, count(*) FILTER (WHERE action = 'ACCEPT') AS accept, count(*) FILTER (WHERE action = 'INCORRECT') AS incorrect FROM step_fb GROUP BY 1),
rf AS (SELECT response_id, count(*) FILTER (WHERE feedback_type = 'UP') AS up, count(*) FILTER (WHERE feedback_type = 'DOWN') AS down FROM resp_fb WHERE NOT retracted GROUP BY 1),
lo AS (SELECT thread_id, arg_max(trace_id, (started_ms, id)) AS trace_id FROM exec_logs GROUP BY 1),
nf AS (SELECT thread_id, trace_id, split_part(node_name, ':', 1) AS node, min(started_ms) AS first_ms, sum(latency_ms) AS ms FROM exec_logs WHERE operation_type <> 'edge_decision' AND NOT ends_with(split_part(node_name, ':', 1), '_dispatch') GROUP BY ALL),
nl AS (SELECT thread_id, trace_id, string_agg(node, '>' ORDER BY first_ms) AS nodes, CAST(sum(ms) AS BIGINT) AS total_ms FROM nf GROUP BY ALL),
ev AS (SELECT response_id, max(id) AS id, count(*) AS attempts FROM evals GROUP BY 1)
SELECT ev.response_id, attempts, e.badge, e.sync_faithfulness AS faithfulness, links, resolved, attribution, documents, rebuildable, accept, incorrect, up, down, lo.trace_id, coalesce(nodes, CASE WHEN lo.trace_id IS NOT NULL THEN '' END) AS nodes, total_ms,
  is_conforming, first_deviation, variant FROM ev JOIN evals e ON e.id = ev.id LEFT JOIN la ON la.response_id = ev.response_id LEFT JOIN lb ON lb.response_id = ev.response_id LEFT JOIN sf ON sf.response_id = ev.response_id LEFT JOIN rf ON rf.response_id = ev.response_id
  LEFT JOIN lo ON lo.thread_id = e.thread_id LEFT JOIN nl ON nl.thread_id = lo.thread_id AND nl.trace_id = lo.trace_id LEFT JOIN vv ON vv.trace_id = lo.trace_id"""),
    ("xl12_trace_report", _trace_report, """
WITH r AS (SELECT l.response_id, c.document_id, c.id IS NOT NULL AS ok FROM links l LEFT JOIN chunks c ON c.id = l.chunk_id), k AS (SELECT response_id, count(*) AS links, count(*) FILTER (WHERE ok) AS resolved, count(DISTINCT document_id) AS documents FROM r GROUP BY 1),
f AS (SELECT response_id, count(*) AS feedback, count(*) FILTER (WHERE action = 'ACCEPT') AS accepted FROM step_fb GROUP BY 1),
m AS (SELECT document_id, arg_max(total_chunks, entry_sequence) AS n FROM manifest WHERE entry_type = 'chunk_created' GROUP BY 1), cc AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1),
s AS (SELECT m.document_id, least(m.n, cc.n) / CAST(greatest(m.n, cc.n) AS DOUBLE) AS score FROM m JOIN cc USING (document_id)),
b AS (SELECT response_id, round(avg(score), 6) AS reconstructability FROM (SELECT DISTINCT response_id, document_id FROM r WHERE ok) d JOIN s USING (document_id) GROUP BY 1),
t AS (SELECT DISTINCT thread_id, response_id FROM evals), kk AS (SELECT DISTINCT response_id FROM links), ss AS (SELECT DISTINCT response_id, step_index FROM step_fb),
pa AS (SELECT thread_id, count(*) AS steps, count(kk.response_id) AS ok FROM t JOIN ss USING (response_id) LEFT JOIN kk ON kk.response_id = t.response_id GROUP BY 1), pb AS (SELECT thread_id, count(kk.response_id) AS linked FROM t LEFT JOIN kk ON kk.response_id = t.response_id GROUP BY 1),
p AS (SELECT thread_id, coalesce(coalesce(ok, linked) / CAST(nullif(coalesce(steps, linked), 0) AS DOUBLE), 0.0) AS thread_provenance FROM pb LEFT JOIN pa USING (thread_id)),
e AS (SELECT response_id, badge, sync_faithfulness, thread_id FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY id DESC) AS n FROM evals) WHERE n = 1)
SELECT e.*, links, resolved, documents, feedback, accepted, reconstructability, thread_provenance FROM e LEFT JOIN k USING (response_id) LEFT JOIN f USING (response_id) LEFT JOIN b USING (response_id) LEFT JOIN p USING (thread_id)"""),
]
