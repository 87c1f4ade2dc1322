from pyspark.sql import functions as F

from ..operators import chains as hc

_CHAIN = """o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY entry_sequence) AS n FROM manifest),
h AS (SELECT document_id, entry_sequence, entry_type, entry_json, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || entry_json) AS entry_hash FROM o WHERE n = 1
  UNION ALL SELECT o.document_id, o.entry_sequence, o.entry_type, o.entry_json, o.n, h.entry_hash, sha256(h.entry_hash || o.entry_json) FROM h JOIN o ON o.document_id = h.document_id AND o.n = h.n + 1),
t AS (SELECT * REPLACE (CASE WHEN document_id % 5 = 0 AND entry_type = 'chunk_created' THEN 'TAMPERED_' || left(entry_hash, 55) ELSE entry_hash END AS entry_hash) FROM h)"""
_TEXT = "'|' || operation_type || '|' || coalesce(document, 'None') || '|' || node_name || '|' || started_ms || '|' || coalesce(metadata, '')"
_LOGS = "l AS (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE 'd' || (id % 10) END AS document FROM exec_logs)"
_LOG_CHAIN = f"""{_LOGS}, o AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY id) AS n FROM l),
h AS (SELECT chain_id, id, n, sha256('GENESIS') AS prev_hash, sha256(sha256('GENESIS') || {_TEXT}) AS record_hash FROM o WHERE n = 1
  UNION ALL SELECT h.chain_id, o.id, o.n, h.record_hash, sha256(h.record_hash || {_TEXT}) FROM h JOIN o ON o.chain_id = h.chain_id AND o.n = h.n + 1)"""


#: The records whose stored hash is not the recomputed one, of `_changed_logs`.
VERIFY_LOGS = f"""
WITH RECURSIVE {_LOG_CHAIN}, f AS (SELECT chain_id, min(id) AS id FROM h WHERE id % 50 = 0 AND id IN (SELECT id FROM l WHERE metadata IS DISTINCT FROM '{{}}') GROUP BY 1)
SELECT h.chain_id, h.id FROM h LEFT JOIN f ON f.chain_id = h.chain_id WHERE h.id % 70 = 0 OR h.id >= f.id"""


def _logs(v):
    return v.exec_logs.withColumn("document", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("d"), F.col("id") % 10)))


def _changed_logs(v):
    """One record in 50 with other metadata, one in 70 with another stored hash."""
    chain = hc.log_chain(_logs(v))
    changed = chain.withColumn("metadata", F.when(F.col("id") % 50 == 0, F.lit("{}")).otherwise(F.col("metadata")))
    return changed.withColumn("record_hash", F.when(F.col("id") % 70 == 0, F.lit("x")).otherwise(F.col("record_hash")))


PLANS = [
    ("hc1_append_manifest", lambda v: hc.chained(v.manifest).select("document_id", "entry_sequence", "prev_hash", "entry_hash"), f"WITH RECURSIVE {_CHAIN} SELECT document_id, entry_sequence, prev_hash, entry_hash FROM h"),
    ("hc2_verify_manifest", lambda v: hc.verify(hc.tampered(hc.chained(v.manifest))), f"""
WITH RECURSIVE {_CHAIN}, w AS (SELECT *, sha256(prev_hash || entry_json) = entry_hash AND coalesce(lag(entry_hash) OVER (PARTITION BY document_id ORDER BY n) = prev_hash, true) AS ok FROM t)
SELECT document_id, bool_and(ok) AS is_valid, coalesce(min(n) FILTER (WHERE NOT ok), count(*)) AS entries_checked, min(entry_sequence) FILTER (WHERE NOT ok) AS first_failure FROM w GROUP BY document_id"""),
    ("hc3_broken_documents", lambda v: hc.broken_documents(hc.tampered(hc.chained(v.manifest))), f"WITH RECURSIVE {_CHAIN} SELECT DISTINCT document_id FROM t WHERE sha256(prev_hash || entry_json) <> entry_hash"),
    ("hc4_backfill", lambda v: hc.backfill(v.docs, v.chunks, v.manifest).select("document_id", "k", "entry_type", "entry_json", "entry_hash"), """
WITH c AS (SELECT document_id, count(*) AS total, count(*) FILTER (WHERE level = 0) AS leaves, count(*) FILTER (WHERE level > 0) AS summaries, count(embedding) AS embedded FROM chunks GROUP BY 1),
j AS (SELECT document_id, '{"document": ' || document_id || '}' AS a, '{"leaves": ' || leaves || ', "summaries": ' || summaries || ', "total": ' || total || '}' AS b, '{"embedded": ' || embedded || '}' AS c
  FROM c JOIN docs d ON d.id = c.document_id WHERE document_id NOT IN (SELECT document_id FROM manifest)),
s AS (SELECT *, sha256(repeat('0', 64) || a) AS ha FROM j), s2 AS (SELECT *, sha256(ha || b) AS hb FROM s)
SELECT document_id, 0 AS k, 'registered' AS entry_type, a AS entry_json, ha AS entry_hash FROM s2 UNION ALL SELECT document_id, 1, 'chunk_created', b, hb FROM s2 UNION ALL SELECT document_id, 2, 'embedding_generated', c, sha256(hb || c) FROM s2"""),
    ("hc5_record_hash", lambda v: hc.record_hashes(_logs(v), "p").select("id", "record_hash"), f"WITH {_LOGS} SELECT id, sha256('p' || {_TEXT}) AS record_hash FROM l"),
    ("hc6_log_chain", lambda v: hc.log_chain(_logs(v)).select("chain_id", "id", "prev_hash", "record_hash"), f"WITH RECURSIVE {_LOG_CHAIN} SELECT chain_id, id, prev_hash, record_hash FROM h"),
    ("hc7_verify_log_chain", lambda v: hc.verify_log_chain(_changed_logs(v)), VERIFY_LOGS),
    ("hc8_split_retries", lambda v: hc.split_retries(v.exec_logs), """
SELECT id, trace_id, CASE WHEN sum(CASE WHEN split_part(node_name, ':', 1) = 'RepairPlanner' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY started_ms, id ROWS UNBOUNDED PRECEDING) >= 2
  THEN trace_id || '-retry' ELSE trace_id END AS new_chain FROM exec_logs"""),
    ("hc9_seal", lambda v: hc.seal(v.links.select("response_id", "chunk_id", "grounding_label"), "response_id"), """
WITH r AS (SELECT response_id % 16 AS bucket, sha256(chunk_id || chr(31) || grounding_label || chr(31) || response_id) AS h FROM links),
s AS (SELECT bucket, left(h, 3) AS start, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS part FROM r GROUP BY 1, 2)
SELECT bucket, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(part, '' ORDER BY start)) AS digest FROM s GROUP BY bucket"""),
    ("hc10_fingerprint", lambda v: hc.fingerprint(v.run_log, ["response_id", "actual_variant", "actual_intent", "status"]).select("query_id", "fingerprint"), """
SELECT query_id, left(sha256(concat_ws(';', 'actual_intent=' || nullif(actual_intent, ''), 'actual_variant=' || nullif(actual_variant, ''), 'response_id=' || response_id, 'status=' || status)), 16) AS fingerprint FROM run_log"""),
]
