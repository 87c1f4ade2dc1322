from pyspark.sql import functions as F

from ..operators import corpus as l1
from ..operators import provenance as xl

_RESOLVED = """r AS (
  SELECT l.*, c.id IS NOT NULL AS has_chunk, c.document_id, c.document_id IN (SELECT document_id FROM manifest) AS in_manifest
  FROM links l LEFT JOIN chunks c ON c.id = l.chunk_id), f AS (SELECT *, coalesce(in_manifest, false) AS has_manifest FROM r)"""
_COUNTS = """count(*) AS total, count(*) FILTER (WHERE has_chunk AND has_manifest) AS resolved, count(*) FILTER (WHERE NOT has_chunk) AS broken_chunk,
  count(*) FILTER (WHERE has_chunk AND NOT has_manifest) AS broken_manifest, count(*) FILTER (WHERE has_chunk AND has_manifest) / CAST(count(*) AS DOUBLE) AS completeness"""


def _resolved(v):
    return xl.resolved_links(v.links, v.chunks, v.manifest)


def _of_run(v):
    return _resolved(v).join(v.run_log.select("response_id", "variant", "safety_found"), "response_id")


def _documents(v):
    used = _resolved(v).filter("has_chunk").select("document_id").distinct()
    return used.join(l1.reconstructability(v.manifest, v.chunks), "document_id", "left").select("document_id", "manifest_count", "current_count", F.col("score").alias("reconstructability"))


PLANS = [
    ("xl1_thread_provenance", lambda v: xl.thread_provenance(v.evals, v.step_fb, v.links), """
WITH t AS (SELECT DISTINCT thread_id, response_id FROM evals), k AS (SELECT DISTINCT response_id FROM links), s AS (SELECT DISTINCT response_id, step_index FROM step_fb),
a AS (SELECT thread_id, count(*) AS steps, count(k.response_id) AS ok FROM t JOIN s USING (response_id) LEFT JOIN k ON k.response_id = t.response_id GROUP BY thread_id),
b AS (SELECT thread_id, count(k.response_id) AS linked FROM t LEFT JOIN k ON k.response_id = t.response_id GROUP BY thread_id)
SELECT thread_id, coalesce(steps, linked) AS total_steps, coalesce(ok, linked) AS traceable_steps, steps IS NULL AS is_fallback,
  coalesce(coalesce(ok, linked) / CAST(nullif(coalesce(steps, linked), 0) AS DOUBLE), 0.0) AS score FROM b LEFT JOIN a USING (thread_id)"""),
    ("xl2_safety_completeness", lambda v: xl.safety_completeness(v.evals, v.links, v.chunks, v.docs), """
WITH r AS (SELECT e.thread_id, coalesce(c.has_safety_content, false) AS s, d.id IS NOT NULL AS ok FROM evals e JOIN links l ON l.response_id = e.response_id
  LEFT JOIN chunks c ON c.id = l.chunk_id LEFT JOIN docs d ON d.id = c.document_id)
SELECT thread_id, count(*) AS links, count(*) FILTER (WHERE s) AS safety_links, count(*) FILTER (WHERE s AND ok) AS resolved,
  CASE WHEN count(*) FILTER (WHERE s) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE s AND ok) / CAST(count(*) FILTER (WHERE s) AS DOUBLE) END AS score FROM r GROUP BY thread_id"""),
    ("xl3_links_to_chunks", lambda v: xl.links_to_chunks(v.links, v.chunks), """
SELECT count(*) AS total, count(c.id) AS valid, count(c.id) / CAST(count(*) AS DOUBLE) AS score FROM links l LEFT JOIN chunks c ON c.id = l.chunk_id"""),
    ("xl4_feedback_to_verdicts", lambda v: xl.feedback_to_verdicts(v.step_fb, v.verdict_json), """
WITH f AS (SELECT * FROM step_fb WHERE NOT retracted), e AS (SELECT response_id, json_array_length(step_verdicts) AS n FROM verdict_json WHERE CASE WHEN json_valid(step_verdicts) THEN json_type(step_verdicts) = 'ARRAY' ELSE false END),
r AS (SELECT f.step_index >= 0 AND f.step_index < e.n AS ok FROM f JOIN e USING (response_id))
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS out_of_range,
  (SELECT count(*) FROM f WHERE response_id NOT IN (SELECT response_id FROM evals)) AS without_evaluation,
  round(count(*) FILTER (WHERE ok) / CAST(count(*) + (SELECT count(*) FROM f WHERE response_id NOT IN (SELECT response_id FROM evals)) AS DOUBLE), 4) AS score FROM r"""),
    ("xl5_provenance_completeness", lambda v: xl.completeness(_resolved(v)), f"WITH {_RESOLVED} SELECT {_COUNTS} FROM f"),
    ("xl6_completeness_by_variant", lambda v: xl.completeness(_of_run(v), "variant"), f"WITH {_RESOLVED} SELECT variant, {_COUNTS} FROM f JOIN run_log g ON g.response_id = f.response_id GROUP BY variant"),
    ("xl7_safety_provenance", lambda v: xl.completeness(_of_run(v).filter("safety_found")), f"WITH {_RESOLVED} SELECT {_COUNTS} FROM f JOIN run_log g ON g.response_id = f.response_id WHERE g.safety_found"),
    ("xl8_feedback_chain", lambda v: xl.feedback_chain(v.step_fb, v.evals, _resolved(v)), f"""
WITH {_RESOLVED}, c AS (SELECT response_id, bool_or(has_chunk) AS doc, bool_or(has_chunk AND has_manifest) AS full_chain FROM f GROUP BY response_id)
SELECT CASE WHEN s.response_id NOT IN (SELECT response_id FROM evals) THEN 'evaluation' WHEN doc IS NULL THEN 'link' WHEN NOT doc THEN 'document' WHEN NOT full_chain THEN 'manifest' ELSE 'full' END AS broken_at,
  count(*) AS n FROM step_fb s LEFT JOIN c ON c.response_id = s.response_id GROUP BY 1"""),
    ("xl9_corrected_documents", lambda v: xl.corrected_documents(v.step_fb, v.links, v.chunks), """
SELECT DISTINCT c.document_id FROM step_fb s JOIN links l ON l.response_id = s.response_id JOIN chunks c ON c.id = l.chunk_id WHERE s.action IN ('MODIFY', 'INCORRECT')"""),
    ("xl10_feedback_sanity", lambda v: xl.feedback_sanity(v.step_fb, v.evals), """
SELECT count(*) AS total, count(*) FILTER (WHERE response_id IN (SELECT response_id FROM evals)) AS with_evaluation, count(DISTINCT response_id) AS responses FROM step_fb"""),
    ("xl11_referenced_documents", _documents, """
WITH u AS (SELECT DISTINCT c.document_id FROM links l JOIN chunks c ON c.id = l.chunk_id), m AS (SELECT document_id, arg_max(total_chunks, entry_sequence) AS n FROM manifest WHERE entry_type = 'chunk_created' GROUP BY 1),
k AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1)
SELECT u.document_id, m.n AS manifest_count, CASE WHEN m.n IS NOT NULL THEN k.n END AS current_count, CASE WHEN m.n IS NULL THEN NULL WHEN m.n = 0 AND k.n = 0 THEN 1.0 ELSE least(m.n, k.n) / CAST(greatest(m.n, k.n) AS DOUBLE) END AS reconstructability
FROM u LEFT JOIN m USING (document_id) LEFT JOIN k USING (document_id)"""),
    ("xl13_trace_order", lambda v: xl.trace_order(v.links, v.chunks, v.run_log), """
SELECT l.response_id, l.id, CAST(row_number() OVER (PARTITION BY l.response_id ORDER BY CASE WHEN coalesce(starts_with(retrieval_path, 'full_'), false) THEN sequence_index END ASC NULLS LAST,
  CASE WHEN NOT coalesce(starts_with(retrieval_path, 'full_'), false) THEN similarity_score END DESC NULLS LAST, l.id) AS INT) AS place FROM links l JOIN chunks c ON c.id = l.chunk_id LEFT JOIN run_log g ON g.response_id = l.response_id"""),
]
