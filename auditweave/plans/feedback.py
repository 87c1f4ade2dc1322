from pyspark.sql import functions as F

from ..operators import feedback as l3

_CACHE = """u AS (SELECT DISTINCT chunk_id, response_id FROM links), th AS (SELECT chunk_id, count(*) AS n_thumbs, count(*) FILTER (WHERE feedback_type = 'UP') AS n_up, sum(CASE WHEN feedback_type = 'UP' THEN CASE WHEN weight = 0 THEN 1 ELSE weight END ELSE 0 END) AS up,
  sum(CASE WHEN feedback_type = 'UP' THEN 0 ELSE CASE WHEN weight = 0 THEN 1 ELSE weight END END) AS down FROM u JOIN resp_fb USING (response_id) WHERE NOT retracted GROUP BY 1),
sg AS (SELECT l.chunk_id, CASE action WHEN 'ACCEPT' THEN 1 WHEN 'INCORRECT' THEN -1 WHEN 'MODIFY' THEN -0.5e0 ELSE 0 END * CASE grounding_label WHEN 'verbatim' THEN 1 WHEN 'paraphrased' THEN 0.8e0 ELSE 0.5e0 END * CASE WHEN weight = 0 THEN 1 ELSE weight END AS s
  FROM links l JOIN step_fb f ON f.response_id = l.response_id AND f.step_index = l.step_index WHERE NOT retracted),
st AS (SELECT chunk_id, count(*) AS n_steps, count(*) FILTER (WHERE s > 0) AS n_plus, count(*) FILTER (WHERE s < 0) AS n_minus, sum(greatest(s, 0)) AS plus, sum(greatest(-s, 0)) AS minus FROM sg GROUP BY 1),
cache AS (SELECT coalesce(th.chunk_id, st.chunk_id) AS chunk_id, coalesce(n_thumbs, 0) AS n_thumbs, coalesce(n_steps, 0) AS n_steps, round(coalesce(up, 0) + coalesce(plus, 0), 6) AS positive, round(coalesce(down, 0) + coalesce(minus, 0), 6) AS negative,
  round(coalesce(up, 0) + coalesce(plus, 0) - coalesce(down, 0) - coalesce(minus, 0), 6) AS net, coalesce(n_up, 0) + coalesce(n_plus, 0) AS positive_count, coalesce(n_thumbs - n_up, 0) + coalesce(n_minus, 0) AS negative_count FROM th FULL JOIN st ON st.chunk_id = th.chunk_id)"""
_CAND = "cand AS (SELECT k.chunk_id, c.document_id, negative_count, positive_count, net FROM cache k JOIN chunks c ON c.id = k.chunk_id WHERE negative_count >= 5 AND (positive_count = 0 OR negative_count / CAST(nullif(positive_count, 0) AS DOUBLE) > 3) AND NOT is_blacklisted)"
_KAPPA = """n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE a = b) AS DOUBLE) AS o FROM p), x AS (SELECT coalesce(sum(CAST(na AS DOUBLE) * nb), 0) AS m FROM (SELECT a AS k, count(*) AS na FROM p GROUP BY 1) JOIN (SELECT b AS k, count(*) AS nb FROM p GROUP BY 1) USING (k)),
k AS (SELECT CAST(n AS BIGINT) AS pairs, CAST(o AS BIGINT) AS agreed, CASE WHEN n < 2 THEN NULL WHEN m / (n * n) >= 1 THEN 1.0 ELSE round((o / n - m / (n * n)) / (1 - m / (n * n)), 6) END AS kappa FROM n, x)
SELECT pairs, agreed, kappa, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' WHEN kappa IS NOT NULL THEN 'almost perfect' END AS band FROM k"""
_EV = "e AS (SELECT l_orderkey % 500 AS k, l_suppkey % 20 AS u, l_orderkey * 100000 + l_partkey * 8 + l_linenumber AS place, CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN 'DOWN' WHEN 5 THEN 'DOWN' ELSE 'UP' END AS v FROM lineitem)"


def _cache(v):
    return l3.chunk_cache(v.links, v.resp_fb, v.step_fb)


def _candidates(v):
    return l3.blacklist_candidates(_cache(v), v.chunks, 5, 3)


def _label_pairs(v):
    return v.resp_fb.join(v.evals.filter("attempt_number = 1"), "response_id").select(F.when(F.col("feedback_type") == "UP", "good").otherwise("bad").alias("a"), F.when(F.col("badge") == "green", "good").when(F.col("badge") != "gray", "bad").alias("b"))


def _events(v):
    value = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") >= 5, "DOWN").otherwise("UP")
    return v.lineitem.select((F.col("l_orderkey") % 500).alias("k"), (F.col("l_suppkey") % 20).alias("u"), (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("place"), value.alias("v"))


def _scored(v):
    return v.links.select("response_id", "id", "chunk_id", F.col("similarity_score").alias("score"))


PLANS = [
    ("l3_1_schema_coverage", lambda v: l3.schema_coverage(v.step_fb), """
WITH r AS (SELECT coalesce(correction_type IN ('WRONG_VALUE', 'WRONG_SEQUENCE', 'MISSING_STEP', 'WRONG_TOOL', 'SAFETY_VIOLATION', 'OUTDATED_PROCEDURE'), false) AS s FROM step_fb WHERE NOT retracted AND action IN ('MODIFY', 'INCORRECT'))
SELECT count(*) AS total, count(*) FILTER (WHERE s) AS structured, count(*) FILTER (WHERE NOT s) AS unstructured, round(count(*) FILTER (WHERE s) / CAST(count(*) AS DOUBLE), 4) AS coverage FROM r"""),
    ("l3_1_correction_distribution", lambda v: l3.correction_distribution(v.step_fb), "SELECT coalesce(correction_type, 'NULL') AS correction_type, count(*) AS n FROM step_fb WHERE NOT retracted AND action IN ('MODIFY', 'INCORRECT') GROUP BY 1"),
    ("l3_2_correction_entropy", lambda v: l3.correction_entropy(v.step_fb), """
WITH c AS (SELECT coalesce(correction_type, 'NULL') AS k, count(*) AS n FROM step_fb GROUP BY 1), t AS (SELECT count(*) AS kinds, CAST(sum(n) AS BIGINT) AS total, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c)
SELECT kinds, total, round(h, 6) AS entropy, round(CASE WHEN kinds <= 1 THEN 1.0 ELSE log2(kinds) END, 6) AS most, round(h / CASE WHEN kinds <= 1 THEN 1.0 ELSE log2(kinds) END, 6) AS normalised FROM t"""),
    ("l3_3_totals", lambda v: l3.totals(v.step_fb), """
SELECT count(*) AS total, count(DISTINCT response_id) AS responses, count(*) FILTER (WHERE action = 'ACCEPT') AS accept, count(*) FILTER (WHERE action = 'INCORRECT') AS incorrect, count(*) FILTER (WHERE action = 'MODIFY') AS modify,
  count(*) FILTER (WHERE action = 'SKIP') AS skip, count(*) FILTER (WHERE action IN ('MODIFY', 'INCORRECT')) AS corrections FROM step_fb"""),
    ("l3_4_concordance", lambda v: l3.concordance(v.resp_fb, v.evals), """
WITH r AS (SELECT feedback_type = 'UP' AS u, badge = 'green' AS g FROM resp_fb JOIN evals USING (response_id) WHERE attempt_number = 1 AND badge IN ('green', 'yellow', 'red'))
SELECT count(*) AS n, count(*) FILTER (WHERE u AND g) AS both_up, count(*) FILTER (WHERE NOT u AND NOT g) AS both_down, count(*) FILTER (WHERE NOT u AND g) AS too_lenient, count(*) FILTER (WHERE u AND NOT g) AS too_strict,
  count(*) FILTER (WHERE u = g) / CAST(count(*) AS DOUBLE) AS agreement FROM r"""),
    ("l3_5_correctness_vs_faithfulness", lambda v: l3.correctness_vs_faithfulness(v.resp_fb, v.evals), """
WITH r AS (SELECT correctness IN ('correct', 'partial') AS c, sync_faithfulness >= 0.7 AS f FROM resp_fb JOIN evals USING (response_id) WHERE attempt_number = 1 AND sync_faithfulness IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (WHERE c = f) AS agree, count(*) FILTER (WHERE NOT c AND f) AS faithful_but_wrong, count(*) FILTER (WHERE c = f) / CAST(count(*) AS DOUBLE) AS agreement FROM r"""),
    ("l3_6_label_kappa", lambda v: l3.label_kappa(_label_pairs(v)), f"WITH p AS (SELECT CASE feedback_type WHEN 'UP' THEN 'good' ELSE 'bad' END AS a, CASE badge WHEN 'green' THEN 'good' ELSE 'bad' END AS b FROM resp_fb JOIN evals USING (response_id) WHERE attempt_number = 1 AND badge <> 'gray'), {_KAPPA}"),
    ("l3_7_annotator_kappa", lambda v: l3.label_kappa(l3.annotator_pairs(v.step_fb), least=2), f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY response_id, step_index ORDER BY user_id) AS n FROM step_fb), p AS (SELECT x.action AS a, y.action AS b FROM o x JOIN o y ON x.response_id = y.response_id AND x.step_index = y.step_index AND x.n = 1 AND y.n = 2), {_KAPPA}"""),
    ("l3_8_response_feedback_fold", lambda v: l3.fold_toggles(_events(v), ["k", "u"], "place", "v"), f"""
WITH RECURSIVE {_EV}, o AS (SELECT *, row_number() OVER (PARTITION BY k, u ORDER BY place, v NULLS FIRST) AS n FROM e), s AS (SELECT DISTINCT k, u, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS state FROM e
UNION ALL SELECT s.k, s.u, o.n, CASE WHEN o.v IS NULL OR s.state IS NOT DISTINCT FROM o.v THEN NULL ELSE o.v END FROM s JOIN o ON o.k = s.k AND o.u = s.u AND o.n = s.n + 1)
SELECT k, u, state FROM (SELECT *, row_number() OVER (PARTITION BY k, u ORDER BY n DESC) AS last_n FROM s) WHERE last_n = 1"""),
    ("l3_9_step_feedback_fold", lambda v: l3.fold_upserts(_events(v), ["k", "u"], "place", "v"), f"WITH {_EV} SELECT k, u, v AS state FROM (SELECT *, row_number() OVER (PARTITION BY k, u ORDER BY place DESC, v DESC NULLS LAST) AS n FROM e) WHERE n = 1"),
    ("l3_10_chunk_cache", _cache, f"WITH {_CACHE} SELECT * FROM cache"),
    ("l3_11_feedback_boost", lambda v: l3.boosted(_scored(v), _cache(v)), f"""
WITH {_CACHE} SELECT response_id, l.id, l.chunk_id, similarity_score AS score, round(similarity_score + 0.05 * least(1, greatest(-1, coalesce(net / nullif(positive + abs(negative), 0), 0))), 6) AS adjusted FROM links l LEFT JOIN cache k ON k.chunk_id = l.chunk_id"""),
    ("l3_12_blacklist_candidates", _candidates, f"WITH {_CACHE}, {_CAND} SELECT chunk_id, document_id, negative_count, positive_count, net FROM cand"),
    ("l3_13_bulk_blacklist", lambda v: l3.blacklisted(v.chunks, _candidates(v))[1], f"WITH {_CACHE}, {_CAND} SELECT chunk_id, document_id, 'BLACKLIST' AS action FROM cand"),
    ("l3_14_unblacklist", lambda v: l3.unblacklisted(v.chunks, v.docs.filter("id % 2 = 0").select(F.col("id").alias("document_id"))).filter("is_blacklisted").select("id", "document_id"), "SELECT id, document_id FROM chunks WHERE is_blacklisted AND document_id % 2 <> 0"),
    ("l3_15_affected_summaries", lambda v: l3.affected_summaries(v.chunks), "SELECT document_id, id, level FROM chunks WHERE level > 0 AND document_id IN (SELECT document_id FROM chunks WHERE is_blacklisted AND level = 0)"),
    ("l3_16_quiet_hours", lambda v: l3.quiet_hours(v.threads, v.evals, v.resp_fb), """
WITH d AS (SELECT device, count(*) AS completed FROM threads WHERE state = 'COMPLETED' GROUP BY 1), o AS (SELECT DISTINCT response_id, device FROM evals JOIN threads t ON t.id = thread_id WHERE state = 'COMPLETED'),
f AS (SELECT device, count(*) AS feedback, sum(CASE WHEN feedback_type = 'UP' THEN weight ELSE 0 END) / sum(weight) AS positive FROM resp_fb JOIN o USING (response_id) WHERE NOT retracted GROUP BY 1)
SELECT device, completed, feedback, positive, coalesce(completed >= 10 AND feedback >= 10 AND positive > 0.9, false) AS is_eligible FROM d FULL JOIN f USING (device)"""),
    ("l3_17_retraction", lambda v: l3.retracted(v.resp_fb, v.resp_fb.filter("response_id % 50 = 0")).select("response_id", "user_id", "retracted"), "SELECT response_id, user_id, retracted OR response_id % 50 = 0 AS retracted FROM resp_fb"),
    ("l3_18_first_report", lambda v: l3.first_write(v.links.select("chunk_id", "response_id", "id"), ["chunk_id", "response_id"], "id"), "SELECT chunk_id, response_id, min(id) AS id FROM links GROUP BY 1, 2"),
    ("l3_19_thread_feedback", lambda v: l3.thread_feedback(v.evals, v.resp_fb, v.step_fb), """
WITH o AS (SELECT DISTINCT response_id, thread_id FROM evals), b AS (SELECT response_id, 'response' AS kind, feedback_type AS value FROM resp_fb WHERE NOT retracted UNION ALL SELECT response_id, 'step', action FROM step_fb WHERE NOT retracted)
SELECT thread_id, kind, value, count(*) AS n FROM b JOIN o USING (response_id) GROUP BY ALL"""),
]
