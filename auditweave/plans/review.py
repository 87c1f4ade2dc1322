import uuid

from pyspark.sql import functions as F

from ..operators import review as bd
from ..operators import search
from ..sources.tables import shared_folder

_LAST = "lb AS (SELECT thread_id, arg_max(badge, id) AS badge FROM evals GROUP BY 1)"


def _safety(v):
    return v.threads.selectExpr("id AS thread_id", "id % 4 AS n_basis", "id % 3 AS n_rules", "(id % 10) / 10.0D AS confidence", "id % 2 AS n_without_severity")


def _reviews(v):
    return v.evals.selectExpr(
        "id", "CASE id % 3 WHEN 0 THEN 'AUTO_SAFETY' WHEN 1 THEN 'AUTO_EVAL' ELSE 'MANUAL_FLAG' END AS source",
        "CASE WHEN response_id % 17 = 0 THEN array('PINCH_POINT', 'LOTO') WHEN response_id % 13 = 1 THEN array('PINCH_POINT') WHEN response_id % 2 = 0 THEN cast(array() AS array<string>) END AS risks",
        "response_id % 11 = 0 AS has_correction", "badge", "CASE response_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'green' END AS quality_badge", "CASE WHEN response_id % 19 = 3 THEN 'red' END AS safety_badge",
        "sync_faithfulness + 0.3D AS faithfulness", "sync_answer_relevance + 0.5D AS answer_relevance", "async_faithfulness + 0.5D AS context_relevance", "async_answer_relevance + 0.5D AS completeness",
    )


def _tasks(v):
    return v.flags.selectExpr("id", "concat('P', id % 4) AS priority", "CASE id % 5 WHEN 0 THEN 'RESOLVED' ELSE 'NEW' END AS status", "CASE WHEN id % 3 = 0 THEN id END AS snoozed_until", "id * 7 % 1000 AS created")


def _events(v):
    return v.exec_logs.selectExpr("thread_id AS task_id", "id AS place", "CASE id % 7 WHEN 0 THEN 'RESOLVE' WHEN 1 THEN 'SNOOZE' WHEN 2 THEN 'CLAIM' ELSE 'VIEW' END AS event")


def _orders(v):
    return v.orders.selectExpr("o_orderkey AS case_id", "o_custkey AS thread_id", "o_orderdate AS at")


def _badges(v):
    return v.evals.select("id", bd.composite_badge(F.col("badge"), F.when(F.col("id") % 3 == 0, "red").when(F.col("id") % 3 == 1, "none")).alias("badge"))


def _searched(v, term):
    """The index is built from all sessions, then one page of what holds the term."""
    path, columns = f"{shared_folder(v.spark)}/search-{uuid.uuid4().hex}", ["device", "id", "email"]
    search.build_index(v.threads, columns, path)
    hits = search.found(v.spark, path, columns, term)
    return search.review_queue(hits, v.evals, "APPROVED").select("id", "device", "email", "risk_tier", "is_escalated", "badge", "sync_faithfulness", "place", "total")


_SEARCHED = """
WITH e AS (SELECT thread_id, arg_max(badge, id) AS badge, max(id) AS last_id FROM evals GROUP BY 1), h AS (SELECT * FROM threads WHERE review_state = 'APPROVED' AND {how}),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY is_escalated DESC, risk_tier DESC NULLS LAST, created_s DESC, id) AS INT) AS place, count(*) OVER () AS total FROM h)
SELECT p.id, device, email, risk_tier, is_escalated, e.badge, x.sync_faithfulness, place, total FROM p LEFT JOIN e ON e.thread_id = p.id LEFT JOIN evals x ON x.id = e.last_id WHERE place <= 20"""

PLANS = [
    ("bd1_quality_badge", lambda v: bd.badged(v.evals, v.verdicts), """
WITH u AS (SELECT eval_id, count(*) FILTER (WHERE NOT inline_faithful) / CAST(count(*) AS DOUBLE) AS bad FROM verdicts GROUP BY 1),
b AS (SELECT id, coalesce(bad, 0) AS bad, CASE WHEN sync_faithfulness IS NULL OR sync_answer_relevance IS NULL THEN 'gray' WHEN sync_faithfulness < 0.4 OR sync_answer_relevance < 0.4 THEN 'red'
  WHEN sync_faithfulness < 0.7 OR sync_answer_relevance < 0.7 THEN 'yellow' ELSE 'green' END AS badge FROM evals LEFT JOIN u ON u.eval_id = id)
SELECT id, CASE WHEN badge = 'gray' THEN 'gray' WHEN bad >= 0.3 THEN 'red' WHEN bad > 0 AND badge = 'green' THEN 'yellow' ELSE badge END AS badge FROM b"""),
    ("bd2_safety_badge", lambda v: bd.safety_badges(_safety(v)), """
SELECT id AS thread_id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 3 = 0 THEN 'red' WHEN (id % 10) / 10.0e0 >= 0.5 AND id % 2 = 0 THEN 'green' WHEN (id % 10) / 10.0e0 >= 0.2 THEN 'yellow' ELSE 'red' END AS badge FROM threads"""),
    ("bd3_composite_badge", _badges, """
WITH r AS (SELECT id, CASE badge WHEN 'green' THEN 3 WHEN 'yellow' THEN 2 WHEN 'red' THEN 1 WHEN 'gray' THEN 0 END AS a, CASE WHEN id % 3 = 0 THEN 1 END AS b FROM evals)
SELECT id, CASE least(a, b) WHEN 3 THEN 'green' WHEN 2 THEN 'yellow' WHEN 1 THEN 'red' ELSE 'gray' END AS badge FROM r"""),
    ("bd4_bd5_review_priority", lambda v: bd.reviewed(_reviews(v)), """
WITH f AS (SELECT *, CAST(coalesce(sync_faithfulness + 0.3e0 < 0.6, false) AS INT) + CAST(coalesce(sync_answer_relevance + 0.5e0 < 0.6, false) AS INT) + CAST(coalesce(async_faithfulness + 0.5e0 < 0.6, false) AS INT)
  + CAST(coalesce(async_answer_relevance + 0.5e0 < 0.6, false) AS INT) AS k, CASE WHEN response_id % 5 = 1 THEN 'green' ELSE badge END AS q FROM evals),
p AS (SELECT id, CASE WHEN response_id % 17 = 0 OR sync_faithfulness + 0.3e0 < 0.3 OR (id % 3 = 1 AND q = 'red') THEN 'P0'
  WHEN response_id % 19 = 3 OR k >= 2 OR response_id % 13 = 1 OR (response_id % 11 = 0 AND id % 3 = 2) THEN 'P1' WHEN k = 1 OR (id % 3 = 2 AND q IN ('red', 'gray')) THEN 'P2' ELSE 'P3' END AS priority FROM f)
SELECT id, priority, CASE priority WHEN 'P0' THEN 4 WHEN 'P1' THEN 24 WHEN 'P2' THEN 72 ELSE 168 END AS sla_hours FROM p"""),
    ("bd6_task_queue", lambda v: bd.task_queue(_tasks(v), 500, 20, 1).select("id", "priority", "place", "total"), """
WITH t AS (SELECT id, 'P' || (id % 4) AS priority, id * 7 % 1000 AS created FROM flags WHERE id % 5 <> 0 AND (id % 3 <> 0 OR id <= 500))
SELECT * FROM (SELECT id, priority, CAST(row_number() OVER (ORDER BY priority, created, id) AS INT) AS place, count(*) OVER () AS total FROM t) WHERE place BETWEEN 21 AND 40"""),
    ("bd6_task_states", lambda v: bd.task_states(_events(v)), """
WITH RECURSIVE e AS (SELECT thread_id AS task_id, id % 7 AS k, row_number() OVER (PARTITION BY thread_id ORDER BY id) AS n FROM exec_logs),
s AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, 'NEW' AS state FROM e UNION ALL
  SELECT s.task_id, e.n, CASE WHEN k = 2 AND state IN ('NEW', 'SNOOZED') THEN 'CLAIMED' WHEN k = 1 AND state <> 'RESOLVED' THEN 'SNOOZED' WHEN k = 0 THEN 'RESOLVED' ELSE state END FROM s JOIN e ON e.task_id = s.task_id AND e.n = s.n + 1)
SELECT task_id, arg_max(state, n) AS state FROM s GROUP BY 1"""),
    ("bd7_session_queue", lambda v: bd.session_queue(v.threads, v.evals, "000001", 15, 0), f"""
WITH {_LAST} SELECT * FROM (SELECT id, device, is_escalated, badge, CAST(row_number() OVER (ORDER BY is_escalated DESC, id) AS INT) AS place, count(*) OVER () AS total
FROM threads LEFT JOIN lb ON lb.thread_id = id WHERE title ILIKE '%000001%' OR device ILIKE '%000001%') WHERE place <= 15"""),
    ("bd7_review_queue", lambda v: _searched(v, "_A@mail1"), _SEARCHED.format(how="contains(lower(coalesce(email, '')), '_a@mail1')")),
    ("bd7_short_term", lambda v: _searched(v, "\\"), _SEARCHED.format(how="contains(lower(coalesce(email, '')), chr(92))")),
    ("bd8_thread_list", lambda v: bd.thread_list(v.threads, v.evals, "COMPLETED", 25, 0), f"""
WITH {_LAST} SELECT * FROM (SELECT id, device, badge, CAST(row_number() OVER (ORDER BY id DESC) AS INT) AS place, count(*) OVER () AS total FROM threads LEFT JOIN lb ON lb.thread_id = id WHERE state = 'COMPLETED') WHERE place <= 25"""),
    ("bd9_evaluation_rows", lambda v: bd.page(v.evals.filter("badge = 'red'").select("id", "response_id"), [F.desc("id")], 200, 0), """
SELECT * FROM (SELECT id, response_id, CAST(row_number() OVER (ORDER BY id DESC) AS INT) AS place, count(*) OVER () AS total FROM evals WHERE badge = 'red') WHERE place <= 200"""),
    ("bd10_feedback_page", lambda v: bd.page(v.resp_fb.filter("not retracted").select("id", "feedback_type"), [F.desc("id")], 50, 2), """
SELECT * FROM (SELECT id, feedback_type, CAST(row_number() OVER (ORDER BY id DESC) AS INT) AS place, count(*) OVER () AS total FROM resp_fb WHERE NOT retracted) WHERE place BETWEEN 101 AND 150"""),
    ("bd11_thread_logs", lambda v: bd.listing(v.exec_logs, F.col("operation_type") == "llm_call", [F.col("thread_id"), F.col("started_ms"), F.col("id")], ["thread_id", "id", "node_name"]), "SELECT thread_id, id, node_name FROM exec_logs WHERE operation_type = 'llm_call'"),
    ("bd12_bd13_plan_text", lambda v: bd.plan_text(v.plans, v.plans.filter("thread_id % 2 = 0")), """
WITH p AS (SELECT thread_id, string_agg(text, chr(10) ORDER BY turn, text) AS text, count(*) AS n FROM plans GROUP BY 1)
SELECT thread_id, CASE WHEN n > 2 THEN 'repair_plan' WHEN n = 2 THEN 'informational' WHEN thread_id % 2 = 0 THEN 'follow_up' ELSE 'non_retrieval' END AS kind, length(text) AS n_chars, regexp_matches(lower(left(text, 200)), 'fail|error|unable') AS is_failed FROM p"""),
    ("bd14_flagged_threads", lambda v: bd.flagged_threads(v.threads, v.flags), """
WITH f AS (SELECT thread_id, arg_max(reason, id) AS reason, arg_max(status, id) AS status FROM flags GROUP BY 1) SELECT id, reason, status, is_escalated OR coalesce(status = 'PENDING', false) AS is_flagged FROM threads LEFT JOIN f ON f.thread_id = id"""),
    ("bd14_approve_pending", lambda v: bd.approve_pending(v.flags).select("id", "status", "was_pending"), "SELECT id, 'APPROVED' AS status, status = 'PENDING' AS was_pending FROM flags"),
    ("bd15_recent_unresolved", lambda v: bd.recent_unresolved(_orders(v), v.threads, "1998-01-01", "1998-12-31"), """
SELECT device, place, case_id FROM (SELECT device, o_orderkey AS case_id, CAST(row_number() OVER (PARTITION BY device ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS place
FROM orders JOIN threads ON id = o_custkey WHERE state <> 'ABANDONED' AND o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31') WHERE place <= 5"""),
    ("bd16_reports_with_user", lambda v: bd.reports_with_user(v.run_log, v.threads, v.customer), "SELECT query_id, device, c_name AS email FROM run_log LEFT JOIN threads ON threads.id = thread_id LEFT JOIN customer ON c_custkey = thread_id"),
    ("bd17_inline_view", lambda v: bd.inline_view(v.evals), """
SELECT response_id, CASE WHEN badge IN ('green', 'yellow', 'red') THEN badge ELSE 'red' END AS badge, sync_faithfulness FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY id DESC) AS n FROM evals) WHERE n = 1"""),
    ("bd18_terminal_state", lambda v: v.run_log.select("query_id", bd.terminal_state(F.coalesce("actual_intent", F.lit("")), F.col("query_id") % 10 == 0).alias("state")), """
SELECT query_id, CASE WHEN coalesce(actual_intent, '') IN ('troubleshoot', 'direct_replacement', 'replace_part') OR query_id % 10 = 0 THEN 'COMPLETED' ELSE 'ACTIVE' END AS state FROM run_log"""),
    ("bd19_flag_listing", lambda v: bd.listing(v.flags, F.col("reason") == "AUTO_SAFETY", [F.desc("id")], ["id", "thread_id", "status"]), "SELECT id, thread_id, status FROM flags WHERE reason = 'AUTO_SAFETY'"),
]
