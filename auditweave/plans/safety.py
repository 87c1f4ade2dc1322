from pyspark.sql import functions as F

from ..operators import safety as c3

KEYWORDS = ("the", "and")  # stand for safety words in the invented prose
_W = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: length(w) > 3))"
_TEXTS = """gold AS (SELECT item_id % 12 AS thread_id, item_id AS id, text FROM benchmark), ex AS (SELECT conv_id % 12 AS thread_id, conv_id * 100 + turn AS id, text FROM conversations WHERE role = 'assistant')"""
_BEST = """aw AS (SELECT thread_id, id, unnest({w}) AS w FROM {a}), bw AS (SELECT thread_id, id AS other, unnest({w}) AS w FROM {b}), h AS (SELECT thread_id, id, max(n) AS most FROM (SELECT aw.thread_id, aw.id, other, count(*) AS n FROM aw JOIN bw ON aw.thread_id = bw.thread_id AND aw.w = bw.w GROUP BY ALL) GROUP BY ALL),
o AS (SELECT a.thread_id, a.id, len({w}) AS words, coalesce(most, 0) AS most FROM {a} a LEFT JOIN h ON h.thread_id = a.thread_id AND h.id = a.id)"""


def _best(a, b):
    return _BEST.format(a=a, b=b, w=_W.format("text"))


_PL = "pl AS (SELECT conv_id AS thread_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1), pt AS (SELECT p.thread_id, b.item_id AS protocol_id, b.text AS protocol FROM pl p JOIN benchmark b ON b.item_id % 20 = p.thread_id % 20)"
_R5 = "list_distinct(regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}_]{{5,}})'))"


def _gold(v):
    return v.benchmark.selectExpr("item_id % 12 AS thread_id", "item_id AS id", "text")


def _extracted(v):
    return v.conversations.filter("role = 'assistant'").selectExpr("conv_id % 12 AS thread_id", "conv_id * 100 + turn AS id", "text")


def _plans(v):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return v.conversations.groupBy(F.col("conv_id").alias("thread_id")).agg(text.alias("text"))


def _protocols(v):
    items = v.benchmark.select((F.col("item_id") % 20).alias("_k"), F.col("item_id").alias("protocol_id"), F.col("text").alias("protocol"))
    return v.conversations.select(F.col("conv_id").alias("thread_id")).distinct().withColumn("_k", F.col("thread_id") % 20).join(items, "_k").drop("_k")


def _ascii(v):
    """Plans and protocols in letters that \\w means alike in both engines."""
    clean = lambda c: F.regexp_replace(c, "[^\\x00-\\x7F]", " ")
    return _protocols(v).withColumn("protocol", clean("protocol")), _plans(v).withColumn("text", clean("text"))


_CLEAN = "cl AS (SELECT thread_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM pl), cp AS (SELECT thread_id, protocol_id, regexp_replace(protocol, '[^\\x00-\\x7F]', ' ', 'g') AS protocol FROM pt)"
_OK = f"sv AS (SELECT cl.thread_id, protocol_id, len(list_intersect({_R5.format('protocol')}, {_R5.format('text')})) >= 0.5 * len({_R5.format('protocol')}) AS ok FROM cl JOIN cp ON cp.thread_id = cl.thread_id)"

PLANS = [
    ("c3_1_gate_survival", lambda v: c3.gate_survival(v.flags.selectExpr("thread_id", "CASE WHEN id % 3 = 0 THEN 'OTHER' ELSE 'RISK' END AS gate_type", "CAST(id % 5 AS INT) AS n_protocols", "CASE id % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'EDITED' ELSE 'REJECTED' END AS decision")), """
WITH g AS (SELECT thread_id, greatest(id % 5, 1) AS u, id % 4 IN (0, 1) AS ok FROM flags WHERE id % 3 <> 0)
SELECT thread_id, CAST(sum(u) AS BIGINT) AS units, CAST(sum(CASE WHEN ok THEN u ELSE 0 END) AS BIGINT) AS survived, sum(CASE WHEN ok THEN u ELSE 0 END) / CAST(sum(u) AS DOUBLE) AS rate FROM g GROUP BY 1"""),
    ("c3_2_gate_impact", lambda v: c3.gate_impact(v.evals), """
WITH r AS (SELECT response_id, attempt_number AS n, CASE badge WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 WHEN 'green' THEN 2 ELSE -1 END AS k FROM evals), d AS (SELECT b.k - a.k AS d FROM r a JOIN r b ON a.response_id = b.response_id AND a.n = 1 AND b.n = 2)
SELECT count(*) AS pairs, round(avg(d), 6) AS mean_delta, count(*) FILTER (WHERE d > 0) AS improved, count(*) FILTER (WHERE d < 0) AS worse, count(*) FILTER (WHERE d > 0) / CAST(count(*) AS DOUBLE) AS improvement_rate FROM d"""),
    ("c3_3_extraction_recall", lambda v: c3.extraction_recall(_gold(v), _extracted(v)), f"""
WITH {_TEXTS}, {_best('gold', 'ex')} SELECT thread_id, count(*) AS gold, count(*) FILTER (WHERE (words = 0 OR most >= 0.5 * words) AND thread_id IN (SELECT thread_id FROM ex)) AS matched,
  count(*) FILTER (WHERE (words = 0 OR most >= 0.5 * words) AND thread_id IN (SELECT thread_id FROM ex)) / CAST(count(*) AS DOUBLE) AS recall FROM o GROUP BY 1"""),
    ("c3_4_extraction_precision", lambda v: c3.extraction_precision(_gold(v), _extracted(v)), f"""
WITH {_TEXTS}, {_best('ex', 'gold')} SELECT thread_id, count(*) AS extracted, count(*) FILTER (WHERE words > 0 AND most >= 0.4 * words) AS matched, count(*) FILTER (WHERE words > 0 AND most >= 0.4 * words) / CAST(count(*) AS DOUBLE) AS precision FROM o GROUP BY 1"""),
    ("c3_5_hallucination_rate", lambda v: c3.hallucination_rate(v.conversations.filter("role = 'assistant'").selectExpr("conv_id AS thread_id", "text"), v.conversations.filter("role = 'user'").selectExpr("conv_id AS thread_id", "text"), KEYWORDS), f"""
WITH l AS (SELECT conv_id AS thread_id, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE role = 'assistant'), a AS (SELECT thread_id, line, {_W.format('line')} AS w FROM l WHERE length(trim(line)) > 20 AND regexp_matches(lower(line), 'the|and')),
k AS (SELECT thread_id, list_distinct(flatten(list({_W.format('text')}))) AS known FROM (SELECT conv_id AS thread_id, text FROM conversations WHERE role = 'user') GROUP BY 1), r AS (SELECT a.thread_id, len(w) > 0 AND len(list_intersect(w, coalesce(known, []))) < 0.4 * len(w) AS bad FROM a LEFT JOIN k ON k.thread_id = a.thread_id)
SELECT thread_id, count(*) AS lines, count(*) FILTER (WHERE bad) AS hallucinated, count(*) FILTER (WHERE bad) / CAST(count(*) AS DOUBLE) AS rate FROM r GROUP BY 1"""),
    ("c3_6_survives", lambda v: _ascii(v)[1].join(_ascii(v)[0], "thread_id").select("thread_id", "protocol_id", c3.survives(F.col("protocol"), F.col("text")).alias("ok")), f"WITH {_PL}, {_CLEAN}, {_OK} SELECT thread_id, protocol_id, ok FROM sv"),
    ("c3_7_c3_9_gate_verdict", lambda v: c3.gate_verdict(*_ascii(v)), f"""
WITH {_PL}, {_CLEAN}, {_OK}, n AS (SELECT cl.thread_id, count(sv.ok) AS n, count(*) FILTER (WHERE ok) AS k, coalesce(list_sort(list(DISTINCT protocol_id) FILTER (WHERE NOT ok)), []) AS lost FROM cl LEFT JOIN sv ON sv.thread_id = cl.thread_id GROUP BY 1)
SELECT thread_id, n AS protocols, k AS survived, k / CAST(nullif(n, 0) AS DOUBLE) AS coverage, CASE WHEN n = 0 THEN 'skip' WHEN k / CAST(n AS DOUBLE) >= 0.85 THEN 'pass' ELSE 'fail' END AS verdict, array_to_string(list_slice(lost, 1, 5), ',') AS missing FROM n"""),
    ("c3_8_inline_presence", lambda v: c3.inline_presence(_protocols(v), _plans(v)), f"""
WITH {_PL}, w AS (SELECT p.thread_id, protocol_id, lower(text) AS plan, list_filter(list_transform(regexp_split_to_array(lower(protocol), '\\s+'), lambda x: regexp_replace(x, '[.,;:!?()]', '', 'g')), lambda x: length(x) > 3) AS w FROM pl p JOIN pt ON pt.thread_id = p.thread_id)
SELECT thread_id, protocol_id, len(w) = 0 OR len(list_filter(w, lambda x: contains(plan, x))) >= 0.4 * len(w) AS is_present FROM w"""),
    ("c3_10_step_faithfulness", lambda v: c3.step_faithfulness(v.verdicts), "SELECT eval_id, count(*) AS steps, count(*) FILTER (WHERE inline_faithful) / CAST(count(*) AS DOUBLE) AS faithfulness FROM verdicts GROUP BY 1"),
]
