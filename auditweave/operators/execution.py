"""L2: what the execution logs and evaluations tell about each thread, response and node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import variant as vt
from ..functions.columns import kappa, share


def meta(path: str) -> Column:
    return F.get_json_object("metadata", f"$.{path}")


def base_name(node: str = "node_name") -> Column:
    return F.split(F.col(node), ":")[0]


def ranked(df: DataFrame, value: str, *by: str) -> DataFrame:
    """`df` with n, the values of the group, and place, from 1 in rising order."""
    order = Window.partitionBy(*by).orderBy(value)
    return df.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))


def logged_chunks(logs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct elements of the arrays under retrieved_chunk_ids in any row, those that exist, and their share to 4 places (1 if none was logged).

    A JSON null among the elements is one id that does not exist; values that are no arrays have no elements.
    """
    listed = vt.elements(vt.parsed("metadata"), "$.retrieved_chunk_ids", "string")
    ids = logs.select(F.explode(listed).alias("id")).distinct()
    found = ids.join(chunks.select("id", F.lit(True).alias("known")), "id", "left")
    rate = F.round(F.coalesce(share(F.count_if("known"), F.count("*")), F.lit(1.0)), 4)
    return found.agg(F.count("*").alias("logged"), F.count_if("known").alias("existing"), F.count_if(F.col("known").isNull()).alias("broken"), rate.alias("score"))


def required_nodes(logs: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Per thread the required nodes that are present and missing, sorted."""
    need = F.array(*[F.lit(x) for x in required])
    seen = logs.groupBy("thread_id").agg(F.collect_set(F.when(base_name().isin(*required), base_name())).alias("seen"))
    present = F.array_sort(F.array_intersect(need, F.col("seen")))
    return seen.select(
        "thread_id", F.array_join(present, ",").alias("present"), F.array_join(F.array_sort(F.array_except(need, F.col("seen"))), ",").alias("missing"), (F.size(present) / len(required)).alias("score")
    )


def escalation_rate(threads: DataFrame, flags: DataFrame) -> DataFrame:
    auto = flags.filter(F.col("reason").isin("AUTO_SAFETY", "AUTO_EVAL")).select(F.col("thread_id").alias("id"), F.lit(True).alias("auto")).distinct()
    hit = F.coalesce("is_escalated", F.lit(False)) | F.coalesce("auto", F.lit(False))
    rows = threads.join(auto, "id", "left")
    return rows.agg(F.count("*").alias("total"), F.count_if(hit).alias("escalated"), share(F.count_if(hit), F.count("*")).alias("rate"))


def escalation_latency(done: DataFrame, evals: DataFrame, *by: str) -> DataFrame:
    """Seconds from the answer (done: thread_id, done_s) to the shadow evaluation (evals: thread_id, completed_s); p95 is an exact rank."""
    rows = done.join(evals, "thread_id").withColumn("delay", F.col("completed_s") - F.col("done_s")).filter("delay >= 0")
    at = F.greatest(F.lit(0), F.floor(F.col("n") * 0.95).cast("int") - 1) + 1
    return ranked(rows, "delay", *by).groupBy(*by).agg(
        F.count("*").alias("pairs"), F.round(F.avg("delay"), 2).alias("mean"), F.min("delay").alias("least"), F.max("delay").alias("most"), F.max(F.when(F.col("place") == at, F.col("delay"))).alias("p95")
    )


DIMENSIONS = ("faithfulness", "answer_relevance", "context_relevance", "completeness")


def calibration_drift(evals: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Mean of sync - async where both stand, to 4 places, of each dimension, and as `overall` the mean of those rounded means."""
    pairs = ", ".join(f"'{d}', sync_{d} - async_{d}" for d in dimensions)
    rows = evals.selectExpr(f"stack({len(dimensions)}, {pairs}) AS (dimension, delta)")
    each = rows.groupBy("dimension").agg(F.count("delta").alias("pairs"), F.round(F.avg("delta"), 4).alias("drift"))
    overall = each.agg(F.lit("overall").alias("dimension"), F.sum("pairs").alias("pairs"), F.round(F.avg("drift"), 4).alias("drift"))
    return each.unionByName(overall)


def verdict_kappa(evals: DataFrame) -> DataFrame:
    """Cohen's kappa of inline verdicts (step_verdicts) and shadow verdicts (async_evidence.step_cross_validation.verdicts), pooled over all evaluations.

    A verdict without `faithful` is faithful; an inline verdict meets the shadow verdict of its position, or, where there is none, that of its own
    step_index; of several shadow verdicts of a step (-1 where it has none) the last counts. A shadow verdict of JSON null is none, an inline one is not faithful.
    """
    both = evals.select("id", vt.parsed("step_verdicts").alias("sv"), vt.parsed("async_evidence").alias("ae"))
    both = both.filter(F.col("sv").isNotNull() & vt.has("ae", "$.step_cross_validation"))
    index = lambda c, other: F.when(vt.has(c, "$.step_index"), vt.number(c, "$.step_index", "int")).otherwise(other)
    is_object = vt.kind(F.col("x")) == "object"
    inline = both.select("id", F.posexplode(vt.elements("sv")).alias("pos", "x")).filter(is_object)
    inline = inline.select("id", "pos", index("x", F.col("pos")).alias("own"), F.coalesce(vt.flag(F.col("x"), "faithful"), F.lit(False)).alias("inline"))
    shadow = both.select("id", F.posexplode(vt.elements("ae", "$.step_cross_validation.verdicts")).alias("pos", "x")).filter(is_object)
    told = F.max_by(F.struct(vt.flag(F.col("x"), "faithful").alias("flag")), "pos")
    shadow = shadow.groupBy(F.col("id").alias("of"), index("x", F.lit(-1)).alias("step")).agg(told.alias("told"))
    at = lambda name, key: shadow.select(F.col("of").alias(f"{name}_of"), F.col("step").alias(f"{name}_step"), F.col("told").alias(name))  # noqa: E731, ARG005
    rows = inline.join(at("first", "pos"), (F.col("id") == F.col("first_of")) & (F.col("pos") == F.col("first_step")), "left")
    rows = rows.join(at("second", "own"), (F.col("id") == F.col("second_of")) & (F.col("own") == F.col("second_step")), "left")
    a, b = F.col("inline"), F.when(F.col("first").isNotNull(), F.col("first.flag")).otherwise(F.col("second.flag"))
    cells = rows.filter(b.isNotNull()).agg(
        F.count("*").alias("steps"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"), F.count_if(a & ~b).alias("inline_only"), F.count_if(~a & b).alias("shadow_only")
    )
    d = lambda c: F.col(c).cast("double")
    n, yes_a, yes_b = d("steps"), d("both") + d("inline_only"), d("both") + d("shadow_only")
    expected = share(yes_a * yes_b + (n - yes_a) * (n - yes_b), n * n)
    found = cells.withColumn("observed", F.round(share(d("both") + d("neither"), n), 4)).withColumn("expected", F.round(expected, 4))
    value = F.when(n > 0, F.round(kappa(d("both") + d("neither"), n, yes_a * yes_b, (n - yes_a) * (n - yes_b)), 4))
    return found.withColumn("kappa", value).crossJoin(F.broadcast(both.agg(F.count("*").alias("evaluations"))))  # one row each


def step_kappa(verdicts: DataFrame) -> DataFrame:
    """Inline against shadow verdicts of the steps that both have, pooled."""
    a, b = F.col("inline_faithful"), F.col("shadow_faithful")
    cells = verdicts.filter("inline_faithful is not null and shadow_faithful is not null").agg(
        F.count("*").alias("pairs"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"), F.count_if(a & ~b).alias("inline_only"), F.count_if(~a & b).alias("shadow_only")
    )
    d = lambda c: F.col(c).cast("double")
    n, yes_a, yes_b = d("pairs"), d("both") + d("inline_only"), d("both") + d("shadow_only")
    return cells.withColumn("kappa", F.round(kappa(d("both") + d("neither"), n, yes_a * yes_b, (n - yes_a) * (n - yes_b)), 6))


SAFETY_INTENTS = ("troubleshoot", "replace_part", "procedural")


def routing_by_edges(logs: DataFrame, router: str = "route_from_knowledge") -> DataFrame:
    """The router's edge rows: should the intent reach safety evaluation, and did it? No intent should not; a missing target counts as reached."""
    rows = logs.filter((F.col("node_name") == router) & F.col("metadata").isNotNull()).select(
        F.coalesce(F.lower(meta("intent")).isin(*SAFETY_INTENTS), F.lit(False)).alias("should"), F.coalesce(meta("target") != "skip_safety_eval", F.lit(True)).alias("did")
    )
    return _routing(rows)


def routing_by_nodes(logs: DataFrame, safety_nodes: tuple[str, ...], classifier: str = "IntentRouter") -> DataFrame:
    """The classifier's records, and whether a safety node ran in their thread. No intent should not reach one."""
    safe = logs.filter(base_name().isin(*safety_nodes)).select("thread_id", F.lit(True).alias("ran")).distinct()
    rows = logs.filter((base_name() == classifier) & F.col("metadata").isNotNull()).select("thread_id", F.lower(meta("intent")).alias("intent"))
    return _routing(rows.join(safe, "thread_id", "left").select(F.coalesce(F.col("intent").isin(*SAFETY_INTENTS), F.lit(False)).alias("should"), F.coalesce("ran", F.lit(False)).alias("did")))


def _routing(rows: DataFrame) -> DataFrame:
    right = F.count_if(F.col("should") == F.col("did"))
    return rows.agg(F.count("*").alias("total"), right.alias("correct"), F.count_if(F.col("should") & ~F.col("did")).alias("missed"), share(right, F.count("*")).alias("score"))


def complement_rate(logs: DataFrame) -> DataFrame:
    """Of the SafetyExtractor's node rows that have both keys: mean share of path B's chunks that path A lacked, to 4 places; null of no rows, 0 where B is empty everywhere."""
    rows = logs.filter("node_name = 'SafetyExtractor' and operation_type = 'node'").select(vt.parsed("metadata").alias("m"))
    rows = rows.filter(vt.has("m", "$.complement_count") & vt.has("m", "$.path_b_count")).select(vt.number("m", "$.path_b_count").alias("b"), vt.number("m", "$.complement_count").alias("c"))
    b = F.col("b")
    rate = F.round(F.coalesce(F.avg(F.when(b > 0, F.col("c") / b)), F.lit(0.0)), 4)
    return rows.agg(F.count("*").alias("rows"), F.count_if(b > 0).alias("with_path_b"), F.when(F.count("*") > 0, rate).alias("rate"))


def short_circuit_rate(logs: DataFrame) -> DataFrame:
    """Decisions after the rule check, those with has_override = true (also as a text), and their share to 4 places (0 of none)."""
    rows = logs.filter("node_name = 'edge:route_from_deterministic_check' and operation_type = 'edge_decision'")
    hits = F.count_if(F.coalesce(vt.text(vt.parsed("metadata"), "$.has_override") == "true", F.lit(False)))
    return rows.agg(F.count("*").alias("total"), hits.alias("hits"), F.round(F.coalesce(share(hits, F.count("*")), F.lit(0.0)), 4).alias("rate"))


def thread_rate(logs: DataFrame, condition: Column) -> DataFrame:
    """Threads with a row for which `condition` holds / threads."""
    per = logs.groupBy("thread_id").agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("hit"))
    return per.agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"), share(F.count_if("hit"), F.count("*")).alias("rate"))


def path_distribution(logs: DataFrame) -> DataFrame:
    counts = logs.filter(meta("retrieval_path").isNotNull()).groupBy(meta("retrieval_path").alias("path")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("path", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))  # one row


def decision_rate(logs: DataFrame, edge: str, decision: str) -> DataFrame:
    """The edge's decisions, those for `decision`, and their share to 4 places (0 of none)."""
    rows = logs.filter((F.col("node_name") == edge) & (F.col("operation_type") == "edge_decision"))
    hits = F.count_if(F.coalesce(meta("decision") == decision, F.lit(False)))
    return rows.agg(F.count("*").alias("total"), hits.alias("hits"), F.round(F.coalesce(share(hits, F.count("*")), F.lit(0.0)), 4).alias("rate"))


def retry_rate(logs: DataFrame, planner: str = "RepairPlanner") -> DataFrame:
    """Threads with a planner row that is a retry or a later attempt / threads with a planner row."""
    rows = logs.filter((base_name() == planner) & F.col("operation_type").isin("llm_call", "node"))
    n, again = F.count_distinct("thread_id"), F.count_distinct(F.when(F.col("is_retry") | (meta("attempt_number").cast("int") > 1), F.col("thread_id")))
    return rows.agg(n.alias("threads"), again.alias("retried"), share(again, n).alias("rate"))


GATES = ("edge:route_from_safety_judge", "edge:route_from_inline_evaluator")


def retry_triggers(logs: DataFrame, gates: tuple[str, str] = GATES, planner: str = "RepairPlanner") -> DataFrame:
    """Decisions of either gate that send the answer back to the planner, and their shares to 4 places (null of none)."""
    rows = logs.filter((F.col("operation_type") == "edge_decision") & F.col("node_name").isin(*gates) & (meta("decision") == planner))
    a, b = (F.count_if(F.col("node_name") == g) for g in gates)
    return rows.agg(a.alias("by_first"), b.alias("by_second"), F.round(share(a, a + b), 4).alias("first_share"), F.round(share(b, a + b), 4).alias("second_share"))


def execution_summary(logs: DataFrame, *by: str) -> DataFrame:
    calls = logs.filter("operation_type = 'llm_call'")
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("latency_ms", F.lit(0))).alias("latency_ms"))


def natural_retries(logs: DataFrame) -> DataFrame:
    return logs.groupBy("trace_id").agg(F.count_distinct("chain_id").alias("chains")).filter("chains > 1")


def rerun_candidates(runs: DataFrame, most: int = 5) -> DataFrame:
    """The first green runs, by query, that went through the whole troubleshooting path."""
    return runs.filter("trace_variant = 'troubleshoot_full' and badge = 'green'").orderBy("query_id").limit(most)


def overhead(runs: DataFrame, value: str, by: str) -> DataFrame:
    """Per group count, median, mean and p95 (the value at int(0.95 n) in rising order, from 0)."""
    at = F.floor(F.col("n") * 0.95).cast("int") + 1
    return ranked(runs, value, by).groupBy(by).agg(
        F.count("*").alias("runs"), F.median(value).alias("median"), F.round(F.avg(value), 3).alias("mean"), F.max(F.when(F.col("place") == at, F.col(value))).alias("p95")
    )


def overhead_difference(runs: DataFrame, value: str, is_with: Column) -> DataFrame:
    """Medians with and without, their difference, and that in percent of the latter (0 where that is 0)."""
    of = lambda c, name: [F.count_if(c).alias(f"n_{name}"), F.median(F.when(c, F.col(value))).alias(f"{name}_median")]
    found = runs.agg(*of(is_with, "with"), *of(~is_with, "without"))
    over = F.col("with_median") - F.col("without_median")
    return found.withColumn("overhead", over).withColumn("overhead_percent", F.when(F.col("without_median") == 0, 0.0).otherwise(F.round(100 * over / F.col("without_median"), 6)))


def run_summary(run_log: DataFrame) -> DataFrame:
    """Runs, passes, matching intents (both missing match), shadow evaluations done and possible, and times."""
    return run_log.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("actual_intent").eqNullSafe(F.col("expected_intent"))).alias("intent_match"), F.count_if("shadow_completed").alias("shadow_done"), F.count("response_id").alias("shadow_eligible"),
        F.min("duration_ms").alias("fastest"), F.max("duration_ms").alias("slowest"), F.sum("duration_ms").alias("total_ms"), F.sum("stream_ms").alias("stream_ms"),
    )


def badge_counts(run_log: DataFrame) -> DataFrame:
    """Runs of each badge; those without one are left out."""
    return run_log.filter("badge <> ''").groupBy("badge").agg(F.count("*").alias("runs"))


def step_agreement(verdicts: DataFrame) -> DataFrame:
    """Per evaluation the steps that both have, those that agree, the rate to 3 places (1 of none) and the others' numbers."""
    both = F.col("inline_faithful").isNotNull() & F.col("shadow_faithful").isNotNull()
    same = both & (F.col("inline_faithful") == F.col("shadow_faithful"))
    odd = F.array_join(F.array_sort(F.collect_list(F.when(both & ~same, F.col("step_index")))), ",")
    out = verdicts.groupBy("eval_id").agg(F.count_if(both).alias("steps"), F.count_if(same).alias("agreed"), odd.alias("disagreements"))
    return out.withColumn("rate", F.round(F.coalesce(share(F.col("agreed"), F.col("steps")), F.lit(1.0)), 3))


def latest(df: DataFrame, by: str, order: str = "id") -> DataFrame:
    """The whole row with the largest `order` of each `by`: one shuffle, no self-join."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("row")).select(by, "row.*")


def patch_latest(evals: DataFrame, patches: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Late scores written onto the latest evaluation of their response; only those present overwrite."""
    newest = evals.groupBy("response_id").agg(F.max("id").alias("_last"))
    renamed = patches.select("response_id", *[F.col(c).alias(f"_{c}") for c in columns])
    rows = evals.join(newest, "response_id").join(renamed, "response_id", "left")
    is_last = F.col("id") == F.col("_last")
    return rows.select(*[F.when(is_last & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in evals.columns])


def evaluator_deltas(evals: DataFrame, dimensions: tuple[str, ...] = ("faithfulness", "answer_relevance"), limit: float = 0.15) -> DataFrame:
    pairs = ", ".join(f"'{d}', sync_{d}, async_{d}" for d in dimensions)
    rows = evals.selectExpr("id", f"stack({len(dimensions)}, {pairs}) AS (dimension, inline, shadow)").filter("inline is not null and shadow is not null")
    return rows.select("id", "dimension", F.round(F.col("inline") - F.col("shadow"), 4).alias("delta")).withColumn("is_flagged", F.abs("delta") > limit)


def node_sequence(logs: DataFrame) -> DataFrame:
    """Per trace its nodes by first appearance, cut at the colon; edges and dispatchers are left out."""
    name = base_name()
    first = logs.filter((F.col("operation_type") != "edge_decision") & ~name.endswith("_dispatch")).groupBy("trace_id", name.alias("node")).agg(F.min(F.struct("started_ms", "id")).alias("at"))
    return first.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]), ">").alias("nodes"))


def routing_facts(logs: DataFrame, preview: int = 200) -> DataFrame:
    """Per trace what the earliest record of each of three nodes tells: the router's rationale, whether the unsafe-method gate ran with reason and
    redirection, and the matched rule with its keywords and the start of its response. Empty and missing values tell nothing."""
    m = F.col("m")
    told = lambda key: F.nullif(vt.text(m, f"$.{key}"), F.lit(""))
    true = lambda key: F.coalesce(vt.number(m, f"$.{key}", "boolean"), F.lit(False))
    intent, decision = told("classified_intent"), told("routing_decision")
    parts = F.concat_ws(
        " | ", F.concat(F.lit("Classified intent: "), intent), F.concat(F.lit("Equipment type: "), told("equipment_type")), F.when(true("is_procedural"), "Query is procedural"),
        F.when(~decision.eqNullSafe(intent), F.concat(F.lit("Routing decision overridden to: "), decision)),
    )
    rows = logs.filter(F.col("node_name").isin("IntentRouter", "UnsafeMethodGate", "DeterministicRuleChecker")).withColumn("m", vt.parsed("metadata")).select(
        "trace_id", "node_name", F.struct("started_ms", "id").alias("at"), F.nullif(parts, F.lit("")).alias("rationale"), vt.text(m, "$.reason").alias("reason"), vt.text(m, "$.redirect_to").alias("redirect"),
        true("rule_matched").alias("matched"), vt.text(m, "$.rule_id").alias("rule_id"), F.array_join(vt.elements(m, "$.trigger_keywords", "string"), ",").alias("keywords"),
        F.substring(F.coalesce(vt.text(m, "$.override_response"), F.lit("")), 1, preview).alias("preview"),
    )
    first = lambda node, *fields: F.min_by(F.struct(*fields), F.when(F.col("node_name") == node, F.col("at")))
    found = logs.select("trace_id").distinct().join(
        rows.groupBy("trace_id").agg(
            first("IntentRouter", "rationale").alias("i"), first("UnsafeMethodGate", "reason", "redirect").alias("g"), first("DeterministicRuleChecker", "matched", "rule_id", "keywords", "preview").alias("r")
        ), "trace_id", "left",
    )
    hit = F.coalesce("r.matched", F.lit(False))
    return found.select(
        "trace_id", F.col("i.rationale").alias("rationale"), F.col("g").isNotNull().alias("gate_flagged"), F.col("g.reason").alias("gate_reason"), F.col("g.redirect").alias("gate_redirect"),
        F.when(hit, F.col("r.rule_id")).alias("rule_id"), F.when(hit, F.col("r.keywords")).alias("rule_keywords"), F.when(hit, F.col("r.preview")).alias("rule_preview"),
    )
