"""Badges, review priorities and queues."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .execution import latest

#: Thresholds, hours to answer, and ranks of badges.
GREEN, RED, MAX_UNFAITHFUL = 0.7, 0.4, 0.3
SLA_HOURS = {"P0": 4, "P1": 24, "P2": 72, "P3": 168}
RANK = {"green": 3, "yellow": 2, "red": 1, "gray": 0}


def quality_badge(scores: list[Column], unfaithful_share: Column | None = None) -> Column:
    """gray of any missing score, red of any below RED, yellow of any below GREEN, else green; many unfaithful steps make it red, any turn green to yellow."""
    some = lambda f: reduce(lambda a, b: a | b, [f(s) for s in scores])
    badge = F.when(some(lambda s: s.isNull()), "gray").when(some(lambda s: s < RED), "red").when(some(lambda s: s < GREEN), "yellow").otherwise("green")
    if unfaithful_share is None:
        return badge
    bad = F.coalesce(unfaithful_share, F.lit(0.0))
    return F.when(badge == "gray", "gray").when(bad >= MAX_UNFAITHFUL, "red").when((bad > 0) & (badge == "green"), "yellow").otherwise(badge)


def safety_badge(n_basis: Column, n_rules: Column, confidence: Column, n_without_severity: Column) -> Column:
    """null without a basis, red without rules, then by confidence; a rule without severity bars green."""
    return (
        F.when(F.coalesce(n_basis, F.lit(0)) == 0, F.lit(None).cast("string")).when(n_rules == 0, "red")
        .when((confidence >= 0.5) & (n_without_severity == 0), "green").when(confidence >= 0.2, "yellow").otherwise("red")
    )


def composite_badge(a: Column, b: Column) -> Column:
    """The worse of two badges; an unknown or missing one counts for nothing, and two of these give gray."""
    rank = lambda c: reduce(lambda w, kv: w.when(c == kv[0], kv[1]), RANK.items(), F.when(F.lit(False), 0))
    least = F.least(rank(a), rank(b))
    return reduce(lambda w, kv: w.when(least == kv[1], kv[0]), RANK.items(), F.when(least.isNull(), "gray"))


#: Risk categories that always come first, and the scores that count as failing below 0.6.
CRITICAL = ("LOTO", "HIGH_VOLTAGE", "CONFINED_SPACE", "PRESSURE_SYSTEM", "ARC_FLASH")
METRICS = ("faithfulness", "answer_relevance", "context_relevance", "completeness")


def priority(source: Column, risks: Column, metrics: dict[str, Column], has_correction: Column, badge: Column, quality: Column, safety: Column) -> Column:
    """P0 to P3 of a review task; a missing quality badge is the composite one, and missing facts fit no rule.

    P0: a critical risk, faithfulness below 0.3, or an automatic evaluation that ended red. P1: a red safety badge, two
    failing scores, any other risk, or a manual flag with a correction. P2: one failing score, or a manual flag on red or gray.
    """
    of = lambda c: F.coalesce(c, F.lit(False))
    quality = F.coalesce(F.nullif(quality, F.lit("")), badge)
    failing = reduce(add, [of(metrics[m] < 0.6).cast("int") for m in METRICS if m in metrics], F.lit(0))
    first = of(F.arrays_overlap(risks, F.array(*[F.lit(c) for c in CRITICAL]))) | of(metrics["faithfulness"] < 0.3) | of((source == "AUTO_EVAL") & (quality == "red"))
    manual = of(source == "MANUAL_FLAG")
    second = of(safety == "red") | (failing >= 2) | of(F.size(risks) > 0) | (of(has_correction) & manual)
    return F.when(first, "P0").when(second, "P1").when((failing == 1) | (manual & of(quality.isin("red", "gray"))), "P2").otherwise("P3")


def due_hours(of: Column) -> Column:
    return reduce(lambda w, kv: w.when(of == kv[0], kv[1]), SLA_HOURS.items(), F.when(F.lit(False), 0))


def badged(evals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Quality badge of each evaluation from its two inline scores and its unfaithful steps."""
    steps = verdicts.groupBy(F.col("eval_id").alias("id")).agg((F.count_if(~F.col("inline_faithful")) / F.count("*")).alias("unfaithful"))
    rows = evals.join(steps, "id", "left")
    return rows.select("id", quality_badge([F.col("sync_faithfulness"), F.col("sync_answer_relevance")], F.col("unfaithful")).alias("badge"))


def safety_badges(threads_protocols: DataFrame) -> DataFrame:
    """thread_id and badge from n_basis, n_rules, confidence, n_without_severity."""
    return threads_protocols.select("thread_id", safety_badge(F.col("n_basis"), F.col("n_rules"), F.col("confidence"), F.col("n_without_severity")).alias("badge"))


def reviewed(rows: DataFrame) -> DataFrame:
    """Priority and hours to answer of each row of (id, source, risks, has_correction, badge, quality_badge, safety_badge) and METRICS."""
    p = priority(F.col("source"), F.col("risks"), {m: F.col(m) for m in METRICS}, F.col("has_correction"), F.col("badge"), F.col("quality_badge"), F.col("safety_badge"))
    return rows.select("id", p.alias("priority")).withColumn("sla_hours", due_hours(F.col("priority")))


def shadow_escalation(evals: DataFrame, agreement: DataFrame) -> DataFrame:
    """P2 where the shadow badge, of the scores present, is worse than the inline one; P1 where step agreement is under 0.8."""
    a, b = F.coalesce("async_faithfulness", F.lit(1.0)), F.coalesce("async_answer_relevance", F.lit(1.0))
    none = F.col("async_faithfulness").isNull() & F.col("async_answer_relevance").isNull()
    shadow = F.when(~none, quality_badge([a, b]))
    place = lambda c: F.when(c == "green", 0).when(c == "yellow", 1).when(c == "red", 2)
    worse = evals.filter(place(shadow) > F.coalesce(place(F.col("badge")), F.lit(3))).select(F.col("id").alias("eval_id"), F.lit("SHADOW_WORSE").alias("reason"), F.lit("P2").alias("priority"))
    low = agreement.filter("rate < 0.8").select("eval_id", F.lit("LOW_AGREEMENT").alias("reason"), F.lit("P1").alias("priority"))
    return worse.unionByName(low)


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Rows of one page, with their place and the total. Only the rows up to the page's end are ordered in one task."""
    total = df.agg(F.count("*").alias("total"))
    first = df.orderBy(*order).limit(size * (number + 1))
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(*order))).filter(F.col("place") > size * number)
    return placed.crossJoin(F.broadcast(total))  # one row


def task_queue(tasks: DataFrame, now: int, size: int = 20, number: int = 0) -> DataFrame:
    """Open tasks that are not snoozed, by priority and then age."""
    rank = reduce(lambda w, kv: w.when(F.col("priority") == kv[1], kv[0]), enumerate(SLA_HOURS), F.when(F.lit(False), 0)).otherwise(9)
    live = tasks.filter((F.col("status") != "RESOLVED") & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= now)))
    return page(live.withColumn("_rank", rank), [F.col("_rank"), F.col("created"), F.col("id")], size, number).drop("_rank")


def task_states(events: DataFrame) -> DataFrame:
    """Last state of each task: claims hold only from NEW or SNOOZED, a task is resolved once."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "event")))
    step = lambda s, e: (
        F.when((e["event"] == "CLAIM") & s.isin("NEW", "SNOOZED"), "CLAIMED").when((e["event"] == "SNOOZE") & (s != "RESOLVED"), "SNOOZED")
        .when((e["event"] == "RESOLVE") & (s != "RESOLVED"), "RESOLVED").otherwise(s)
    )
    return events.groupBy("task_id").agg(ordered.alias("e")).select("task_id", F.aggregate("e", F.lit("NEW"), step).alias("state"))


def session_queue(threads: DataFrame, evals: DataFrame, search: str, size: int, number: int) -> DataFrame:
    """Sessions whose title or device holds `search`, escalated first, with the badge of their latest evaluation."""
    text = "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    last = evals.groupBy(F.col("thread_id").alias("id")).agg(F.max_by("badge", "id").alias("badge"))
    rows = threads.filter(F.col("title").ilike(text) | F.col("device").ilike(text)).join(last, "id", "left").select("id", "device", "is_escalated", "badge")
    return page(rows, [F.desc("is_escalated"), F.col("id")], size, number)


def thread_list(threads: DataFrame, evals: DataFrame, state: str, size: int, number: int) -> DataFrame:
    last = evals.groupBy(F.col("thread_id").alias("id")).agg(F.max_by("badge", "id").alias("badge"))
    return page(threads.filter(F.col("state") == state).join(last, "id", "left").select("id", "device", "badge"), [F.desc("id")], size, number)


def listing(df: DataFrame, condition: Column, order: list[Column], columns: list[str], limit: int | None = None) -> DataFrame:
    """Any filtered listing in time order."""
    rows = df.filter(condition).orderBy(*order).select(*columns)
    return rows if limit is None else rows.limit(limit)


def artifact_class(has_steps: Column, has_root_cause: Column, has_answer: Column, has_context: Column) -> Column:
    return F.when(has_steps, "repair_plan").when(has_root_cause, "informational").when(has_answer & has_context, "follow_up").otherwise("non_retrieval")


def plan_text(turns: DataFrame, contexts: DataFrame, least_steps: int = 3) -> DataFrame:
    """The assistant's text of each thread by turn, its class and whether its first 200 characters tell of failure.

    A thread of `least_steps` turns has steps, one of a turn less a root cause; `contexts` (thread_id) names those with retrieved context.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    rows = turns.groupBy("thread_id").agg(text.alias("text"), F.count("*").alias("n_turns"))
    rows = rows.join(contexts.select("thread_id", F.lit(True).alias("has_context")).distinct(), "thread_id", "left")
    kind = artifact_class(F.col("n_turns") >= least_steps, F.col("n_turns") == least_steps - 1, F.lit(True), F.coalesce("has_context", F.lit(False)))
    return rows.select("thread_id", kind.alias("kind"), F.char_length("text").cast("long").alias("n_chars"), F.lower(F.substring("text", 1, 200)).rlike("fail|error|unable").alias("is_failed"))


def flagged_threads(threads: DataFrame, flags: DataFrame) -> DataFrame:
    """The latest flag of each thread, and whether it is escalated by that or its own mark."""
    last = flags.groupBy("thread_id").agg(F.max_by(F.struct("reason", "status"), "id").alias("f"))
    rows = threads.join(last, threads["id"] == last["thread_id"], "left")
    return rows.select("id", "f.reason", "f.status", (F.col("is_escalated") | F.coalesce(F.col("f.status") == "PENDING", F.lit(False))).alias("is_flagged"))


def approve_pending(flags: DataFrame) -> DataFrame:
    return flags.withColumn("was_pending", F.col("status") == "PENDING").withColumn("status", F.when(F.col("status") == "PENDING", "APPROVED").otherwise(F.col("status")))


def recent_unresolved(orders: DataFrame, threads: DataFrame, since: str, until: str, keep: int = 5) -> DataFrame:
    """The newest open sessions of each device within a span."""
    rows = orders.filter(F.col("at").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"))).join(threads.filter("state <> 'ABANDONED'"), orders["thread_id"] == threads["id"])
    order = Window.partitionBy("device").orderBy(F.desc("at"), F.desc("case_id"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("device", "place", "case_id")


def reports_with_user(run_log: DataFrame, threads: DataFrame, users: DataFrame) -> DataFrame:
    rows = run_log.join(threads.select(F.col("id").alias("thread_id"), "device"), "thread_id", "left")
    return rows.join(users.select(F.col("c_custkey").alias("thread_id"), F.col("c_name").alias("email")), "thread_id", "left").select("query_id", "device", "email")


def inline_view(evals: DataFrame) -> DataFrame:
    """The latest evaluation of each response; gray and unknown badges are shown as red."""
    shown = F.when(F.col("badge").isin("green", "yellow", "red"), F.col("badge")).otherwise("red")
    return latest(evals, "response_id").select("response_id", shown.alias("badge"), "sync_faithfulness")


def terminal_state(route: Column, overridden: Column) -> Column:
    return F.when(route.isin("troubleshoot", "direct_replacement", "replace_part") | overridden, "COMPLETED").otherwise("ACTIVE")
