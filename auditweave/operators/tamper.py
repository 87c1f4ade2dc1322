"""Tamper experiments: choosing sessions, injecting faults into copies, reverting, and scoring what was detected."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import numbered, seeded, share

#: Kinds of fault.
KINDS = ("chunk_deletion", "score_perturbation", "log_gap", "manifest_tamper")


def eligible_sessions(run_log: DataFrame, nodes: DataFrame, least_chunks: int = 3, least_nodes: int = 5) -> DataFrame:
    rows = run_log.filter(F.col("response_id").isNotNull() & (F.col("status") == "PASS") & (F.col("chunks_retrieved") >= least_chunks))
    return rows.join(nodes.filter(F.col("n_nodes") >= least_nodes), "thread_id").select("query_id", "response_id", "thread_id", "variant", "safety_found", "actual_intent")


def stratified(sessions: DataFrame, strata: list[tuple[Column, int]], total: int, seed: int) -> DataFrame:
    """The first of each stratum in a seeded order up to its minimum, then the first of the rest up to `total`."""
    rows = sessions.withColumn("_order", seeded("query_id", seed))
    rank = F.lit(None).cast("int")
    for i, (condition, least) in enumerate(strata):
        name = f"_s{i}"
        rows = rows.withColumn(name, F.when(F.coalesce(condition, F.lit(False)), F.row_number().over(Window.partitionBy(F.coalesce(condition, F.lit(False))).orderBy("_order", "query_id"))))
        rank = F.coalesce(rank, F.when(F.col(name) <= least, i))
    chosen = rows.withColumn("_must", F.coalesce(rank, F.lit(len(strata))))
    first = chosen.orderBy(F.col("_must") == len(strata), "_order", "query_id").limit(total)
    return first.select(*sessions.columns)


def assigned(sessions: DataFrame, seed: int) -> DataFrame:
    """Every second session in a seeded order is injected, with the kinds in turn. The first of them that expects safety
    content comes before the others, so that it loses a chunk; without such a session the order stands."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    rows = numbered(sessions, "query_id", seed, "_n").withColumn("_i", F.when(F.col("_n") % 2 == 0, F.floor(F.col("_n") / 2)))
    first = rows.filter("safety_found").agg(F.min("_i").alias("_first"))  # one row
    at = F.when(F.col("_i") == F.col("_first"), 0).when(F.col("_i") < F.col("_first"), F.col("_i") + 1).otherwise(F.col("_i"))
    kind = F.when(F.col("_i").isNotNull(), kinds[(at % len(KINDS)).cast("int")])
    return rows.crossJoin(F.broadcast(first)).select("query_id", "response_id", "thread_id", F.col("_i").isNotNull().alias("is_injected"), kind.alias("kind"))


def link_targets(assignments: DataFrame, links: DataFrame) -> DataFrame:
    """The first link, by step, of each session that is to lose one."""
    rows = links.join(assignments.filter(F.col("kind") == "chunk_deletion").select("response_id"), "response_id")
    order = Window.partitionBy("response_id").orderBy(F.asc_nulls_last("step_index"), "id")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("response_id", "id")


def log_targets(assignments: DataFrame, logs: DataFrame) -> DataFrame:
    """The middle log row of each session of three rows and more."""
    rows = logs.join(assignments.filter(F.col("kind") == "log_gap").select("thread_id").distinct(), "thread_id")
    order = Window.partitionBy("thread_id").orderBy("started_ms", "id")
    placed = rows.withColumn("_n", F.row_number().over(order) - 1).withColumn("_k", F.count("*").over(Window.partitionBy("thread_id")))
    return placed.filter("_k >= 3 and _n = floor(_k / 2)").select("thread_id", "id")


def without(table: DataFrame, targets: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """A copy without the target rows, and the rows themselves as backup."""
    ids = targets.select(key).distinct()
    return table.join(ids, key, "left_anti"), table.join(ids, key, "left_semi")


def perturbed(evals: DataFrame, assignments: DataFrame) -> DataFrame:
    """A copy where the faithfulness of the sessions' first evaluation is turned round."""
    hit = assignments.filter(F.col("kind") == "score_perturbation").select("response_id", F.lit(True).alias("_hit")).distinct()
    turned = F.when(F.col("_hit") & (F.col("attempt_number") == 1), F.round(1 - F.col("sync_faithfulness"), 6)).otherwise(F.col("sync_faithfulness"))
    return evals.join(hit, "response_id", "left").withColumn("sync_faithfulness", turned).drop("_hit")


def revert(table: DataFrame, backup: DataFrame, key: str = "id") -> DataFrame:
    return table.join(backup.select(key), key, "left_anti").unionByName(backup)


def verify_revert(table: DataFrame, backup: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Whether each backed-up row is back and as it was."""
    now = table.select(F.col(key).alias("_k"), F.struct(*columns).alias("now"))
    rows = backup.select(key, F.struct(*columns).alias("then")).join(now, F.col(key) == F.col("_k"), "left")
    return rows.select(key, F.when(F.col("_k").isNull(), "missing").when(F.col("now") == F.col("then"), "restored").otherwise("differs").alias("state"))


def overview(logs: DataFrame) -> DataFrame:
    """Rows, distinct nodes and time of each thread."""
    from .execution import base_name

    return logs.groupBy("thread_id").agg(F.count("*").alias("rows"), F.count_distinct(base_name()).alias("nodes"), (F.max("completed_ms") - F.min("started_ms")).alias("span_ms"))


def anomalies(logs: DataFrame) -> DataFrame:
    """One row for each oddity of a record; edges are no records of their own."""
    latency = F.coalesce("latency_ms", F.lit(0))
    odd = F.array_compact(F.array(
        F.when(F.col("completed_ms").isNull(), "not_completed"), F.when(F.col("latency_ms").isNull() | (latency == 0), "no_latency"),
        F.when(latency > 120_000, "slow"), F.when(F.col("metadata").isNull(), "no_metadata"),
    ))
    return logs.filter("operation_type <> 'edge_decision'").select("id", F.explode(odd).alias("anomaly"))


def content_check(links: DataFrame, chunks: DataFrame, per_response: int = 2, seed: int = 5) -> DataFrame:
    """Of a seeded pair of links of each response those whose chunk is missing."""
    order = Window.partitionBy("response_id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")
    some = links.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_response)
    known = chunks.select(F.col("id").alias("chunk_id"), F.lit(True).alias("known"))
    return some.join(known, "chunk_id", "left").groupBy("response_id").agg(F.count("*").alias("sampled"), F.count_if(F.col("known").isNull()).alias("missing"))


def classified(truth: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """TP, TN, FP or FN of each session with a diagnosis."""
    a, b = F.col("is_injected"), F.col("is_detected")
    outcome = F.when(a & b, "TP").when(~a & ~b, "TN").when(b, "FP").otherwise("FN")
    return truth.join(diagnoses, "query_id").withColumn("outcome", outcome)


def scores(outcomes: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("outcome") == k)
    counted = outcomes.agg(n("TP").alias("tp"), n("TN").alias("tn"), n("FP").alias("fp"), n("FN").alias("fn"), F.count_if((F.col("outcome") == "TP") & (F.col("guess") == F.col("kind"))).alias("type_right"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counted.select(
        "tp", "tn", "fp", "fn", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(F.col("type_right"), tp).alias("type_accuracy"),
    )


def recall_by_kind(outcomes: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("outcome") == "TP")
    return outcomes.filter("is_injected").groupBy("kind").agg(F.count("*").alias("injected"), hit.alias("detected"), share(hit, F.count("*")).alias("recall"))


def confusion(outcomes: DataFrame) -> DataFrame:
    """Injected kind by guessed kind; other guesses are unknown."""
    guess = F.when(F.col("guess").isin(*KINDS), F.col("guess")).otherwise("unknown")
    wide = outcomes.filter("is_injected").select("kind", guess.alias("g")).groupBy("kind").pivot("g", [*KINDS, "unknown"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def follow_ups(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome").isin("FN", "FP")).select("query_id", F.when(F.col("outcome") == "FN", "P0").otherwise("P1").alias("priority"))


def binomial_interval(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Clopper-Pearson bounds of hits out of n, by bisection on the binomial tail."""

    def tail(k: int, n: int, p: float) -> float:
        """P(X >= k)."""
        if p <= 0:
            return float(k <= 0)
        if p >= 1:
            return 1.0
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))

    def bound(want: float, f) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < want else (low, mid)
        return (low + high) / 2

    @F.pandas_udf("lower double, upper double")
    def interval(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for k, m in zip(hits, n, strict=True):
            k, m = int(k), int(m)
            lower = 0.0 if k == 0 else bound(alpha / 2, lambda p, k=k, m=m: tail(k, m, p))
            upper = 1.0 if k == m else bound(1 - alpha / 2, lambda p, k=k, m=m: tail(k + 1, m, p))
            out.append((lower, upper))
        return pd.DataFrame(out, columns=["lower", "upper"])

    return counts.withColumn("i", interval("hits", "n")).select(*counts.columns, "i.lower", "i.upper")


def blast_radius(broken: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Responses that reference each document whose chain is broken."""
    hit = chunks.join(broken, "document_id", "left_semi").select(F.col("id").alias("chunk_id"), "document_id")
    return links.join(hit, "chunk_id").groupBy("document_id").agg(F.count_distinct("response_id").alias("responses"))


def balanced(queries: DataFrame, cell: list[str], system: str, target: int, cap: int, seed: int) -> DataFrame:
    """Up to `target` of each cell, its systems taken in turn, with `cap` of one system in a cell at most."""
    order = seeded("query_id", seed)
    rows = queries.withColumn("_n", F.row_number().over(Window.partitionBy(*cell, system).orderBy(order, "query_id"))).filter(F.col("_n") <= cap)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*cell).orderBy("_n", order, "query_id"))).filter(F.col("_k") <= target).select(*queries.columns)
