"""The trace report: one nested row for each response.

What a response has in each table is gathered by one exchange of that table by response (logs and thread figures by thread, where they belong); the parts
then lie together and are joined without moving again. Figures of documents are joined to chunks before links meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .execution import base_name


def thread_traces(logs: DataFrame, conformance: DataFrame) -> DataFrame:
    """Per thread its latest trace: nodes by first appearance (edges and dispatchers left out), summed latency, conformance (trace_id, is_conforming, first_deviation, variant)."""
    name = base_name()
    counts = (F.col("operation_type") != "edge_decision") & ~name.endswith("_dispatch")
    per_node = logs.groupBy("thread_id", "trace_id", F.when(counts, name).alias("node")).agg(
        F.min(F.struct("started_ms", "id")).alias("at"), F.sum("latency_ms").alias("ms"), F.max(F.struct("started_ms", "id")).alias("last")
    )
    first = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("at", "node"))))
    per = per_node.groupBy("thread_id", "trace_id").agg(F.transform(first, lambda x: x["node"]).alias("nodes"), F.sum(F.when(F.col("node").isNotNull(), F.col("ms"))).alias("total_ms"), F.max("last").alias("last"))
    newest = per.groupBy("thread_id").agg(F.max_by(F.struct("trace_id", "nodes", "total_ms"), "last").alias("t")).select("thread_id", "t.*")
    return newest.join(conformance, "trace_id", "left")


def link_parts(links: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Per response its attribution (chunks in order of step and id, with document and label), links that resolve, and the mean figure of its documents (document_id, score)."""
    at = chunks.select(F.col("id").alias("chunk_id"), "document_id").join(documents.select("document_id", "score"), "document_id", "left")
    rows = links.join(at, "chunk_id", "left")
    one = F.struct(F.coalesce("step_index", F.lit(1 << 30)).alias("step"), "id", "chunk_id", "document_id", "grounding_label", "similarity_score")
    found = rows.groupBy("response_id").agg(F.array_sort(F.collect_list(one)).alias("attribution"), F.count("document_id").alias("resolved"), F.collect_set(F.when(F.col("document_id").isNotNull(), F.struct("document_id", "score"))).alias("documents"))
    scores = F.filter(F.transform("documents", lambda d: d["score"]), lambda s: s.isNotNull())
    total = F.aggregate(F.array_sort(scores), F.lit(0.0), lambda a, s: a + s)
    return found.withColumn("rebuildable", F.round(F.try_divide(total, F.size(scores)), 6))


def trace_report(evals: DataFrame, links: DataFrame, chunks: DataFrame, documents: DataFrame, step_fb: DataFrame, resp_fb: DataFrame, logs: DataFrame, conformance: DataFrame) -> DataFrame:
    """response_id, and as structs: scores (latest evaluation), evidence, feedback, trace."""
    kept = [c for c in evals.columns if c not in ("response_id", "thread_id")]
    last = evals.groupBy("response_id").agg(F.max_by(F.struct("thread_id", *kept), "id").alias("scores"), F.count("*").alias("attempts"))
    said = step_fb.groupBy("response_id").agg(*(F.count_if(F.col("action") == a).alias(a.lower()) for a in ("ACCEPT", "MODIFY", "INCORRECT", "SKIP")), F.count("*").alias("steps_judged"))
    thumbs = resp_fb.filter(~F.coalesce("retracted", F.lit(False))).groupBy("response_id").agg(F.count_if(F.col("feedback_type") == "UP").alias("up"), F.count_if(F.col("feedback_type") == "DOWN").alias("down"))
    whole = last.join(link_parts(links, chunks, documents), "response_id", "left").join(said, "response_id", "left").join(thumbs, "response_id", "left")
    traces = thread_traces(logs, conformance)
    own = whole.withColumn("thread_id", F.col("scores.thread_id")).join(traces, "thread_id", "left")
    return own.select(
        "response_id", "attempts", "scores", F.struct("attribution", "resolved", "documents", "rebuildable").alias("evidence"), F.struct("accept", "modify", "incorrect", "skip", "steps_judged", "up", "down").alias("feedback"),
        F.struct("trace_id", "nodes", "total_ms", "is_conforming", "first_deviation", "variant").alias("trace"),
    )


def flattened(report: DataFrame) -> DataFrame:
    """The report's figures in columns, its lists as text."""
    parts = F.transform("evidence.attribution", lambda x: F.concat(x["chunk_id"], F.lit(":"), x["grounding_label"]))
    return report.select(
        "response_id", "attempts", F.col("scores.badge").alias("badge"), F.col("scores.sync_faithfulness").alias("faithfulness"), F.array_size("evidence.attribution").alias("links"), "evidence.resolved",
        F.array_join(parts, " ").alias("attribution"), F.array_size("evidence.documents").alias("documents"), "evidence.rebuildable", "feedback.accept", "feedback.incorrect", "feedback.up", "feedback.down",
        "trace.trace_id", F.array_join("trace.nodes", ">").alias("nodes"), "trace.total_ms", "trace.is_conforming", "trace.first_deviation", "trace.variant",
    )
