"""Cross-layer provenance: do links, feedback and evaluations resolve down to documents with a manifest?

Joins that only ask whether a row exists are semi-joins against distinct keys, so that a document's several
manifest entries never multiply a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variant as vt
from ..functions.columns import share


def _known(df: DataFrame, key: str, flag: str) -> DataFrame:
    return df.select(F.col(key).alias(f"_{flag}")).distinct().withColumn(flag, F.lit(True))


def resolved_links(links: DataFrame, chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each link with its document and whether its chunk and that document's manifest exist."""
    at = chunks.select(F.col("id").alias("_chunk"), "document_id")
    known = _known(manifest, "document_id", "manifested")
    out = links.join(at, links["chunk_id"] == F.col("_chunk"), "left").join(known, F.col("document_id") == F.col("_manifested"), "left")
    return out.withColumn("has_chunk", F.col("_chunk").isNotNull()).withColumn("has_manifest", F.coalesce("manifested", F.lit(False))).drop("_chunk", "_manifested", "manifested")


def completeness(resolved: DataFrame, *by: str) -> DataFrame:
    """Links, those resolved, and where the others break, in all or for each value of `by`."""
    whole = F.col("has_chunk") & F.col("has_manifest")
    return resolved.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(whole).alias("resolved"), F.count_if(~F.col("has_chunk")).alias("broken_chunk"),
        F.count_if(F.col("has_chunk") & ~F.col("has_manifest")).alias("broken_manifest"), share(F.count_if(whole), F.count("*")).alias("completeness"),
    )


def thread_provenance(evals: DataFrame, step_fb: DataFrame, links: DataFrame) -> DataFrame:
    """Steps with feedback that have a linked response, of each thread; threads without feedback fall back on linked responses."""
    threads = evals.select("thread_id", "response_id").distinct()
    linked = _known(links, "response_id", "linked")
    steps = step_fb.select("response_id", "step_index").distinct()
    of = threads.join(linked, F.col("response_id") == F.col("_linked"), "left").drop("_linked")
    fed = of.join(steps, "response_id").groupBy("thread_id").agg(F.count("*").alias("steps"), F.count_if("linked").alias("traceable"))
    fallback = of.groupBy("thread_id").agg(F.count_if("linked").alias("linked_responses"))
    n = F.coalesce("steps", "linked_responses")
    found = F.coalesce("traceable", "linked_responses")
    return fallback.join(fed, "thread_id", "left").select(
        "thread_id", n.alias("total_steps"), found.alias("traceable_steps"), F.col("steps").isNull().alias("is_fallback"), F.coalesce(share(found, n), F.lit(0.0)).alias("score")
    )


def safety_completeness(evals: DataFrame, links: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Of each thread's links (one for each evaluation row) to safety chunks, the share whose document exists; 1 if there are none."""
    at = chunks.select(F.col("id").alias("chunk_id"), "document_id", "has_safety_content")
    known = _known(docs, "id", "document")
    rows = evals.select("thread_id", "response_id").join(links.select("response_id", "chunk_id"), "response_id")
    rows = rows.join(at, "chunk_id", "left").join(known, F.col("document_id") == F.col("_document"), "left")
    safety = F.coalesce("has_safety_content", F.lit(False))
    counted = rows.groupBy("thread_id").agg(F.count("*").alias("links"), F.count_if(safety).alias("safety_links"), F.count_if(safety & F.col("document")).alias("resolved"))
    return counted.withColumn("score", F.when(F.col("safety_links") == 0, 1.0).otherwise(share(F.col("resolved"), F.col("safety_links"))))


def links_to_chunks(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """L2 to L1 integrity: links whose chunk exists."""
    flags = links.join(_known(chunks, "id", "known"), F.col("chunk_id") == F.col("_known"), "left")
    return flags.agg(F.count("*").alias("total"), F.count_if("known").alias("valid"), share(F.count_if("known"), F.count("*")).alias("score"))


def feedback_to_verdicts(step_fb: DataFrame, evals: DataFrame) -> DataFrame:
    """L3 to L2 integrity: feedback steps within the verdict arrays of every evaluation (texts that are no JSON arrays do not count), and feedback
    without evaluation; score: what is neither, of both, to 4 places (1 of none)."""
    live = step_fb.filter(~F.coalesce("retracted", F.lit(False)))
    sized = evals.select("response_id", F.array_size(vt.elements(vt.parsed("step_verdicts"))).alias("n_verdicts"))
    rows = live.join(sized.filter("n_verdicts is not null"), "response_id")
    valid = (F.col("step_index") >= 0) & (F.col("step_index") < F.col("n_verdicts"))
    checked = rows.agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("out_of_range"))
    alone = live.join(evals.select("response_id").distinct(), "response_id", "left_anti").agg(F.count("*").alias("without_evaluation"))
    score = F.coalesce(share(F.col("valid"), F.col("total") + F.col("without_evaluation")), F.lit(1.0))
    return checked.crossJoin(F.broadcast(alone)).withColumn("score", F.round(score, 4))  # one row each


def feedback_chain(step_fb: DataFrame, evals: DataFrame, resolved: DataFrame) -> DataFrame:
    """How far each feedback row's response can be followed: evaluation, link, document, manifest."""
    chain = resolved.groupBy("response_id").agg(F.bool_or("has_chunk").alias("doc"), F.bool_or(F.col("has_chunk") & F.col("has_manifest")).alias("full"))
    rows = step_fb.select("response_id").join(_known(evals, "response_id", "evaluated"), F.col("response_id") == F.col("_evaluated"), "left").join(chain, "response_id", "left")
    state = (
        F.when(F.col("evaluated").isNull(), "evaluation").when(F.col("doc").isNull(), "link").when(~F.col("doc"), "document").when(~F.col("full"), "manifest").otherwise("full")
    )
    return rows.groupBy(state.alias("broken_at")).agg(F.count("*").alias("n"))


def corrected_documents(step_fb: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that the linked chunks of corrected steps come from."""
    fixed = step_fb.filter(F.col("action").isin("MODIFY", "INCORRECT")).select("response_id").distinct()
    used = links.join(fixed, "response_id", "left_semi").select("chunk_id").distinct()
    return used.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").select("document_id").distinct()


def feedback_sanity(step_fb: DataFrame, evals: DataFrame) -> DataFrame:
    rows = step_fb.join(_known(evals, "response_id", "known"), F.col("response_id") == F.col("_known"), "left")
    return rows.agg(F.count("*").alias("total"), F.count_if("known").alias("with_evaluation"), F.count_distinct("response_id").alias("responses"))


def trace_order(links: DataFrame, chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Place of each linked chunk in its response's report: reading order where the response's retrieval path (paths: response_id,
    retrieval_path) begins with full_, else most similar first."""
    from pyspark.sql.window import Window

    rows = links.join(chunks.select(F.col("id").alias("chunk_id"), "sequence_index"), "chunk_id").join(paths.select("response_id", "retrieval_path"), "response_id", "left")
    full = F.coalesce(F.startswith("retrieval_path", F.lit("full_")), F.lit(False))
    order = Window.partitionBy("response_id").orderBy(
        F.when(full, F.col("sequence_index")).asc_nulls_last(), F.when(~full, F.col("similarity_score")).desc_nulls_last(), F.col("id")
    )
    return rows.select("response_id", "id", F.row_number().over(order).alias("place"))
