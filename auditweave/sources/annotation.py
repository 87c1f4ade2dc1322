"""The annotation round trip: queries labelled for a run, the evidence that annotators see, and their sheets taken back as feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The notes of a query, by what is expected of it.
SHORT = "Variant #3 — obscure system (%s), expecting troubleshoot short-circuit"
REPLACE, TROUBLESHOOT = "Full replace_part path — %s", "Full troubleshoot path — %s"
SAFETY = "; should retrieve safety procedures"
#: Rows a system may have before it is over its cap, safety queries wanted, actions that correct, the category of imported rows.
SYSTEM_CAP, SAFETY_LEAST, CORRECTIONS, CATEGORY = 4, 6, ("MODIFY", "INCORRECT"), "GENERAL"
CUT = 500


def _filled(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def in_sequence(rows: DataFrame, position: str, out: str, step: int = 100_000) -> DataFrame:
    """`rows` with their number from 1 by `position`, a whole number that no two share: counted within ranges of positions, so that no task sees all rows."""
    ranged = rows.withColumn("_range", F.floor(F.col(position) / step))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_k"))
    before = sizes.select("_range", (F.sum("_k").over(Window.orderBy("_range")) - F.col("_k")).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(position)) + F.col("_before")
    return ranged.join(before, "_range").withColumn(out, place).select(*rows.columns, out)


def labelled(corpus: DataFrame, devices: dict[str, str], safety_systems: list[str]) -> DataFrame:
    """What a run expects of each query (position, observation, source, observation_type, system, is_obscure), with an id EQ-nnn in their order.

    The device follows from the source (unknown: null), intent and variant from the type; an obscure system ends early.
    """
    replaces = F.col("observation_type") == "part_replacement"
    system = F.coalesce("system", F.lit(""))
    safe = system.isin(*safety_systems)
    obscure = F.coalesce("is_obscure", F.lit(False))
    notes = F.when(obscure, F.format_string(SHORT, system)).when(replaces, F.format_string(REPLACE, system)).otherwise(F.format_string(TROUBLESHOOT, system))
    device = F.lit(None).cast("string")
    for source, name in devices.items():
        device = F.when(F.col("source") == source, name).otherwise(device)
    number = F.col("_no").cast("string")
    return in_sequence(corpus, "position", "_no").select(
        F.concat(F.lit("EQ-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("id"), "position", device.alias("device"),
        F.when(replaces, "replace_part").otherwise("troubleshoot").alias("expected_intent"), F.when(obscure, 3).when(replaces, 5).otherwise(4).alias("expected_variant"),
        safe.alias("safety_expected"), F.concat(notes, F.when(safe, SAFETY).otherwise("")).alias("notes"),
    )


def system_counts(corpus: DataFrame, cap: int = SYSTEM_CAP) -> DataFrame:
    """Queries of each system, and whether they are over the cap."""
    return corpus.groupBy("system").agg(F.count("*").alias("n")).withColumn("is_over_cap", F.col("n") > cap)


def safety_counts(labels: DataFrame, least: int = SAFETY_LEAST) -> DataFrame:
    """Queries that expect safety content and those that do not, against the least number of the former. One row, of an empty table too."""
    n = labels.agg(F.count_if("safety_expected").alias("expected"), F.count_if(~F.coalesce("safety_expected", F.lit(False))).alias("not_expected"))
    return n.withColumn("state", F.when(F.col("expected") >= least, "OK").otherwise("BELOW MIN"))


def log_rows(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """The log rows of each run's trace in order of time, their metadata cut. A run without a trace has none."""
    at = F.row_number().over(Window.partitionBy("response_id").orderBy("started_ms", "id"))
    rows = runs.select("response_id", "trace_id").distinct().join(logs.select("trace_id", "id", "node_name", "operation_type", "latency_ms", "started_ms", "metadata"), "trace_id")
    return rows.select("response_id", at.alias("place"), "node_name", "operation_type", "latency_ms", F.substring("metadata", 1, CUT).alias("meta_summary"))


def linked_chunks(runs: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that each run's response links, one row a link; no text is an empty preview."""
    linked = links.join(runs.select("response_id").distinct(), "response_id", "left_semi").select("response_id", F.col("id").alias("link_id"), "chunk_id", "step_index")
    rows = linked.join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "section_header", "has_safety_content", F.substring(F.coalesce("text", F.lit("")), 1, CUT).alias("preview")), "chunk_id")
    return rows.select("response_id", "link_id", "chunk_id", "preview", "document_id", "section_header", "has_safety_content", "step_index")


def bundle(runs: DataFrame, queries: DataFrame, evals: DataFrame, logs: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a run: its query (text and device; a lost one says so), latest evaluation, and how many log rows, chunks and safety chunks it has.

    The rows themselves are `log_rows` and `linked_chunks`: a run of any length is never gathered into one value.
    """
    scores = ["badge", "sync_faithfulness", "sync_answer_relevance", "sync_context_relevance", "sync_completeness"]
    last = evals.groupBy("response_id").agg(F.max_by(F.struct(*scores), "id").alias("e"))
    used = linked_chunks(runs, links, chunks).groupBy("response_id").agg(F.count("*").alias("chunks_retrieved"), F.count_if("has_safety_content").alias("safety_chunks"))
    seen = logs.groupBy("trace_id").agg(F.count("*").alias("log_rows"))
    asked = queries.select("query_id", F.col("text").alias("query_text"), "device")
    rows = runs.select("query_id", "response_id", "thread_id", "trace_id").join(asked, "query_id", "left").join(last, "response_id", "left").join(used, "response_id", "left").join(seen, "trace_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    lost = F.concat(F.lit("MISSING: "), F.col("query_id").cast("string"))
    return rows.select("query_id", "response_id", "thread_id", "trace_id", F.coalesce("query_text", lost).alias("query_text"), F.coalesce("device", F.lit("unknown")).alias("device"), *(f"e.{s}" for s in scores), zero("log_rows"), zero("chunks_retrieved"), zero("safety_chunks"))


def correction_text(correctness: str, completeness: str, safety: str, text: str) -> Column:
    """The parts that are filled in, `; ` between them; none: null."""
    parts = [F.concat(F.lit(f"{name}="), _filled(column)) for name, column in (("correctness", correctness), ("completeness", completeness), ("safety", safety))]
    return F.nullif(F.concat_ws("; ", *parts, _filled(text)), F.lit(""))


def imported(old: DataFrame, new: DataFrame, context: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The feedback table `old` after `new` (keys and values, as `verdict_rows` gives them) was taken in; `context` names each response's thread_id and device.

    A key that is there takes the new values, nulls too, and keeps all else; a new one gets thread and device of its response, the
    general category and weight 1. Rows of a response without context are left out (`import_counts` tells how many).
    """
    known = new.join(context.select("response_id", "thread_id", "device"), "response_id")
    fresh = known.select(*keys, F.struct(*values, "thread_id", "device").alias("_n"))
    both = old.withColumn("_old", F.lit(True)).join(fresh, keys, "full")
    there, came = F.col("_old").isNotNull(), F.col("_n").isNotNull()
    of = lambda c: F.when(there, F.col(c)).otherwise(F.col(f"_n.{c}")).alias(c)
    default = lambda c, v: F.when(there, F.col(c)).otherwise(F.lit(v)).alias(c)
    return both.select(*keys, of("thread_id"), of("device"), default("category", CATEGORY), *[F.when(came, F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in values], default("weight", 1.0))


def import_counts(new: DataFrame, context: DataFrame, verdict: str) -> DataFrame:
    """Per user how many rows of the sheet were taken in, how many of these correct the answer, and how many were skipped for want of context."""
    rows = new.join(context.select("response_id", F.lit(True).alias("_known")), "response_id", "left")
    known = F.col("_known").isNotNull()
    return rows.groupBy("user_id").agg(F.count_if(known).alias("imported"), F.count_if(known & F.col(verdict).isin(*CORRECTIONS)).alias("corrections"), F.count_if(~known).alias("skipped"))
