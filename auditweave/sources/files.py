"""File inputs and outputs: run logs, annotation sheets, reports, and the preparation of the query corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Quoted fields may hold line breaks and quotes (doubled); a missing value is an empty field, an empty text is "".
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def truthy(column: str) -> Column:
    """null where the text is empty."""
    return F.nullif(F.col(column), F.lit(""))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_report(envelopes: DataFrame, path: str) -> None:
    envelopes.write.mode("overwrite").json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def usable_runs(runs: DataFrame) -> DataFrame:
    """Runs with a response (`timeout` is none); variant: actual, else expected, else unknown."""
    kept = runs.filter(F.col("response_id").isNotNull() & (F.col("response_id").cast("string") != "timeout"))
    return kept.withColumn("variant", F.coalesce(truthy("actual_variant"), truthy("expected_variant"), F.lit("unknown")))


def verdict_rows(sheet: DataFrame, keys: list[str], verdict: str, order: str) -> DataFrame:
    """Rows with a verdict, in capitals; other texts are trimmed and blank ones null; the last row of a key wins."""
    texts = [c for c, t in sheet.dtypes if t == "string" and c not in (*keys, verdict)]
    clean = sheet.filter(F.trim(F.coalesce(verdict, F.lit(""))) != "").withColumn(verdict, F.upper(F.trim(verdict)))
    for c in texts:
        clean = clean.withColumn(c, F.nullif(F.trim(c), F.lit("")))
    return clean.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def response_sheet(plans: DataFrame, most: int = 5000) -> DataFrame:
    return plans.select("thread_id", "turn", F.substring("text", 1, most).alias("text"), F.lit("").alias("verdict"))


def step_sheet(plans: DataFrame, refs: DataFrame, most: int = 2000) -> DataFrame:
    """One row a step (line) with its chunk references; a plan without steps gives one row, step 0."""
    steps = plans.select("thread_id", "turn", F.posexplode_outer(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("step_index", "step_text"))
    steps = steps.select("thread_id", "turn", F.coalesce("step_index", F.lit(0)).alias("step_index"), F.substring("step_text", 1, most).alias("step_text"))
    listed = refs.groupBy("thread_id", "step_index").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ";").alias("chunk_refs"))
    return steps.join(listed, ["thread_id", "step_index"], "left").withColumn("chunk_refs", F.coalesce("chunk_refs", F.lit("")))


def pseudonyms(rows: DataFrame, field: str, position: str, prefix: str) -> DataFrame:
    """prefix-0001 and so on for each value of `field`, by first appearance; nulls have none.

    The number of a value is the count of first appearances up to its own: per range of positions, plus what came
    in the ranges before, so that no task sees all values.
    """
    first = rows.filter(F.col(field).isNotNull()).groupBy(field).agg(F.min(position).alias("first"))
    ranged = first.withColumn("_range", F.floor(F.col("first") / 100_000))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_k"))
    before = sizes.select("_range", (F.sum("_k").over(Window.orderBy("_range")) - F.col("_k")).alias("_before"))  # one row a range
    n = F.row_number().over(Window.partitionBy("_range").orderBy("first", field)) + F.col("_before")
    text = F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))
    return ranged.join(before, "_range").select(field, F.concat(F.lit(prefix + "-"), text).alias("pseudonym"))


def session_kinds(runs: DataFrame, logs: DataFrame, planner: str = "RepairPlanner") -> DataFrame:
    """Runs (thread_id, response_id, gate_rejected, trace_variant) by whether they can be evaluated: planner and response, else rejected by a gate or
    without a response, else left by a deterministic rule, else other."""
    from ..operators.execution import base_name

    planned = logs.filter(base_name() == planner).select("thread_id", F.lit(True).alias("planned")).distinct()
    answered = F.col("response_id").isNotNull()
    kind = (
        F.when(F.coalesce("planned", F.lit(False)) & answered, "evaluable").when(F.coalesce("gate_rejected", F.lit(False)) | ~answered, "gate_rejected")
        .when(F.endswith(F.coalesce("trace_variant", F.lit("")), F.lit("deterministic_exit")), "deterministic_exit").otherwise("other")
    )
    return runs.join(planned, "thread_id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("sessions"))


def evidence(evals: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per response its latest badge, linked chunks and safety chunks among them."""
    last = evals.groupBy("response_id").agg(F.max_by("badge", "id").alias("badge"), F.count("*").alias("attempts"))
    used = links.join(chunks.select(F.col("id").alias("chunk_id"), "has_safety_content"), "chunk_id")
    per = used.groupBy("response_id").agg(F.count("*").alias("links"), F.count_if("has_safety_content").alias("safety_links"), F.array_join(F.array_sort(F.collect_set("chunk_id")), ";").alias("chunk_ids"))
    return last.join(per, "response_id", "left")


def coverage_report(corpus: DataFrame) -> DataFrame:
    """Counts of origin by type with totals (null: all)."""
    return corpus.cube("origin", "observation_type").agg(F.count("*").alias("n"))


def against_minimum(corpus: DataFrame, minimum: DataFrame) -> DataFrame:
    counts = corpus.groupBy("variant").agg(F.count("*").alias("n"))
    rows = minimum.join(counts, "variant", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("state", F.when(F.col("n") >= F.col("least"), "OK").otherwise("BELOW MIN"))


def earliest(df: DataFrame, by: str, version: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(version))).filter("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write of each key; new rows come after old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n", "_new")


def run_plan(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries that are still to run; a follow-up takes its parent's thread, or fails where that has none."""
    rest = queries.join(done.select("query_id").distinct(), "query_id", "left_anti")
    parents = done.select(F.col("query_id").alias("parent_query_id"), F.col("thread_id").alias("parent_thread"))
    rows = rest.join(parents, "parent_query_id", "left")
    lost = F.col("parent_query_id").isNotNull() & F.col("parent_thread").isNull()
    return rows.select("query_id", F.col("parent_thread").alias("thread_id"), F.when(lost, "FAIL").otherwise("RUN").alias("status"))


def labelled(corpus: DataFrame, intents: DataFrame, safety_systems: list[str]) -> DataFrame:
    """Intent by observation type, safety flag by system, and an id EQ-nnn by query number."""
    rows = corpus.join(F.broadcast(intents), "observation_type", "left")  # one row a type
    number = F.col("query_no").cast("string")
    return rows.select(F.concat(F.lit("EQ-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("id"), "intent", F.col("system").isin(*safety_systems).alias("safety_expected"))
