"""Process mining over execution traces: a trace's nodes in order, without repeats in a row."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import share
from .execution import base_name, meta


def traces(logs: DataFrame, model_edges: DataFrame) -> DataFrame:
    """trace_id, node, place of each step of a model node, consecutive repeats left out; ties of time go by id."""
    nodes = model_edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    rows = logs.filter(F.col("operation_type").isin("llm_call", "node")).select("trace_id", base_name().alias("node"), "started_ms", "id").join(F.broadcast(nodes), "node")  # nodes of the process model
    order = Window.partitionBy("trace_id").orderBy("started_ms", "id")
    kept = rows.withColumn("before", F.lag("node").over(order)).filter("before is null or before <> node")
    return kept.select("trace_id", "node", F.row_number().over(order).alias("place"))


def steps(trace: DataFrame, model_edges: DataFrame) -> DataFrame:
    """src, dst and whether the model has it, for each step from START to END."""
    order = Window.partitionBy("trace_id").orderBy("place")
    inner = trace.select("trace_id", "place", F.lag("node", 1, "START").over(order).alias("src"), F.col("node").alias("dst"))
    last = trace.groupBy("trace_id").agg((F.max("place") + 1).alias("place"), F.max_by("node", "place").alias("src")).withColumn("dst", F.lit("END"))
    known = F.broadcast(model_edges.select("src", "dst", F.lit(True).alias("known")))  # the edges of the process model
    return inner.unionByName(last).join(known, ["src", "dst"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


#: Labels by the nodes that a trace must have and the node that it must end with; the first that fits holds.
SIGNATURES = (
    ("followup", ("FollowUpResponder", "InlineEvaluator"), "InlineEvaluator"),
    ("troubleshoot_deterministic_exit", ("DeterministicRuleChecker",), "DeterministicRuleChecker"),
    ("replace_part", ("DirectReplacementAnalyzer", "InlineEvaluator"), "InlineEvaluator"),
    ("troubleshoot_short_circuit", ("SymptomAnalyzer", "RootCauseAnalyzer"), "RootCauseAnalyzer"),
)
#: The labels that answer each expected variant number.
ANSWERS = (
    (1, ("troubleshoot_deterministic_exit",)),
    (2, ("followup",)),
    (3, ("troubleshoot_short_circuit", "troubleshoot_full")),
    (4, ("troubleshoot_full", "troubleshoot_safety_retry", "troubleshoot_eval_retry")),
    (5, ("replace_part",)),
    (6, ("unsafe_method_redirect",)),
    (7, ("unsafe_method_redirect",)),
)


def variants(trace: DataFrame, model_edges: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Per trace: conforming or not, the first edge that is not in the model, and its label.

    Labels go by SIGNATURES; other traces that end in InlineEvaluator are unsafe redirects, repairs planned again after
    the evaluator or after the safety judge, or full ones. Rest: null. Of `sessions` (trace_id), those without a model node
    conform and have no label.
    """
    edges = steps(trace, model_edges)
    bad = F.min(F.when(~F.col("known"), F.struct("place", F.concat("src", F.lit(">"), "dst").alias("edge"))))
    again = lambda gate: F.bool_or((F.col("src") == gate) & (F.col("dst") == "RepairPlanner"))
    per = edges.groupBy("trace_id").agg(
        F.bool_and("known").alias("is_conforming"), bad.alias("bad"), F.collect_set("src").alias("nodes"), F.max_by("src", "place").alias("last"),
        again("InlineEvaluator").alias("eval_retry"), again("SafetyJudgeGate").alias("safety_retry"),
    )
    has = lambda n: F.array_contains("nodes", n)
    label = F.when(F.lit(False), "")
    for name, required, last in SIGNATURES:
        label = label.when(reduce(and_, map(has, required)) & (F.col("last") == last), name)
    evaluated = F.when(has("UnsafeMethodGate"), "unsafe_method_redirect").when(F.col("eval_retry"), "troubleshoot_eval_retry").when(F.col("safety_retry"), "troubleshoot_safety_retry")
    label = label.when(F.col("last") == "InlineEvaluator", evaluated.otherwise("troubleshoot_full"))
    out = per.select("trace_id", "is_conforming", F.col("bad.edge").alias("first_deviation"), label.alias("variant"))
    if sessions is None:
        return out
    return sessions.select("trace_id").distinct().join(out, "trace_id", "left").withColumn("is_conforming", F.coalesce("is_conforming", F.lit(True)))


def deviations(edges: DataFrame) -> DataFrame:
    """The edges of each trace that does not conform, in order."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("known"), F.struct("place", F.concat("src", F.lit(">"), "dst").alias("edge")))))
    return edges.groupBy("trace_id").agg(bad.alias("bad")).filter(F.size("bad") > 0).select("trace_id", F.array_join(F.transform("bad", lambda x: x["edge"]), ",").alias("edges"))


def fitness(edges: DataFrame, least: int = 20) -> DataFrame:
    """Valid steps / steps, and conforming traces / traces, to 4 places; null of fewer than `least` traces."""
    per = edges.groupBy("trace_id").agg(F.count_if("known").alias("valid"), F.count_if(~F.col("known")).alias("deviant"))
    of = lambda a, b: F.when(F.count("*") >= least, F.round(share(a, b), 4))
    return per.agg(
        F.count("*").alias("traces"), F.sum("valid").alias("valid"), F.sum("deviant").alias("deviant"), of(F.sum("valid"), F.sum("valid") + F.sum("deviant")).alias("fitness"),
        of(F.count_if(F.col("deviant") == 0), F.count("*")).alias("conformance_rate"),
    )


def precision(edges: DataFrame, model_edges: DataFrame, least: int = 20) -> DataFrame:
    """Model edges that were observed / model edges, to 4 places, with the others listed; null of fewer than `least` traces."""
    enough = edges.agg(F.count_distinct("trace_id") >= least)
    seen = edges.filter("known").select("src", "dst", F.lit(True).alias("seen")).distinct()
    rows = model_edges.join(seen, ["src", "dst"], "left")
    rest = F.array_join(F.array_sort(F.collect_list(F.when(F.col("seen").isNull(), F.concat("src", F.lit(">"), "dst")))), ",")
    found = rows.agg(F.count("*").alias("model"), F.count_if("seen").alias("observed"), F.round(share(F.count_if("seen"), F.count("*")), 4).alias("precision"), rest.alias("unexercised"))
    return found.crossJoin(enough.toDF("enough")).select("model", "observed", F.when(F.col("enough"), F.col("precision")).alias("precision"), "unexercised")  # one row each


def chi_squared(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Statistic and degrees of freedom of a against b within each `by`; null pairs do not count, one level gives df 0."""
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, a, b).agg(F.count("*").alias("o"))
    levels = lambda c, name: cells.groupBy(by, c).agg(F.sum("o").alias(name))
    rows, columns = levels(a, "row_n"), levels(b, "column_n")
    totals = rows.groupBy(by).agg(F.sum("row_n").alias("n"), F.count("*").alias("n_rows")).join(columns.groupBy(by).agg(F.count("*").alias("n_columns")), by)
    grid = rows.join(columns, by).join(totals, by).join(cells, [by, a, b], "left")  # levels x levels, not rows x rows
    expected = F.col("row_n") * F.col("column_n") / F.col("n")
    deviation = F.pow(F.coalesce("o", F.lit(0)) - expected, 2) / expected
    return grid.groupBy(by).agg(F.max("n").alias("n"), ((F.max("n_rows") - 1) * (F.max("n_columns") - 1)).alias("df"), F.round(F.sum(deviation), 6).alias("statistic"))


def chi_squared_p(tests: DataFrame) -> DataFrame:
    """The upper tail of each test: the regularised incomplete gamma function of df / 2 and statistic / 2, by its series or continued fraction."""
    def tail(df: int, x: float) -> float:
        if df <= 0 or x <= 0:
            return 1.0
        s, x = df / 2, x / 2
        scale = math.exp(-x + s * math.log(x) - math.lgamma(s))
        if x < s + 1:
            term = total = 1 / s
            n = 0
            while term > total * 1e-15:
                n += 1
                term *= x / (s + n)
                total += term
            return max(0.0, 1 - scale * total)
        value = 0.0  # the continued fraction from its tail, which converges fast for x above s and does not cancel
        for n in range(500, 0, -1):
            value = n * (n - s) / (x + 2 * n + 1 - s - value)
        return scale / (x + 1 - s - value)

    @F.pandas_udf("double")
    def p(df: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([tail(a, b) for a, b in zip(df, x, strict=True)], dtype="float64")

    return tests.withColumn("p_value", p("df", "statistic")).withColumn("is_significant", F.col("p_value") < 0.05)


def decisions(logs: DataFrame) -> DataFrame:
    """Decisions of the conditional edges: the edge, where it went, and the facts it may depend on."""
    rows = logs.filter((F.col("operation_type") == "edge_decision") & F.col("node_name").startswith("edge:") & F.col("metadata").isNotNull())
    return rows.select(F.col("node_name").alias("node"), meta("decision").alias("target"), meta("intent").alias("intent"), (meta("intent") == "procedural").alias("is_procedural"))


def testable(tests: DataFrame) -> DataFrame:
    """Tests of edges with two targets and two values of the fact at least."""
    return tests.filter("df > 0")


def variant_agreement(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Traces of each expected variant number (trace_id, expected), and those whose label is one of the number's ANSWERS."""
    both = observed.select("trace_id", "variant").join(expected.select("trace_id", "expected"), "trace_id")
    fits = reduce(lambda w, kv: w.when(F.col("expected") == kv[0], F.col("variant").isin(*kv[1])), ANSWERS, F.when(F.lit(False), False))
    return both.groupBy("expected").agg(F.count("*").alias("n"), F.count_if(F.coalesce(fits, F.lit(False))).alias("agree"), F.count_distinct("variant").alias("observed_variants"))
