"""Safety-text metrics: do safety protocols survive into the plan?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import share, words


def long_words(text: Column, over: int = 3) -> Column:
    """Distinct lower-case words, parted by blanks, of more than `over` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.char_length(w) > over))


def gate_survival(gates: DataFrame) -> DataFrame:
    """Per thread the protocols that its RISK gates hold (at least one each) and those of approved or edited ones."""
    units = F.greatest(F.coalesce("n_protocols", F.lit(0)), F.lit(1))
    ok = F.col("decision").isin("APPROVED", "EDITED")
    rows = gates.filter("gate_type = 'RISK'").groupBy("thread_id").agg(F.sum(units).cast("long").alias("units"), F.sum(F.when(ok, units).otherwise(0)).cast("long").alias("survived"))
    return rows.withColumn("rate", share(F.col("survived"), F.col("units")))


def gate_impact(evals: DataFrame) -> DataFrame:
    """Badge rank (red 0, yellow 1, green 2, else -1) of second attempts against first ones."""
    rank = F.when(F.col("badge") == "red", 0).when(F.col("badge") == "yellow", 1).when(F.col("badge") == "green", 2).otherwise(-1)
    of = lambda n, name: evals.filter(F.col("attempt_number") == n).select("response_id", rank.alias(name))
    rows = of(1, "before").join(of(2, "after"), "response_id").withColumn("delta", F.col("after") - F.col("before"))
    return rows.agg(
        F.count("*").alias("pairs"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("worse"),
        share(F.count_if(F.col("delta") > 0), F.count("*")).alias("improvement_rate"),
    )


def best_overlap(left: DataFrame, right: DataFrame, key: str = "thread_id") -> DataFrame:
    """For each text of `left` (key, id, text) its words and the most of them that one text of `right` of the same key has.

    An equi-join of words and a count, so that no pair of texts without a common word is made.
    """
    a = left.select(key, "id", F.explode(long_words(F.col("text"))).alias("w"))
    b = right.select(key, F.col("id").alias("other"), F.explode(long_words(F.col("text"))).alias("w"))
    hits = a.join(b, [key, "w"]).groupBy(key, "id", "other").agg(F.count("*").alias("n")).groupBy(key, "id").agg(F.max("n").alias("most"))
    return left.select(key, "id", F.size(long_words(F.col("text"))).alias("words")).join(hits, [key, "id"], "left").withColumn("most", F.coalesce("most", F.lit(0)))


def extraction_recall(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """Gold texts of which half the words are in one extracted text; those without words match, nothing extracted is 0."""
    rows = best_overlap(gold, extracted)
    some = extracted.select("thread_id", F.lit(True).alias("some")).distinct()
    ok = (F.col("words") == 0) | (F.col("most") >= 0.5 * F.col("words"))
    n = F.count_if(ok & F.coalesce("some", F.lit(False)))
    return rows.join(some, "thread_id", "left").groupBy("thread_id").agg(F.count("*").alias("gold"), n.alias("matched"), share(n, F.count("*")).alias("recall"))


def extraction_precision(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """Extracted texts of which two fifths of the words are in one gold text; those without words never match."""
    ok = (F.col("words") > 0) & (F.col("most") >= 0.4 * F.col("words"))
    return best_overlap(extracted, gold).groupBy("thread_id").agg(F.count("*").alias("extracted"), F.count_if(ok).alias("matched"), share(F.count_if(ok), F.count("*")).alias("precision"))


def hallucination_rate(plans: DataFrame, context: DataFrame, keywords: tuple[str, ...], least: int = 20) -> DataFrame:
    """Plan lines with a safety keyword of which under two fifths of the words are in the thread's retrieved text."""
    lines = plans.select("thread_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.char_length(F.trim("line")) > least)
    about = lines.filter(F.lower("line").rlike("|".join(keywords))).withColumn("w", long_words(F.col("line")))
    known = context.select("thread_id", F.explode(long_words(F.col("text"))).alias("word")).groupBy("thread_id").agg(F.collect_set("word").alias("known"))
    shared = F.size(F.array_intersect("w", F.coalesce("known", F.array().cast("array<string>"))))
    bad = F.count_if((F.size("w") > 0) & (shared < 0.4 * F.size("w")))
    return about.join(known, "thread_id", "left").groupBy("thread_id").agg(F.count("*").alias("lines"), bad.alias("hallucinated"), share(bad, F.count("*")).alias("rate"))


def survives(protocol: Column, plan: Column) -> Column:
    """Half the protocol's words of 5 letters or more are in the plan; without such words: the text itself is; empty: true."""
    w, p = words(protocol, 5), words(plan, 5)
    body = F.lower(F.trim(protocol))
    return F.when(F.coalesce(body, F.lit("")) == "", True).when(F.size(w) == 0, F.lower(plan).contains(body)).otherwise(F.size(F.array_intersect(w, p)) >= 0.5 * F.size(w))


def gate_verdict(protocols: DataFrame, plans: DataFrame, least: float = 0.85) -> DataFrame:
    """Per thread: protocols that survive in its plan, pass, fail or skip (no protocol, empty plan), and the first five that are missing, by protocol_id."""
    rows = plans.join(protocols, "thread_id", "left").withColumn("ok", survives(F.col("protocol"), F.col("text")))
    n, kept = F.count("protocol"), F.count_if(F.col("protocol").isNotNull() & F.col("ok"))
    verdict = F.when((F.max(F.trim(F.coalesce("text", F.lit("")))) == "") | (n == 0), "skip").when(share(kept, n) >= least, "pass").otherwise("fail")
    lost = F.array_sort(F.collect_set(F.when(F.col("protocol").isNotNull() & ~F.col("ok"), F.col("protocol_id"))))
    missing = F.array_join(F.slice(lost, 1, 5), ",")
    return rows.groupBy("thread_id").agg(n.alias("protocols"), kept.alias("survived"), share(kept, n).alias("coverage"), verdict.alias("verdict"), missing.alias("missing"))


def inline_presence(protocols: DataFrame, plans: DataFrame, least: float = 0.4) -> DataFrame:
    """Protocols of whose words (over 3 characters, without punctuation, repeats counted) `least` stand anywhere in the plan."""
    w = F.filter(F.transform(F.split(F.lower("protocol"), r"\s+"), lambda x: F.regexp_replace(x, r"[.,;:!?()]", "")), lambda x: F.char_length(x) > 3)
    rows = protocols.join(plans, "thread_id").withColumn("w", w).withColumn("plan", F.lower("text"))
    hits = F.size(F.filter("w", lambda x: F.col("plan").contains(x)))
    return rows.select("thread_id", "protocol_id", ((F.size("w") == 0) | (hits >= least * F.size("w"))).alias("is_present"))


def step_faithfulness(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("eval_id").agg(F.count("*").alias("steps"), share(F.count_if(F.coalesce("inline_faithful", F.lit(True))), F.count("*")).alias("faithfulness"))
