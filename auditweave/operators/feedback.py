"""L3: what evaluators said, how far they agree with each other and the judge, and what follows for chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import kappa, share

#: Correction types that count as structured, and the weights of actions and groundings.
STRUCTURED = ("WRONG_VALUE", "WRONG_SEQUENCE", "MISSING_STEP", "WRONG_TOOL", "SAFETY_VIOLATION", "OUTDATED_PROCEDURE")
POLARITY = {"ACCEPT": 1.0, "INCORRECT": -1.0, "MODIFY": -0.5, "SKIP": 0.0}
GROUNDING = {"verbatim": 1.0, "paraphrased": 0.8, "synthesized": 0.5, "ungrounded": 0.1}
CORRECTIONS = ("MODIFY", "INCORRECT")


def _looked_up(column: Column, table: dict[str, float], other: float | None) -> Column:
    out = F.lit(other).cast("double")
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce("retracted", F.lit(False)))


def schema_coverage(step_fb: DataFrame) -> DataFrame:
    rows = live(step_fb).filter(F.col("action").isin(*CORRECTIONS))
    known = F.count_if(F.coalesce(F.col("correction_type").isin(*STRUCTURED), F.lit(False)))
    return rows.agg(F.count("*").alias("total"), known.alias("structured"), (F.count("*") - known).alias("unstructured"), F.round(F.coalesce(share(known, F.count("*")), F.lit(0.0)), 4).alias("coverage"))


def correction_distribution(step_fb: DataFrame) -> DataFrame:
    return live(step_fb).filter(F.col("action").isin(*CORRECTIONS)).groupBy(F.coalesce("correction_type", F.lit("NULL")).alias("correction_type")).agg(F.count("*").alias("n"))


def correction_entropy(step_fb: DataFrame) -> DataFrame:
    """Bits of the correction types, against the most that so many types could have."""
    counts = step_fb.groupBy(F.coalesce("correction_type", F.lit("NULL")).alias("kind")).agg(F.count("*").alias("n"))
    out = counts.agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    bits = F.log2("total") - F.col("s") / F.col("total")
    most = F.when(F.col("kinds") <= 1, 1.0).otherwise(F.log2("kinds"))
    return out.select("kinds", "total", F.round(bits, 6).alias("entropy"), F.round(most, 6).alias("most"), F.round(bits / most, 6).alias("normalised"))


def totals(step_fb: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a).alias(a.lower())
    return step_fb.agg(F.count("*").alias("total"), F.count_distinct("response_id").alias("responses"), *(n(a) for a in POLARITY), F.count_if(F.col("action").isin(*CORRECTIONS)).alias("corrections"))


def concordance(resp_fb: DataFrame, evals: DataFrame) -> DataFrame:
    """Thumbs against the judge's badge (green is up, yellow and red down, gray is left out)."""
    rows = resp_fb.join(evals.filter("attempt_number = 1 and badge in ('green', 'yellow', 'red')").select("response_id", "badge"), "response_id")
    up, good = F.col("feedback_type") == "UP", F.col("badge") == "green"
    agree = F.count_if(up == good)
    return rows.agg(
        F.count("*").alias("n"), F.count_if(up & good).alias("both_up"), F.count_if(~up & ~good).alias("both_down"), F.count_if(~up & good).alias("too_lenient"),
        F.count_if(up & ~good).alias("too_strict"), share(agree, F.count("*")).alias("agreement"),
    )


def correctness_vs_faithfulness(resp_fb: DataFrame, evals: DataFrame, threshold: float = 0.7) -> DataFrame:
    rows = resp_fb.join(evals.filter("attempt_number = 1 and sync_faithfulness is not null").select("response_id", "sync_faithfulness"), "response_id")
    right, faithful = F.col("correctness").isin("correct", "partial"), F.col("sync_faithfulness") >= threshold
    return rows.agg(F.count("*").alias("n"), F.count_if(right == faithful).alias("agree"), F.count_if(~right & faithful).alias("faithful_but_wrong"), share(F.count_if(right == faithful), F.count("*")).alias("agreement"))


def label_kappa(pairs: DataFrame, a: str = "a", b: str = "b", least: int = 0) -> DataFrame:
    """Cohen's kappa of any two label columns, with the band that it falls in; null under `least` pairs, else 0 of none."""
    clean = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = clean.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(a) == F.col(b)).cast("double").alias("agree"))
    of = lambda c, name: clean.groupBy(F.col(c).alias("label")).agg(F.count("*").cast("double").alias(name))
    products = of(a, "na").join(of(b, "nb"), "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0.0)).alias("product"))
    k = F.when(F.col("n") < least, F.lit(None)).otherwise(F.round(kappa(F.col("agree"), F.col("n"), F.col("product")), 6))
    out = n.crossJoin(F.broadcast(products)).select(F.col("n").cast("long").alias("pairs"), F.col("agree").cast("long").alias("agreed"), k.alias("kappa"))  # one row each
    band = F.when(F.col("kappa") < 0, "poor").when(F.col("kappa") <= 0.2, "slight").when(F.col("kappa") <= 0.4, "fair").when(F.col("kappa") <= 0.6, "moderate").when(F.col("kappa") <= 0.8, "substantial").when(F.col("kappa").isNotNull(), "almost perfect")
    return out.withColumn("band", band)


def annotator_pairs(step_fb: DataFrame) -> DataFrame:
    """Actions of the first two evaluators, by id, of each step that two or more judged."""
    per = step_fb.groupBy("response_id", "step_index").agg(F.array_sort(F.collect_list(F.struct("user_id", "action"))).alias("v")).filter(F.size("v") >= 2)
    return per.select("response_id", "step_index", F.col("v")[0]["action"].alias("a"), F.col("v")[1]["action"].alias("b"))


def fold_toggles(events: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """State of each key after its events in order: the same value again takes it back, another one replaces it, null deletes."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(value).alias("value"))))
    step = lambda s, e: F.when(e["value"].isNull() | s.eqNullSafe(e["value"]), F.lit(None).cast("string")).otherwise(e["value"])
    return events.groupBy(*keys).agg(ordered.alias("e")).select(*keys, F.aggregate("e", F.lit(None).cast("string"), step).alias("state"))


def fold_upserts(events: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """As above, but the same value again keeps it."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(value).alias("value"))))
    return events.groupBy(*keys).agg(ordered.alias("e")).select(*keys, F.aggregate("e", F.lit(None).cast("string"), lambda s, e: e["value"]).alias("state"))


def chunk_cache(links: DataFrame, resp_fb: DataFrame, step_fb: DataFrame) -> DataFrame:
    """Thumbs over the distinct responses that use a chunk, and step signals weighted by action, grounding and evaluator."""
    used = links.select("chunk_id", "response_id").distinct()
    up, w = F.col("feedback_type") == "UP", F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    thumbs = used.join(live(resp_fb), "response_id").groupBy("chunk_id").agg(
        F.count("*").alias("n_thumbs"), F.count_if(up).alias("n_up"), F.count_if(~up).alias("n_down"), F.sum(F.when(up, w).otherwise(0.0)).alias("up"), F.sum(F.when(up, 0.0).otherwise(w)).alias("down")
    )
    marks = live(step_fb).select("response_id", "step_index", _looked_up(F.col("action"), POLARITY, 0.0).alias("polarity"), w.alias("w"))
    signals = links.select("chunk_id", "response_id", "step_index", _looked_up(F.col("grounding_label"), GROUNDING, 0.5).alias("g")).join(marks, ["response_id", "step_index"])
    s = F.col("polarity") * F.col("g") * F.col("w")
    steps = signals.groupBy("chunk_id").agg(F.count("*").alias("n_steps"), F.count_if(s > 0).alias("n_plus"), F.count_if(s < 0).alias("n_minus"), F.sum(F.greatest(s, F.lit(0.0))).alias("plus"), F.sum(F.greatest(-s, F.lit(0.0))).alias("minus"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    pos, neg = zero("up") + zero("plus"), zero("down") + zero("minus")
    return thumbs.join(steps, "chunk_id", "full").select(
        "chunk_id", zero("n_thumbs").alias("n_thumbs"), zero("n_steps").alias("n_steps"), F.round(pos, 6).alias("positive"), F.round(neg, 6).alias("negative"), F.round(pos - neg, 6).alias("net"),
        (zero("n_up") + zero("n_plus")).alias("positive_count"), (zero("n_down") + zero("n_minus")).alias("negative_count"),
    )


def boosted(scored: DataFrame, cache: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Scores with the feedback of their chunks added: alpha times net / (positive + negative), between -1 and 1."""
    share_of = F.coalesce(F.try_divide(F.col("net"), F.col("positive") + F.abs("negative")), F.lit(0.0))
    boost = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), share_of))
    return scored.join(cache.select("chunk_id", "positive", "negative", "net"), "chunk_id", "left").select(*scored.columns, F.round(F.col("score") + alpha * boost, 6).alias("adjusted"))


def blacklist_candidates(cache: DataFrame, chunks: DataFrame, least: int = 5, ratio: float = 3) -> DataFrame:
    """Chunks not yet blacklisted with `least` negative marks or more and none positive, or over `ratio` times as many."""
    bad = cache.filter((F.col("negative_count") >= least) & ((F.col("positive_count") == 0) | (F.try_divide("negative_count", "positive_count") > ratio)))
    return bad.join(chunks.filter("not is_blacklisted").select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").select("chunk_id", "document_id", "negative_count", "positive_count", "net")


def blacklisted(chunks: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks with the candidates flipped, and one audit row for each flip."""
    hit = candidates.select(F.col("chunk_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    rows = chunks.join(hit, "id", "left")
    audit = rows.filter("_hit and not is_blacklisted").select(F.col("id").alias("chunk_id"), "document_id", F.lit("BLACKLIST").alias("action"))
    return rows.withColumn("is_blacklisted", F.col("is_blacklisted") | F.coalesce("_hit", F.lit(False))).drop("_hit"), audit


def unblacklisted(chunks: DataFrame, document_ids: DataFrame) -> DataFrame:
    hit = document_ids.select("document_id", F.lit(True).alias("_hit")).distinct()
    return chunks.join(hit, "document_id", "left").withColumn("is_blacklisted", F.col("is_blacklisted") & F.col("_hit").isNull()).drop("_hit")


def affected_summaries(chunks: DataFrame) -> DataFrame:
    """Summary chunks of documents with a blacklisted leaf."""
    hit = chunks.filter("is_blacklisted and level = 0").select("document_id").distinct()
    return chunks.filter("level > 0").join(hit, "document_id", "left_semi").select("document_id", "id", "level")


def quiet_hours(threads: DataFrame, evals: DataFrame, resp_fb: DataFrame, least: int = 10, share_above: float = 0.9) -> DataFrame:
    done = threads.filter("state = 'COMPLETED'").groupBy("device").agg(F.count("*").alias("completed"))
    of = evals.select("response_id", "thread_id").distinct().join(threads.filter("state = 'COMPLETED'").select(F.col("id").alias("thread_id"), "device"), "thread_id")
    fb = live(resp_fb).join(of, "response_id").groupBy("device").agg(F.count("*").alias("feedback"), share(F.sum(F.when(F.col("feedback_type") == "UP", F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("positive"))
    ok = (F.col("completed") >= least) & (F.col("feedback") >= least) & (F.col("positive") > share_above)
    return done.join(fb, "device", "full").select("device", "completed", "feedback", "positive", F.coalesce(ok, F.lit(False)).alias("is_eligible"))


def retracted(resp_fb: DataFrame, gone: DataFrame) -> DataFrame:
    hit = gone.select("response_id", "user_id", F.lit(True).alias("_hit")).distinct()
    return resp_fb.join(hit, ["response_id", "user_id"], "left").withColumn("retracted", F.col("retracted") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def first_write(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def thread_feedback(evals: DataFrame, resp_fb: DataFrame, step_fb: DataFrame) -> DataFrame:
    """Live feedback of both kinds with its thread."""
    of = evals.select("response_id", "thread_id").distinct()
    both = live(resp_fb).select("response_id", F.lit("response").alias("kind"), F.col("feedback_type").alias("value")).unionByName(live(step_fb).select("response_id", F.lit("step").alias("kind"), F.col("action").alias("value")))
    return both.join(of, "response_id").groupBy("thread_id", "kind", "value").agg(F.count("*").alias("n"))
