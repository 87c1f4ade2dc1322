"""As-of joins: for each (key, time) the newest entry that stood then.

Questions and entries of a key go through one running maximum in order of time. So that a key with a third of all
rows is no single task, time is cut into slices: the greatest entry of each slice is found first (a partial
aggregate), the best before each slice is carried in as one more row, and the running maximum stays within a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import share

DAY = 86_400


def latest_before(questions: DataFrame, entries: DataFrame, by: str, question_time: str, entry_time: str, sequence: str, value: str, out: str, span: int = DAY) -> DataFrame:
    """`questions` with `out`: `value` of the entry with the greatest `sequence` among the entries of the key at or before the time,
    as a struct (sequence, value); null where there is none. Times are whole seconds; questions without a key or time stay, unanswered."""
    entry = F.struct(F.col(sequence).cast("long").alias("sequence"), F.col(value).alias("value"))
    asked = questions.select(F.col(by).alias("_by"), F.col(question_time).cast("long").alias("_at"), F.lit(2).alias("_kind"), F.struct("*").alias("_row"))
    answerable = F.col("_by").isNotNull() & F.col("_at").isNotNull()
    told = entries.select(F.col(by).alias("_by"), F.col(entry_time).cast("long").alias("_at"), F.lit(1).alias("_kind"), entry.alias("_entry")).filter(answerable)
    piece = F.floor(F.col("_at") / span).alias("_slice")
    rows = told.unionByName(asked.filter(answerable), allowMissingColumns=True).withColumn("_slice", piece)
    before = Window.partitionBy("_by").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    best = rows.groupBy("_by", "_slice").agg(F.max("_entry").alias("_best")).withColumn("_entry", F.max("_best").over(before))
    carried = best.filter("_entry is not null").select("_by", (F.col("_slice") * span).alias("_at"), F.lit(0).alias("_kind"), "_entry", "_slice")
    so_far = Window.partitionBy("_by", "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(carried, allowMissingColumns=True).withColumn("_found", F.max("_entry").over(so_far)).filter("_kind = 2").select("_row", "_found")
    rest = asked.filter(~answerable).select("_row", F.lit(None).cast(found.schema["_found"].dataType).alias("_found"))
    return found.unionByName(rest).select("_row.*", F.col("_found").alias(out))


def question_times(questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """at_s where it is given; else the document's last chunk_created entry, else an hour before its last entry."""
    chunked = F.max(F.when(F.col("entry_type") == "chunk_created", F.col("created_s")))
    last = manifest.groupBy("document_id").agg(chunked.alias("_chunked"), F.max("created_s").alias("_last"))
    at = F.coalesce("at_s", "_chunked", F.col("_last") - 3600)
    return questions.join(last, "document_id", "left").withColumn("at_s", at).drop("_chunked", "_last")


def reconstructable_at(questions: DataFrame, manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of each (question_id, document_id, at_s): the chunk count of the latest chunk_created entry then, the present one, and the
    lesser over the greater, to 4 places (1 if both are 0, 0 if one is); null where no entry stood."""
    entries = manifest.filter("entry_type = 'chunk_created'")
    found = latest_before(question_times(questions, manifest), entries, "document_id", "at_s", "created_s", "entry_sequence", "total_chunks", "entry")
    now = chunks.groupBy("document_id").agg(F.count("*").alias("_now"))
    then, present = F.coalesce("entry.value", F.lit(0)), F.coalesce("_now", F.lit(0))
    score = F.when((then == 0) & (present == 0), 1.0).otherwise(share(F.least(then, present), F.greatest(then, present)))
    stood = F.col("entry").isNotNull()
    return found.join(now, "document_id", "left").select(
        "question_id", "document_id", "at_s", F.when(stood, then).cast("long").alias("manifest_count"), present.alias("current_count"), F.when(stood, F.round(score, 4)).alias("score")
    )
