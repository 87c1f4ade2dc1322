"""Session search: substrings in any case, by postings of short strings, then filters and a page.

The index is two Parquet tables in one folder: `postings` (gram, id) in folders by the gram's bucket, and `rows` in folders by the id's.
A search reads only the buckets of its own grams, keeps the ids that have all of them, reads only these ids' row buckets, and
checks the text itself. A term of one or two characters is a gram itself; the empty term is no search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grams import SIZE, all_grams
from .review import page

BUCKETS = 64
#: Rows whose postings of a bucket one task takes, on average.
ROWS = 200_000


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


def _dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Each bucket in `parts` tasks, by the rows' ids: a string that every row has is shared out too."""
    return df.repartitionById(BUCKETS * parts, F.col("bucket") * parts + F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts)).cast("int"))


def build_index(rows: DataFrame, columns: list[str], path: str, key: str = "id", rows_of_part: int = ROWS) -> None:
    """Post every string of up to three characters of the columns, in lower case; nulls have none.

    A task takes the postings of one bucket and of about `rows_of_part` rows, so its memory does not grow with the table.
    """
    parts = max(1, -(-rows.count() // rows_of_part))
    texts = F.array_compact(F.array(*(F.lower(F.col(c).cast("string")) for c in columns)))
    posts = rows.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.flatten(F.transform(texts, lambda t: all_grams(t))))).alias("gram"))
    _dealt(posts.select("gram", "id", _bucket("gram")), "id", parts).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    _dealt(rows.select("*", _bucket(key)), key, parts).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")


def term_grams(term: str) -> list[str]:
    low = term.lower()
    return sorted({low[i : i + SIZE] for i in range(max(1, len(low) - SIZE + 1))}) if low else []


def found(spark: SparkSession, path: str, columns: list[str], term: str, key: str = "id") -> DataFrame:
    """The rows that hold `term` in one of the columns, as it stands: %, _ and \\ are characters like others."""
    rows = spark.read.parquet(f"{path}/rows")
    grams = term_grams(term)
    if not grams:
        return rows.drop("bucket")
    posts = spark.read.parquet(f"{path}/postings")
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket("gram"))
    buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # as many as the term has grams
    ids = posts.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).groupBy("id").agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(grams)).select("id")
    places = [r["bucket"] for r in ids.select(_bucket("id")).distinct().collect()]  # BUCKETS at most
    holds = F.lit(False)
    for c in columns:
        holds = holds | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower())), F.lit(False))
    return rows.filter(F.col("bucket").isin(places)).drop("bucket").join(ids.withColumnRenamed("id", key), key, "left_semi").filter(holds)


def review_queue(sessions: DataFrame, evals: DataFrame, status: str | None = None, by: str = "created_s", falling: bool = True, size: int = 20, number: int = 0) -> DataFrame:
    """One page of sessions, of one review state or all: escalated first, then by risk, then by date (or another column), with their latest evaluation."""
    rows = sessions if status is None else sessions.filter(F.col("review_state") == status)
    order = [F.coalesce("is_escalated", F.lit(False)).desc(), F.desc_nulls_last("risk_tier"), F.desc_nulls_last(by) if falling else F.asc_nulls_first(by), F.col("id")]
    placed = page(rows, order, size, number)
    shown = evals.withColumnRenamed("thread_id", "_of").join(F.broadcast(placed.select(F.col("id").alias("_of")).distinct()), "_of", "left_semi")  # `size` rows at most
    last = shown.groupBy(F.col("_of").alias("id")).agg(F.max_by(F.struct("badge", "sync_faithfulness", "sync_answer_relevance"), "id").alias("e"))
    return placed.join(last, "id", "left").select(*placed.columns, "e.badge", "e.sync_faithfulness", "e.sync_answer_relevance")
