"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def seeded(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of whole numbers below 2^31 - 1, the same in any SQL engine."""
    return (((F.col(key).cast("long") * 7919 + seed) % 2147483647) * 48271 + 11) % 2147483647


def numbered(df: DataFrame, key: str, seed: int, out: str, parts: int = 256) -> DataFrame:
    """`df` with `out`, each row's number from 0 in the seeded order of `key` (then `key`).

    The order's range is cut into `parts`: rows are numbered within their part, and only the parts' counts are put in
    a row by one task.
    """
    rows = df.withColumn("_o", seeded(key, seed)).withColumn("_part", F.floor(F.col("_o") * parts / 2147483647))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_part").alias("_of"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_o", key)) - 1
    found = rows.withColumn("_within", within).join(F.broadcast(starts), F.col("_part") == F.col("_of"))  # `parts` rows at most
    return found.withColumn(out, F.col("_before") + F.col("_within")).select(*df.columns, out)


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """Inner product of two arrays of numbers, summed in order. With the length given it is one compiled expression."""
    if dim:
        terms = [F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(dim)]
        return sum(terms, F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(a, a, dim))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers. Where rows meet many others, keep `norm` with each and divide `dot` by both."""
    return dot(a, b) / (norm(a) * norm(b))


def kappa(agree: Column, n: Column, *products: Column) -> Column:
    """Cohen's kappa from agreements, pairs and the products of the marginal counts; 1 where chance is sure, 0 of no pairs."""
    chance = sum(products[1:], products[0]) / (n * n)
    return F.when(n == 0, 0.0).when(chance >= 1, 1.0).otherwise((agree / n - chance) / (1 - chance))


def words(text: Column, least: int) -> Column:
    """The distinct lower-case words of at least `least` letters, digits or underscores of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"([\p{{L}}\p{{N}}_]{{{least},}})"), 1))


def to_envelope(df: DataFrame, metric: str, key: str | None, value: str) -> DataFrame:
    """metric_name, key, value and the other columns as JSON text: one long report table for all metrics."""
    rest = [c for c in df.columns if c not in (key, value)]
    return df.select(
        F.lit(metric).alias("metric_name"), (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        F.round(F.col(value).cast("double"), 4).alias("value"), F.to_json(F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))).alias("metadata"),
    )
