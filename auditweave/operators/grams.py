"""Substring joins by an inverted index of short strings.

A text holds a keyword only if it holds all the keyword's grams (its strings of 3 characters, or itself if it is
shorter). So each pattern is posted under one gram, the one that the fewest texts have, and a text meets the patterns posted under its own
grams; candidates are then checked. A text never meets a pattern whose rarest gram it lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def grams(text: Column, size: int = SIZE) -> Column:
    """The distinct strings of `size` characters; a text that is shorter has itself, an empty one none."""
    n = F.char_length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(cut))


def all_grams(text: Column, size: int = SIZE) -> Column:
    """The grams that any pattern within the text may be posted under: its distinct strings of 1 to `size` characters."""
    n = F.char_length(text)
    parts = [F.when(n >= k, grams(text, k)).otherwise(F.array().cast("array<string>")) for k in range(1, size + 1)]
    return F.array_union(F.array_union(parts[0], parts[1]), parts[2]) if size == 3 else F.array_distinct(F.flatten(F.array(*parts)))


def posted(texts: DataFrame, text: str, patterns: DataFrame, keywords: str) -> tuple[DataFrame, DataFrame]:
    """(texts with `gram`, patterns with `gram`): join them by gram to get candidates.

    `keywords` is an array, in the texts' case; the rarest gram of all its keywords is chosen by the number of texts that have it. Patterns
    without any gram (no keywords, or empty ones) stand under the empty gram, which every text has.
    """
    keyed = patterns.withColumn("_pattern", F.monotonically_increasing_id() if "_pattern" not in patterns.columns else F.col("_pattern"))
    own = keyed.select("_pattern", F.explode(F.array_distinct(F.flatten(F.transform(keywords, lambda k: grams(k))))).alias("gram"))
    spread = texts.withColumn("gram", F.explode(F.array_union(F.array(F.lit("")), all_grams(F.col(text)))))
    counts = spread.select("gram").join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = own.join(counts, "gram", "left").groupBy("_pattern").agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    return spread, keyed.join(rarest, "_pattern", "left").withColumn("gram", F.coalesce("gram", F.lit(""))).drop("_pattern")
