"""What a model is shown of the chunks found: neighbours in reading order, blocks that cite each chunk, a document's overview, images of steps, and the counters of the funnel.

Chunks: id, document_id, name, doc_path, pages, page_start, sequence_index, section_header, level, text, images (array of path and caption).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .feedback import boosted

#: The place of rows without one, the length of text that tells repeats, and the words of the blocks.
LAST, HEAD = 9999, 80
OVERVIEW, DIAGRAMS, CAPTION = "--- MANUAL OVERVIEW ---", "\nRelevant Diagrams:\n", "Diagram"
BLOCK = "---[%s | doc: %s | Page %s%s]---\n%s\n"


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("-"))


def _late(column: str) -> Column:
    """No place and place 0 alike come last."""
    return F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(LAST))


def with_neighbours(hits: DataFrame, chosen: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hits (query_id, chunk_id) in the chosen document of their query (query_id, document_id) and the leaves just before and after them, in
    reading order; and how many neighbouring places were asked for, filled, and left out as a text that begins like one already there.

    Texts are alike when their first 80 characters are; a leaf without text is left out too. A query without hits in its document has no row.
    """
    leaves = chunks.filter("level = 0").select(F.col("id").alias("chunk_id"), "document_id", "sequence_index", "page_start", F.substring(F.coalesce("text", F.lit("")), 1, HEAD).alias("head"))
    own = hits.select("query_id", "chunk_id").distinct().join(chosen, "query_id").join(leaves, ["chunk_id", "document_id"])
    there = own.select("query_id", "document_id", "sequence_index").filter("sequence_index is not null").distinct()
    around = there.select("query_id", "document_id", F.explode(F.array(F.col("sequence_index") - 1, F.col("sequence_index") + 1)).alias("sequence_index"))
    asked = around.filter("sequence_index >= 0").distinct().join(there, ["query_id", "document_id", "sequence_index"], "left_anti")
    found = asked.join(leaves, ["document_id", "sequence_index"])
    same = own.select("query_id", "head").distinct().withColumn("_seen", F.lit(True))
    first = F.row_number().over(Window.partitionBy("query_id", "head").orderBy("sequence_index", F.asc_nulls_last("page_start"), "chunk_id"))
    judged = found.join(same, ["query_id", "head"], "left").withColumn("is_added", F.col("_seen").isNull() & (F.col("head") != "") & (first == 1))
    columns = ["query_id", "chunk_id", "document_id", "sequence_index", "page_start"]
    rows = own.select(*columns, F.lit(False).alias("is_neighbour")).unionByName(judged.filter("is_added").select(*columns, F.lit(True).alias("is_neighbour")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(_late("sequence_index"), _late("page_start"), "chunk_id"))
    filled = judged.groupBy("query_id").agg(F.count_if("is_added").alias("added"), F.count_if(~F.col("is_added")).alias("duplicates"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = asked.groupBy("query_id").agg(F.count("*").alias("requested")).join(filled, "query_id", "left").select("query_id", "requested", zero("added"), zero("duplicates"))
    return rows.select("query_id", "chunk_id", "is_neighbour", place.alias("place")), counts


def blocks(chunks: DataFrame, base: str) -> DataFrame:
    """chunk_id, block, image_keys: each chunk's heading, text and image lines. Paths that are no address stand under `base`."""
    url = lambda path: F.when(F.startswith(path, F.lit("http")), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    kept = F.filter(F.coalesce("images", F.array()), lambda x: x["path"].isNotNull())
    lines = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("!["), F.coalesce(x["caption"], F.lit(CAPTION)), F.lit("]("), url(x["path"]), F.lit(")\n"))), "")
    seq = F.coalesce(F.concat(F.lit(" | Seq "), F.col("sequence_index").cast("string")), F.lit(""))
    text = F.format_string(BLOCK, _shown("name"), _shown("doc_path"), _shown("pages"), seq, F.coalesce("text", F.lit("")))
    return chunks.select(F.col("id").alias("chunk_id"), F.concat(text, F.when(F.size(kept) > 0, F.concat(F.lit(DIAGRAMS), lines)).otherwise("")).alias("block"), F.transform(kept, lambda x: x["path"]).alias("image_keys"))


def cited_context(matches: DataFrame, chunks: DataFrame, base: str) -> DataFrame:
    """Per query the blocks of its matches (query_id, chunk_id, place) in order, a blank line between, and the distinct image keys as first seen."""
    rows = matches.join(blocks(chunks, base), "chunk_id")
    held = F.array_sort(F.collect_list(F.struct("place", "chunk_id", "block", "image_keys")))  # as many as a search gives
    return rows.groupBy("query_id").agg(held.alias("b")).select(
        "query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"), F.array_distinct(F.flatten(F.transform("b", lambda x: x["image_keys"]))).alias("image_keys")
    )


def overview(chunks: DataFrame, most: int = 2) -> DataFrame:
    """Per document its summaries, chapters (level 2 and up) before sections, by page; a document without any has no row."""
    label = F.when(F.col("level") >= 2, "Chapter").otherwise("Section")
    head = F.nullif(F.col("section_header"), F.lit(""))
    named = F.coalesce(F.concat(F.lit(" — "), head, F.lit(" ")), F.lit(" "))
    line = F.concat(F.lit("["), label, F.lit(" Summary"), named, F.lit("(pp. "), _shown("pages"), F.lit(")]\n"), F.coalesce("text", F.lit("")))
    order = F.struct((-F.col("level")).alias("l"), F.col("page_start").isNull().alias("n"), "page_start", "id", line.alias("line"))
    rows = chunks.filter(F.col("level").between(1, most)).groupBy("document_id").agg(F.array_sort(F.collect_list(order)).alias("s"))
    return rows.select("document_id", F.concat_ws("\n\n", F.lit(OVERVIEW), F.transform("s", lambda x: x["line"])).alias("overview"))


def step_images(assigned: DataFrame, shown: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each image (chunk_id, position, url, caption) at the first step of a response (response_id, step_index, chunk_at, chunk_id) that has it, in order; and
    per response of `shown` (response_id, chunk_id) how many steps have images and how many of its images no step has."""
    order = F.struct("step_index", "chunk_at", "position", F.col("caption").isNull(), "caption")
    rows = assigned.join(images, "chunk_id").groupBy("response_id", "url").agg(F.min_by(F.struct("step_index", "chunk_at", "position", "caption"), order).alias("f"))
    place = F.row_number().over(Window.partitionBy("response_id", "f.step_index").orderBy("f.chunk_at", "f.position", "url"))
    used = rows.select("response_id", "f.step_index", place.alias("place"), "url", "f.caption")
    every = shown.select("response_id", "chunk_id").distinct().join(images.select("chunk_id", "url"), "chunk_id").select("response_id", "url").distinct()
    left = every.join(rows.select("response_id", "url"), ["response_id", "url"], "left_anti").groupBy("response_id").agg(F.count("*").alias("unmatched"))
    steps = rows.groupBy("response_id").agg(F.count_distinct("f.step_index").alias("steps_with_images"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = shown.select("response_id").distinct().join(steps, "response_id", "left").join(left, "response_id", "left")
    return used, counts.select("response_id", zero("steps_with_images"), zero("unmatched"))


def funnel(matches: DataFrame, cache: DataFrame, kept: DataFrame, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Per kept chunk (query_id, chunk_id, reranker_score) its cosine, its score with feedback and its relevance; and per query the candidates before and
    after the cut and how many of them feedback moved."""
    scored = boosted(matches.select("query_id", "chunk_id", "score"), cache, alpha).withColumn("cosine", F.round("score", 6))
    chosen = kept.select("query_id", "chunk_id", "reranker_score", F.lit(1).alias("_kept"))
    rows = scored.join(chosen, ["query_id", "chunk_id"], "left")
    scores = rows.filter("_kept = 1").select("query_id", "chunk_id", "cosine", "adjusted", F.col("reranker_score").alias("reranker"))
    counts = rows.groupBy("query_id").agg(F.count("*").alias("candidates_before"), F.count("_kept").alias("candidates_after"), F.count_if(F.col("adjusted") != F.col("cosine")).alias("chunks_boosted"))
    return scores, counts
