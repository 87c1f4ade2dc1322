"""Retrieval over chunk tables with given vectors, for all queries of a table at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import norm, words
from ..sources.tables import stage_table
from .blocks import best_rows
from .cells import Index, build, search
from .grams import grams, posted

#: Words that name no section.
STOP_WORDS = tuple(
    "this that with from have does been were will would could should they them their what when where which about into more some then than also just each only "
    "manual section chapter page figure table note warning caution guide instructions procedure service maintenance".split()
)


def best(df: DataFrame, by: str | list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first `k` rows of each group, with their place."""
    by = [by] if isinstance(by, str) else by
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= k)


def eligible(chunks: DataFrame, docs: DataFrame, device: str | None = None, doc_type: str = "manual", safety_only: bool = False) -> DataFrame:
    """Chunks with a vector, not blacklisted, of ready documents for the device (no list of models: for all)."""
    fit = F.col("compatible_models").isNull() | (F.size("compatible_models") == 0)
    fit = (fit | F.array_contains("compatible_models", device)) if device else F.lit(True)
    ready = docs.filter((F.col("doc_type") == doc_type) & (F.col("status") == "READY") & fit).select(F.col("id").alias("document_id"))
    rows = chunks.filter("embedding is not null").filter(~F.coalesce("is_blacklisted", F.lit(False)))
    return (rows.filter("has_safety_content") if safety_only else rows).join(ready, "document_id", "left_semi")


def nearest_chunks(queries: DataFrame, chunks: DataFrame, dim: int, k: int = 30) -> DataFrame:
    """query_id, chunk_id, document_id, level, has_safety_content, score (1 - cosine distance), place of the `k` nearest chunks of each query."""
    asked = queries.select("query_id", F.col("query_vector").alias("vector"))
    kept = ["document_id", "level", "has_safety_content"]
    found = best_rows(asked, chunks.select("id", F.col("embedding").alias("vector"), *kept), dim, k, {"cosine": lambda q, r, near: near}, kept)
    return found.select("query_id", F.col("id").alias("chunk_id"), *kept, "score", "place")


def mmr(matches: DataFrame, chunks: DataFrame, k: int = 10, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over each query's candidates, whose number is bounded by the search before."""
    rows = matches.join(chunks.select(F.col("id").alias("chunk_id"), "embedding"), "chunk_id").select("query_id", "chunk_id", "score", "place", "embedding")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        score = pdf["score"].to_numpy()
        chosen = list(range(len(pdf)))
        if len(pdf) > k:
            vectors = np.stack([np.asarray(v, float) for v in pdf["embedding"]])
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            chosen = [int(score.argmax())]
            nearest = vectors @ vectors[chosen[0]]
            while len(chosen) < k:
                value = weight * score - (1 - weight) * nearest
                value[chosen] = -np.inf
                chosen.append(int(value.argmax()))
                nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
        out = pdf.iloc[chosen][["query_id", "chunk_id", "score"]]
        return out.assign(pick=np.arange(1, len(out) + 1, dtype=np.int32))

    kind = dict(matches.dtypes)
    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {kind['query_id']}, chunk_id string, score double, pick int")


def best_document(queries: DataFrame, chunks: DataFrame, dim: int, ring_rows: int = 2048) -> DataFrame:
    """The document whose summaries (level 1 and up) are nearest on average.

    The mean distance to a document's summaries is 1 less the inner product of the query's direction with the mean of theirs, so
    each document is one vector, and the best one is searched for in the cells of these.
    """
    rows = chunks.filter("level >= 1 and embedding is not null").select("document_id", "embedding", norm(F.col("embedding")).alias("_n"))
    sums = [F.sum(F.try_divide(F.get("embedding", F.lit(i)).cast("double"), "_n")) for i in range(dim)]
    means = rows.groupBy(F.col("document_id").alias("id")).agg(F.transform(F.array(*sums), lambda x: x / F.count("*")).alias("vector"))
    best_one, _ = search(build(means, dim, inner=True, ring_rows=ring_rows), queries, 1, digits=6)
    return best_one.select("query_id", F.col("id").alias("document_id"), F.round(1 - F.col("score"), 6).alias("distance"))


def chunk_index(chunks: DataFrame, dim: int, ring_rows: int = 2048) -> Index:
    """The cells of all chunks given; a search may ask for some of them by level or safety content."""
    kept = ["document_id", "level", "has_safety_content"]
    return build(chunks.select("id", F.col("embedding").alias("vector"), *kept), dim, kept, ring_rows=ring_rows)


def indexed_chunks(queries: DataFrame, index: Index, k: int = 30, where: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of `nearest_chunks`, from the index, and how many chunks each query was compared with."""
    found, work = search(index, queries, k, where)
    return found.withColumnRenamed("id", "chunk_id"), work


def summaries(chunks: DataFrame, most: int = 2) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy(F.desc("level"), F.asc_nulls_last("page_start"), "id")
    return chunks.filter(F.col("level").between(1, most)).select("document_id", "id", "level", F.row_number().over(order).alias("place"))


def _reading() -> list[Column]:
    return [F.asc_nulls_last("page_start"), F.asc_nulls_last("sequence_index"), F.col("id")]


def walkthrough(chunks: DataFrame, docs: DataFrame, k: int = 80) -> DataFrame:
    """The first leaves of each ready document in reading order."""
    ready = docs.filter("status = 'READY'").select(F.col("id").alias("document_id"))
    return best(chunks.filter("level = 0").join(ready, "document_id", "left_semi"), "document_id", _reading(), k).select("document_id", "id", "place")


def sections(requests: DataFrame, chunks: DataFrame, k: int = 100) -> DataFrame:
    """For each request (query_id, document_id, text) leaves whose header holds one of its words of 4 letters or more; none: the walkthrough.

    A document's distinct headers are posted under their strings of 4 letters, and a word looks up its first one: only headers
    that may hold it are compared, and only leaves under a header that does are read. The walkthrough is cut once a document.
    """
    wanted = requests.withColumn("w", F.explode_outer(F.filter(words(F.col("text"), 4), lambda x: ~x.isin(*STOP_WORDS))))
    leaves = chunks.filter("level = 0").select("document_id", "id", "section_header", "page_start", "sequence_index")
    heads = leaves.select("document_id", "section_header", F.lower("section_header").alias("head")).distinct()
    posts = heads.withColumn("gram", F.explode(grams(F.col("head"), 4)))
    named = wanted.withColumn("gram", F.substring("w", 1, 4)).join(posts, ["document_id", "gram"]).filter(F.contains("head", F.col("w")))
    hits = named.select("query_id", "document_id", "section_header").distinct().join(leaves, ["document_id", "section_header"])
    found = best(hits, "query_id", _reading(), k).select("query_id", "id", "place", F.lit(False).alias("is_fallback"))
    first = best(leaves, "document_id", _reading(), 80).select("document_id", "id", "place")
    rest = requests.select("query_id", "document_id").join(named.select("query_id").distinct(), "query_id", "left_anti").join(first, "document_id")
    return found.unionByName(rest.select("query_id", "id", "place", F.lit(True).alias("is_fallback")))


def dominant_document(matches: DataFrame, above: float = 0.7) -> DataFrame:
    """Only the matches of a document that has more than `above` of a query's; else all."""
    of = F.count("*").over(Window.partitionBy("query_id", "document_id")) / F.count("*").over(Window.partitionBy("query_id"))
    rows = matches.withColumn("_share", of)
    top = F.max("_share").over(Window.partitionBy("query_id"))
    return rows.withColumn("_top", top).filter((F.col("_top") <= above) | (F.col("_share") == F.col("_top"))).drop("_share", "_top")


def quota(rows: DataFrame, by: str, has_image: Column, order: list[Column], k: int = 100, share: float = 0.3) -> DataFrame:
    """`k` rows of each group, of which up to `share` are kept free for rows with images; the rest in order."""
    flagged = rows.withColumn("_image", has_image)
    placed = flagged.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_image").orderBy(*order)))
    first = F.col("_image") & (F.col("_n") <= int(k * share))
    kept = placed.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(first), *order))).filter(F.col("_k") <= k)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).drop("_image", "_n", "_k")


def swap_parents(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Children give way to their parent, once, at the place of the first; a parent that is missing takes its children along."""
    parents = chunks.select(F.col("id").alias("chunk_id"), "parent_id")
    rows = matches.join(parents, "chunk_id").select("query_id", "place", F.coalesce("parent_id", "chunk_id").alias("shown"))
    first = rows.groupBy("query_id", "shown").agg(F.min("place").alias("place"))
    known = chunks.select(F.col("id").alias("shown"))
    return first.join(known, "shown", "left_semi").select("query_id", F.col("shown").alias("chunk_id"), "place")


def neighbours(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Leaves just before and after the retrieved ones, that were not retrieved."""
    at = chunks.filter("level = 0").select(F.col("id").alias("chunk_id"), "document_id", "sequence_index")
    hits = matches.select("query_id", "chunk_id").join(at, "chunk_id")
    around = hits.select("query_id", "document_id", F.explode(F.array(F.col("sequence_index") - 1, F.col("sequence_index") + 1)).alias("sequence_index")).filter("sequence_index >= 0").distinct()
    return around.join(at, ["document_id", "sequence_index"]).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "document_id", "sequence_index")


def relevance_cut(rows: DataFrame, by: str, score: str, k: int, least: int, floor: int = 2) -> DataFrame:
    """Best scores first (missing: 0), those of `least` and more, but `floor` rows at least, `k` at most."""
    s = F.coalesce(score, F.lit(0))
    placed = best(rows, by, [F.desc(s), F.col("id")], k)
    return placed.filter((s >= least) | (F.col("place") <= floor))


def safety_search(queries: DataFrame, index: Index, k: int = 10, enough: int = 3) -> DataFrame:
    """Safety chunks; where there are fewer than `enough`, general ones too, safety ones with 0.05 more. Both from one index."""
    safe = stage_table(indexed_chunks(queries, index, k, "has_safety_content")[0])
    few = queries.join(safe.filter(F.col("place") == enough).select("query_id"), "query_id", "left_anti").select("query_id", "query_vector")
    general = indexed_chunks(few, index, k)[0].withColumn("score", F.col("score") + F.when(F.col("has_safety_content"), 0.05).otherwise(0.0))
    both = safe.unionByName(general).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return best(both, "query_id", [F.desc("score"), F.col("chunk_id")], k).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place")


def dual_path(a: DataFrame, b: DataFrame) -> DataFrame:
    """A's rows, then those of B that A lacks; each chunk once."""
    rows = a.select("query_id", "chunk_id", F.lit(0).alias("path"), "place").unionByName(b.select("query_id", "chunk_id", F.lit(1).alias("path"), "place"))
    return rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("path", "place")).alias("s")).select("query_id", "chunk_id", "s.path", "s.place")


def merge_queries(matches: DataFrame, texts: DataFrame, group: Column) -> DataFrame:
    """Matches of several queries of a group, by query number, without those whose first 80 characters were seen."""
    rows = matches.join(texts.select(F.col("id").alias("chunk_id"), F.substring("text", 1, 80).alias("head")), "chunk_id").withColumn("group_id", group)
    kept = best(rows, ["group_id", "head"], [F.col("query_id"), F.col("place")], 1, "_n")
    return kept.select("group_id", "query_id", "chunk_id")


def section_groups(rows: DataFrame, by: str, most: int = 8) -> DataFrame:
    """Rows with their section label (blank: ungrouped) and place in it, by relevance score then similarity, missing as -1; `most` of each."""
    label = F.when(F.trim(F.coalesce("section_header", F.lit(""))) == "", "ungrouped").otherwise(F.trim("section_header"))
    order = [F.desc(F.coalesce("reranker_score", F.lit(-1))), F.desc(F.coalesce("similarity_score", F.lit(-1.0))), F.col("id")]
    return best(rows.withColumn("label", label), [by, "label"], order, most)


def context_budget(groups: DataFrame, by: str, budget: int = 12) -> DataFrame:
    """All rows where the budget holds them; else one of each group and the rest by group size, or one of each of the best groups where
    they are too many."""
    per = groups.groupBy(by, "label").agg(F.count("*").alias("size"), F.max(F.coalesce("reranker_score", F.lit(-1))).alias("top"))
    total, n = F.sum("size").over(Window.partitionBy(by)), F.count("*").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("top"), "label"))
    share = F.when(F.col("total") <= budget, F.col("size")).when(F.col("n") <= budget, 1 + F.floor((budget - F.col("n")) * F.col("size") / F.col("total"))).otherwise(F.when(F.col("rank") <= budget, 1).otherwise(0))
    given = per.withColumn("total", total).withColumn("n", n).withColumn("rank", rank).select(by, "label", share.cast("int").alias("given"))
    return groups.join(given, [by, "label"]).filter(F.col("place") <= F.col("given"))


def context_text(rows: DataFrame, by: str) -> DataFrame:
    line = F.concat("label", F.lit("#"), F.col("place").cast("string"), F.lit(":"), "id")
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("context"), F.count("*").alias("n"))


def limited_context(rows: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Rows whose ids are wanted; all rows of a group for which none is."""
    hit = rows.join(wanted.select(by, "id", F.lit(True).alias("_hit")).distinct(), [by, "id"], "left")
    some = F.max(F.coalesce("_hit", F.lit(False))).over(Window.partitionBy(by))
    return hit.withColumn("_some", some).filter(~F.col("_some") | F.col("_hit")).drop("_hit", "_some")


def cited_chunks(refs: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """Refs CHUNK-n to the n-th row of their group; others and those out of range are dropped."""
    n = refs.select(by, F.regexp_extract("ref", r"^CHUNK-(\d+)$", 1).alias("n")).filter("n <> ''").select(by, F.col("n").cast("int").alias("place")).distinct()
    return n.join(rows.select(by, "place", "id"), [by, "place"])


def example_search(queries: DataFrame, examples: DataFrame, dim: int, k: int = 3, most: float = 0.45, cut: int | None = None, ring_rows: int = 2048) -> DataFrame:
    """Live examples of the query's category or GENERAL and of its device or none: the `k` nearest, and of these those within `most`; their text up to `cut` characters.

    Category and device are one tag of an example, and a query asks for four at most, so that the cells of all examples serve all of
    them; `most` bounds what is read from the start. Examples without a category fit none.
    """
    live = examples.filter("is_active and not is_superseded and category is not null")
    tag = lambda category, device: F.to_json(F.struct(category.alias("c"), device.alias("d")))
    rows = live.select(F.col("example_id").alias("id"), "vector", tag(F.col("category"), F.col("for_device")).alias("tag"))
    none = F.lit(None).cast("string")
    tags = F.array_distinct(F.array(*[tag(c, d) for c in (F.col("category"), F.lit("GENERAL")) for d in (F.col("device"), none)]))
    asked = queries.select("query_id", "query_vector", tags.alias("tags"))
    near, _ = search(build(rows, dim, tag="tag", ring_rows=ring_rows), asked, k, floor=round(1 - most, 6), digits=6)
    found = near.select("query_id", F.col("id").alias("example_id"), F.round(1 - F.col("score"), 6).alias("distance"), "place")
    return found.join(live.select("example_id", (F.substring("text", 1, cut) if cut else F.col("text")).alias("text")), "example_id")


def match_rules(requests: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """The live rule whose keywords the request's text holds all, of its category or GENERAL and of its device or none: highest priority, then newest.

    Rules are posted under their rarest gram and checked on the candidates (see `grams`); of rules that ask for the same, only the first can win and is kept.
    Requests of the same text, category and device are answered once.
    """
    live = rules.filter((F.col("is_active")) & (F.col("is_approved")) & (F.col("expires").isNull() | (F.col("expires") > now)))
    low = live.withColumn("keywords", F.array_sort(F.array_distinct(F.transform("keywords", F.lower))))
    asked = ["keywords", "category", "device"]
    top = low.groupBy(*asked).agg(F.max(F.struct("priority", "created_s", "rule_id")).alias("r")).select(*asked, "r.*")
    said = ["low", "its_category", "its_device"]
    asks = requests.select("query_id", F.lower("text").alias("low"), F.col("category").alias("its_category"), F.col("device").alias("its_device"))
    texts, posts = posted(asks.select(*said).distinct(), "low", top.withColumn("_pattern", F.col("rule_id")), "keywords")
    fits = F.col("category").isin("GENERAL") | (F.col("category") == F.col("its_category"))
    fits = fits & (F.col("device").isNull() | (F.col("device") == F.col("its_device"))) & F.forall("keywords", lambda k: F.contains("low", k))
    largest = F.max(F.struct("priority", "created_s", "rule_id")).alias("r")
    answers = texts.join(posts, "gram").filter(fits).groupBy(*said).agg(largest).select(*[F.col(c).alias(f"_{c}") for c in said], "r.*")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in said]
    won = asks.join(answers, same).groupBy("query_id").agg(largest)
    return won.select("query_id", "r.rule_id", "r.priority")


def _cited() -> Column:
    """Whether a cite tag of step_text names the chunk's `page`; several numbers may stand in one tag."""
    return F.coalesce(F.array_contains(_pages(F.col("step_text")), F.col("page").cast("string")), F.lit(False))


def _jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))), F.lit(0.0))


def _pages(text: Column) -> Column:
    """The numbers that the cite tags of a text name; several may stand in one tag."""
    tags = F.regexp_extract_all(text, F.lit("""<cite[^>]+page=["']([^"']+)["']"""), 1)
    return F.flatten(F.transform(tags, lambda x: F.regexp_extract_all(x, F.lit(r"0*(\d+)"), 1)))


def _alike(a: str, b: str, captions: str) -> Column:
    """Of arrays of words: whether the first has any, its Jaccard with the second and its best one with the captions'."""
    best = F.coalesce(F.array_max(F.transform(captions, lambda c: _jaccard(F.col(a), c))), F.lit(0.0))
    return F.struct((F.size(a) > 0).alias("has_words"), _jaccard(F.col(a), F.col(b)).alias("text"), best.alias("caption"))


def _lexical(alike: str, cited: Column) -> Column:
    score = 0.55 * F.col(f"{alike}.text") + F.when(cited, 0.25).otherwise(0.0) + 0.2 * F.col(f"{alike}.caption")
    return F.when(F.col(f"{alike}.has_words"), F.floor(score * 1e6 + 0.5) / 1e6).otherwise(0.0).alias("score")


def lexical_scores(pairs: DataFrame) -> DataFrame:
    """.55 Jaccard of words, .25 for a cited page, .20 best Jaccard of the captions, of step_text, chunk_text, captions, page.
    A step without words has 0."""
    keys = ["response_id", "step_index", "chunk_id"]
    sets = pairs.select(  # each text is split once
        *keys, words(F.col("step_text"), 3).alias("a"), words(F.col("chunk_text"), 3).alias("b"), F.transform("captions", lambda c: words(c, 3)).alias("c"), _cited().alias("cited")
    )
    return sets.select(*keys, "cited", _alike("a", "b", "c").alias("alike")).select(*keys, _lexical("alike", F.col("cited")))


def shared_lexical_scores(pairs: DataFrame, steps: DataFrame, chunks: DataFrame, captions: Column) -> DataFrame:
    """The scores of `lexical_scores` where many steps share a text: a chunk is split once and compared once with each text.

    pairs: response_id, step_index, chunk_id, text_id and tags, the step's own cite tags; steps: text_id and step_text, which has all words of
    the step; chunks: chunk_id, chunk_text, page; captions: an array, of the columns of steps and chunks. Texts move once a chunk
    or distinct pair, not once a step.
    """
    split = chunks.withColumn("b", words(F.col("chunk_text"), 3)).drop("chunk_text")
    said = steps.withColumn("a", words(F.col("step_text"), 3))
    met = pairs.select("text_id", "chunk_id").distinct().join(said, "text_id").join(split, "chunk_id")
    sets = met.select("text_id", "chunk_id", "page", "a", "b", F.transform(captions, lambda c: words(c, 3)).alias("c"), _pages(F.col("step_text")).alias("pages"))
    alike = sets.select("text_id", "chunk_id", "page", _alike("a", "b", "c").alias("alike"), F.coalesce(F.array_contains("pages", F.col("page").cast("string")), F.lit(False)).alias("of_text"))
    rows = pairs.join(alike, ["text_id", "chunk_id"])
    cited = F.col("of_text") | F.coalesce(F.array_contains(_pages(F.col("tags")), F.col("page").cast("string")), F.lit(False))
    return rows.select("response_id", "step_index", "chunk_id", _lexical("alike", cited))


def in_reading_order(pairs: DataFrame) -> DataFrame:
    """`pairs` with the places from 0 of their step (step_at) and chunk (chunk_at, by page, then id) in the response, and
    how many it has (n_steps, n_chunks)."""
    place = lambda *by: F.dense_rank().over(Window.partitionBy("response_id").orderBy(*by)) - 1
    rows = pairs.withColumn("step_at", place("step_index")).withColumn("chunk_at", place(F.asc_nulls_last("page"), "chunk_id"))
    most = lambda c: F.max(c).over(Window.partitionBy("response_id")) + 1
    return rows.withColumn("n_steps", most("step_at")).withColumn("n_chunks", most("chunk_at"))


def positional_scores(pairs: DataFrame) -> DataFrame:
    """.5 max(0, 1 - 2.5 d) of relative places, .3 for a cited page, .2 times the share of the header's words that the step has,
    of (step_at, n_steps, chunk_at, n_chunks, step_text, header, page). A single chunk is near (1), a single step half so."""
    apart = F.abs(F.try_divide("step_at", F.col("n_steps") - 1) - F.try_divide("chunk_at", F.col("n_chunks") - 1))
    near = F.when((F.col("n_steps") > 1) & (F.col("n_chunks") > 1), F.greatest(F.lit(0.0), 1 - 2.5 * apart)).when(F.col("n_chunks") == 1, 1.0).otherwise(0.5)
    head = words(F.trim("header"), 5)
    shared = F.coalesce(F.when(F.size(head) > 0, F.size(F.array_intersect(head, words(F.col("step_text"), 5))) / F.size(head)), F.lit(0.0))
    return pairs.select("response_id", "step_index", "chunk_id", F.round(0.5 * near + F.when(_cited(), 0.3).otherwise(0.0) + 0.2 * shared, 6).alias("score"))


def assign(scores: DataFrame, above: float = 0.1) -> DataFrame:
    """The best chunk of each step above the threshold."""
    best = scores.groupBy("response_id", "step_index").agg(F.max_by("chunk_id", F.struct("score", "chunk_id")).alias("chunk_id"), F.max("score").alias("score"))
    return best.filter(F.col("score") > above)  # after the aggregation, so that no score is worked out twice


def assign_in_order(scores: DataFrame, above: float = 0.1, reach: int = 1) -> DataFrame:
    """As above, but the chunk's place never falls from step to step; chunks with images left over then go to the nearest
    step that has a chunk, `reach` steps away at most. One response at a time, whose steps and chunks are few."""

    def one(rows: list[tuple]) -> Iterator[tuple]:
        low, taken, filled = -1, set(), []
        for step, group in groupby(rows, key=lambda r: r[1]):
            top = next((r for r in group if r[3] is not None and r[4] is not None and r[4] >= low and r[3] > above), None)
            if top:
                low = top[4]
                taken.add(top[2])
                filled.append(step)
                yield top[0], step, top[2], top[3], False
        for _, group in groupby(sorted((r for r in rows if r[5] and r[2] not in taken), key=lambda r: (r[2], r[1])), key=lambda r: r[2]):
            row = next(group)
            away, step = min(((abs(s - row[1]), s) for s in filled), default=(reach + 1, 0))
            if away <= reach:
                yield row[0], step, row[2], 0.0, True

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in chain(batches, [None]):
            rows = held + (list(zip(*(c.to_pylist() for c in batch.columns), strict=True)) if batch else [])
            groups = [list(g) for _, g in groupby(rows, key=lambda r: r[0])]
            held = groups.pop() if groups and batch else []
            found = [x for g in groups for x in one(g)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["response_id", "step_index", "chunk_id", "score", "is_rescued"])

    ordered = scores.select("response_id", "step_index", "chunk_id", "score", "chunk_at", "has_image").repartition("response_id").sortWithinPartitions("response_id", "step_index", F.desc("score"), "chunk_id")
    return ordered.mapInArrow(walk, "response_id long, step_index int, chunk_id string, score double, is_rescued boolean")


def resolve_references(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text references to chunks of a document: an id as it is, else `Seq n` (the last such chunk), else `Page n` or `:n` (the first)."""
    pick = lambda pattern: F.nullif(F.regexp_extract("ref", pattern, 1), F.lit("")).cast("int")
    rows = refs.withColumn("seq", pick(r"(?i)seq\s*(\d+)")).withColumn("page", F.coalesce(pick(r"(?i)page\s*(\d+)"), pick(r":(\d+)$")))
    leaves = chunks.filter("level = 0")
    by_seq = leaves.groupBy("document_id", F.col("sequence_index").alias("seq")).agg(F.max("id").alias("by_seq"))
    by_page = leaves.groupBy("document_id", F.col("page_start").alias("page")).agg(F.min_by("id", "sequence_index").alias("by_page"))
    own = chunks.select(F.col("id").alias("ref"), F.col("id").alias("by_id"))
    out = rows.join(own, "ref", "left").join(by_seq, ["document_id", "seq"], "left").join(by_page, ["document_id", "page"], "left")
    return out.withColumn("chunk_id", F.coalesce("by_id", "by_seq", "by_page")).filter("chunk_id is not null").select("ref", "document_id", "chunk_id")


def link_table(bare: DataFrame, attributed: DataFrame) -> DataFrame:
    """Bare rows but for chunks that a step was attributed to, and the step rows."""
    rest = bare.join(attributed.select("response_id", "chunk_id").distinct(), ["response_id", "chunk_id"], "left_anti")
    return rest.select("response_id", "chunk_id", F.lit(None).cast("long").alias("step_index")).distinct().unionByName(attributed.select("response_id", "chunk_id", F.col("step_index").cast("long").alias("step_index")))


def step_attribution(links: DataFrame, chunks: DataFrame) -> DataFrame:
    rows = links.join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_start"), "chunk_id")
    order = Window.partitionBy("response_id").orderBy(F.asc_nulls_last("step_index"), F.desc("similarity_score"), "id")
    return rows.select("response_id", "id", "document_id", "page_start", F.row_number().over(order).alias("place"))


def allocation(links: DataFrame) -> DataFrame:
    """Links of each response by where they went: step_i, else their label, else unattributed."""
    to = F.when(F.col("step_index").isNotNull(), F.concat(F.lit("step_"), F.col("step_index").cast("string"))).otherwise(F.coalesce("grounding_label", F.lit("unattributed")))
    return links.groupBy("response_id", to.alias("allocated_to")).agg(F.count("*").alias("n"))


def filtered_out(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Per response its candidates (response_id, chunk_id), and those that no link kept."""
    kept = links.select("response_id", "chunk_id").distinct().withColumn("kept", F.lit(True))
    rows = candidates.select("response_id", "chunk_id").distinct().join(kept, ["response_id", "chunk_id"], "left")
    return rows.groupBy("response_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("kept").isNull()).alias("filtered_out"))


def step_images(links: DataFrame, image: Column) -> DataFrame:
    """Each image of a response at the first step that has it."""
    rows = links.filter("step_index is not null").withColumn("image", image).filter("image is not null")
    return rows.groupBy("response_id", "image").agg(F.min("step_index").alias("step_index"))


def citations(matches: DataFrame, texts: DataFrame) -> DataFrame:
    """The block of text that cites each chunk, and all of a query's in order."""
    rows = matches.join(texts.select(F.col("id").alias("chunk_id"), "section_header", "page_start", "sequence_index"), "chunk_id")
    kind = F.when(F.col("level") >= 2, "Chapter").when(F.col("level") == 1, "Section").otherwise("Passage")
    block = F.concat(kind, F.lit(" doc "), F.col("document_id").cast("string"), F.lit(" page "), F.coalesce(F.col("page_start").cast("string"), F.lit("-")), F.lit(" "), "section_header")
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n").alias("context"))


def funnel(matches: DataFrame, cache: DataFrame, kept: DataFrame) -> DataFrame:
    """Per query: candidates, those with feedback, those kept, best score."""
    known = cache.select("chunk_id", F.lit(True).alias("boosted"))
    n = kept.groupBy("query_id").agg(F.count("*").alias("kept"))
    counted = matches.join(known, "chunk_id", "left").groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if("boosted").alias("boosted"), F.round(F.max("score"), 6).alias("best"))
    return counted.join(n, "query_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
