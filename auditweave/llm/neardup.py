"""MinHash near-duplicates by an LSH forest.

Every document's shingle set gives `TREES` x `DEPTH` minima. Each tree is an order of the documents by its own
`DEPTH` minima, sorted as they are; a region of a tree is what agrees in the first `SHALLOW` of them.

1. In a region of up to `SMALL` documents all that may be alike are candidates. A larger one goes as deep as the order
   tells its documents apart: candidates are the neighbours in the order, which have the longest common prefixes, in
   the first `NEAR_TREES` trees. Candidates are confirmed on full sets, and links are followed to components.
2. What is left are pairs of different components that share a larger region. All of them are held together, in
   blocks of `SIDE` x `SIDE`; those that may be alike are candidates, at first the `FEW` most alike of each
   document in a block, and then, between the components that are still apart, every one.

So the smaller number of candidates in the first step costs no link: a pair that shares a region of any tree is
tried, unless both are in one component already. Groups of thousands of copies are joined by their neighbours; a group of n
that nothing joins costs n * n comparisons of sketches, no more candidates than may be alike.

"May be alike" is a bound for most pairs: the sets' bitmaps of parities differ in no more bits than the sets
differ in shingles. The share of agreeing minima (two bits of each) judges what bitmaps cannot: below `MAYBE` no pair of 0.8
is expected (4.5 deviations). Two documents of similarity 0.8 share no region in 1 of 100 000 cases.

Regions of more than `region` documents are parted over tasks in the first step, by the deeper minima and, where
these are all alike, at random, differently in each tree. Documents with equal sets are one class, whose smallest document
stands for it. Null texts and texts without words have the empty set and are linked with nothing.

Every row is judged by its own text and gives a row. Where one id has several texts, each is a document of its own under that id: one of them is
known by the id, the others by numbers made from id and text, and components get the smallest id at the end. Rows without an id are kept. Ids must be
whole numbers (any other type raises an error); other columns than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_numbers, with_class_min, written
from .shingles import blocks, shingle_sets

TREES, DEPTH, SHALLOW, NEAR_TREES = 22, 6, 4, 2
REGION = 20_000
MAYBE = 0.62
SMALL, FEW, SIDE = 32, 4, 512
#: Bits of the parities, minima of which the sketch keeps two bits.
BITS, SKETCHED = 1024, 128
BLOCK_BYTES, TASK_EDGES = 1 << 18, 200_000
#: Bytes of a place in an order: the tree, then its minima, first byte first; and of the part that names the region.
PREFIX = 1 + 4 * SHALLOW

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the linear permutations over the set's hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def _places(signature: np.ndarray) -> list[bytes]:
    """The document's place in each tree's order."""
    return [bytes([t]) + minima.tobytes() for t, minima in enumerate(signature.astype(">u4").reshape(TREES, DEPTH))]


def _sketch(signature: np.ndarray) -> bytes:
    """Two bits of each of the first `SKETCHED` minima, packed."""
    two = (signature[:SKETCHED] * np.uint32(0x9E3779B1)) >> np.uint32(30)
    return np.packbits(np.stack(((two >> 1) & 1, two & 1), axis=1).astype(np.uint8)).tobytes()


def _parities(shingles: np.ndarray) -> bytes:
    """For each of `BITS` remainders, whether an odd number of shingles has it."""
    return np.packbits(np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """doc_id, n_shingles, set_id, and for sets that are not empty places (by tree), sketch and parities."""
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_shingles long, set_id binary, places array<binary>, sketch binary, parities binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(1)]
            for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
                sets = shingle_sets(texts[a:b], width)
                signatures = [signature(s) if len(s) else None for s in sets]
                each = lambda make: [None if m is None else make(s, m) for s, m in zip(sets, signatures, strict=True)]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(each(lambda s, m: hashlib.blake2b(s.tobytes(), digest_size=16).digest()), pa.binary()),
                        pa.array(each(lambda s, m: _places(m)), pa.list_(pa.binary())),
                        pa.array(each(lambda s, m: _sketch(m)), pa.binary()), pa.array(each(lambda s, m: _parities(s)), pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "places", "sketch", "parities"],
                )

    return docs.select(id_col, text_col).mapInArrow(sign, schema)


def _words64(column: pa.Array, n: int) -> np.ndarray:
    """n rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(n, -1)


def _alike(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches (as 64-bit words, even bits and odd bits of a minimum)."""
    differ = some ^ others
    differ = (differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)
    same = 1 - np.bitwise_count(differ).sum(axis=-1) / SKETCHED
    return (same - 0.25) / 0.75


def _sizes_agree(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(a, b) * 100 >= percent * np.maximum(a, b)


def region_candidates(sizes: np.ndarray, sketches: np.ndarray, near: bool, percent: int = 80, small: int = SMALL) -> np.ndarray:
    """Candidate pairs, as places in the order, of one region; near: its tree takes part where the region is large."""
    n = len(sizes)
    if n <= small:
        a, b = np.triu_indices(n, 1)
    else:
        a = np.arange(n - 1 if near else 0)
        b = a + 1
    ok = _sizes_agree(sizes[a], sizes[b], percent)
    a, b = a[ok], b[ok]
    ok = _alike(sketches[a], sketches[b]) >= MAYBE
    return np.column_stack((a[ok], b[ok]))


def _in_order(region: int, percent: int, small: int):
    """Streams rows (place, doc_id, n_shingles, sketch), sorted: candidates of each region."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[bytes] = []
        rows, sketches = np.zeros((0, 2), np.int64), np.zeros((0, 4), np.uint64)
        out: list[np.ndarray] = []

        def deal(a: int, b: int) -> None:
            if b - a > 1:
                pairs = rows[a:b, 0][region_candidates(rows[a:b, 1], sketches[a:b], places[a][0] < NEAR_TREES, percent, small)]
                out.append(np.sort(pairs, axis=1))

        def ready() -> Iterator[pa.RecordBatch]:
            flat = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            out.clear()
            flat = flat[flat[:, 0] != flat[:, 1]]
            if len(flat):
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            places = places + batch.column(0).to_pylist()
            rows = np.concatenate((rows, np.column_stack([batch.column(c).to_numpy() for c in (1, 2)])))
            sketches = np.concatenate((sketches, _words64(batch.column(3), batch.num_rows)))
            start = 0
            for i in range(1, len(places)):
                if places[i][:PREFIX] != places[start][:PREFIX]:
                    deal(start, i)
                    start = i
            if len(places) - start > 2 * region:  # what no task boundary parted: the last row is held for its neighbour
                deal(start, len(places))
                start = len(places) - 1
            places, rows, sketches = places[start:], rows[start:], sketches[start:]
            yield from ready()
        deal(0, len(places))
        yield from ready()

    return find


def _region_of(place):
    return F.xxhash64(F.substring(place, 1, PREFIX))


def large_regions(signs: DataFrame, least: int) -> DataFrame:
    """key, members of each region with more than `least` documents."""
    keys = signs.select(F.explode("places").alias("place")).select(_region_of(F.col("place")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > least)


def candidates(signs: DataFrame, large: DataFrame, region: int = REGION, percent: int = 80, small: int = SMALL) -> DataFrame:
    """Distinct candidate pairs a < b of the first step, for the representatives in `signs`."""
    rows = signs.select(F.explode("places").alias("place"), "doc_id", "n_shingles", "sketch")
    key, task = _region_of(F.col("place")), F.col("_task")
    hot = large.filter(F.col("members") > region)
    if hot.isEmpty():
        dealt = rows.withColumn("_task", key)
    else:
        parts = F.coalesce(F.ceil(F.col("members") / region), F.lit(1))
        joined = rows.withColumn("key", key).join(hot, "key", "left").withColumn("parts", parts)
        deep = joined.filter("parts > 1").groupBy("key", "place").agg(F.count("*").alias("same"))
        joined = joined.join(deep.filter(F.col("same") > region), ["key", "place"], "left")
        own = F.when(F.col("same").isNotNull(), F.pmod(F.xxhash64("doc_id", "key"), "parts")).otherwise(F.pmod(F.xxhash64("place"), "parts"))
        dealt = joined.select("place", "doc_id", "n_shingles", "sketch", F.when(F.col("parts") > 1, F.xxhash64("key", own)).otherwise(F.col("key")).alias("_task"))
    ordered = dealt.repartition(task).sortWithinPartitions("place", "doc_id").select("place", "doc_id", "n_shingles", "sketch")
    return ordered.mapInArrow(_in_order(region, percent, small), "a long, b long").distinct()


def _between(few: int, percent: int):
    def pairs(key: tuple, block: pa.Table) -> pa.Table:
        """Pairs of one block: a row that is not of the main component, and one of another component than its own."""
        block = block.sort_by([("doc_id", "ascending")])
        ids, sizes, component, main, side = (block[c].to_numpy() for c in ("doc_id", "n_shingles", "component", "main", "side"))
        sketches, parities = _words64(block["sketch"], len(ids)), _words64(block["parities"], len(ids))
        every, a, b = np.flatnonzero(side == 1), [], []
        for y in np.flatnonzero(side == 0):
            other = every[(component[every] != component[y]) & ((component[every] == main[y]) | (ids[every] > ids[y]))]
            other = other[_sizes_agree(sizes[other], sizes[y], percent)]
            differ = np.bitwise_count(parities[other] ^ parities[y]).sum(axis=1).astype(np.int64)
            other = other[(100 + percent) * differ <= (100 - percent) * (sizes[other] + sizes[y])]
            alike = _alike(sketches[other], sketches[y])
            other, alike = other[alike >= MAYBE], alike[alike >= MAYBE]
            if few and len(other) > few:
                other = other[np.argsort(-alike, kind="stable")[:few]]
            a.append(np.minimum(ids[other], ids[y]))
            b.append(np.maximum(ids[other], ids[y]))
        return pa.table({"a": np.concatenate([*a, ids[:0]]), "b": np.concatenate([*b, ids[:0]])})

    return pairs


def left_candidates(signs: DataFrame, large: DataFrame, found: DataFrame, few: int, side: int = SIDE, percent: int = 80) -> DataFrame:
    """Distinct pairs a < b that may be alike, share a region of `large` and are in different components of `found`
    (node, component): all of them, or (few > 0) some that are the most alike for each document and block."""
    keys = signs.select("doc_id", F.explode("places").alias("place")).select("doc_id", _region_of(F.col("place")).alias("key")).join(large, "key")
    rows = keys.join(found, keys["doc_id"] == found["node"], "left").select("key", "doc_id", "members", F.coalesce("component", "doc_id").alias("component"))
    rows = written(rows, "forest-large-rows")
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    regions = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0")
    rows = rows.join(written(regions, "forest-unjoined"), "key").join(signs.select("doc_id", "n_shingles", "sketch", "parities"), "doc_id")
    across, down = F.ceil(F.col("outside") / side).cast("int"), F.ceil(F.col("members") / side).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    columns = ["key", "doc_id", "n_shingles", "sketch", "parities", "component", "main"]
    outside = rows.filter("component <> main").select(*columns, F.lit(0).alias("side"), own(across).alias("i"), each(down).alias("j"))
    every = rows.select(*columns, F.lit(1).alias("side"), each(across).alias("i"), own(down).alias("j"))
    return outside.unionByName(every).groupBy("key", "i", "j").applyInArrow(_between(few, percent), "a long, b long").distinct()


def links(docs: DataFrame, pairs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, few: bool = False) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union; few: Spark may broadcast the ids wanted, if they are small."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(1)]
            for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
                sets = shingle_sets(texts[a:b], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "words"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("want")).distinct()
    if not few:
        wanted = wanted.hint("merge")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col)).join(wanted, F.col("id") == F.col("want"), "left_semi")
    sets = texts.mapInArrow(build, "id long, words binary")
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("words").alias("words_b")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("words").alias("words_a")), "a")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(confirm, "a long, b long").distinct()


def _forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, as one edge from each of their ends to the smallest that it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ends = [x for x in parent if root(x) != x]
    for at in range(0, len(ends), 10_000):
        some = ends[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in some], pa.int64()), pa.array(some, pa.int64())], names=["a", "b"])


def components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """node, component (the smallest node reachable) of every end of `edges` (a, b).

    Tasks of up to `TASK_EDGES` edges first reduce their own to a forest. Then nodes take the smallest label heard, and that label's own;
    a label that many nodes share is dealt over `salts` tasks, and only labels that have moved are joined.
    """
    edges = edges.coalesce(1 + edges.count() // TASK_EDGES).mapInArrow(_forest_of, "a long, b long")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "forest-edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "forest-labels")
    salt = F.pmod(F.xxhash64("node"), F.lit(salts))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        near = heard.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")).withColumn("salt", salt)
        jump = labels.filter("label < node").select(F.col("node").alias("label"), F.col("label").alias("further"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        nearer = near.join(jump, ["label", "salt"], "left").select("node", F.coalesce("further", "label").alias("label"))
        new = written(nearer, "forest-labels")
        moved = new.join(labels.select("node", F.col("label").alias("old")), "node").filter("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels.select("node", F.col("label").alias("component"))


def nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, node, text and row (the other columns) of each row, and doc_id by node of the nodes that are no ids (None: there are none).

    A node is the id, but for the second and later texts of an id: these get a number from id and text.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), others)
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("_hash").alias("_least"), F.max("_hash").alias("_most")).filter("_least <> _most")
    several = written(several.select(F.col("doc_id").alias("_id"), "_least"), "forest-repeated-ids")
    if several.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("node"), "text", "row"), None
    found = rows.join(several, rows["doc_id"] == several["_id"], "left")
    found = found.select("doc_id", F.when(F.col("_hash") != F.col("_least"), F.xxhash64("doc_id", "_hash")).otherwise(F.col("doc_id")).alias("node"), "text", "row")
    return found, found.filter("node <> doc_id").select(F.col("node").alias("_node"), F.col("doc_id").alias("_named")).distinct()


def judged(docs: DataFrame, percent: int = 80, region: int = REGION, width: int = 2, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """doc_id, node, n_shingles, component_id, kept of each row, and what nodes() gives."""
    whole_numbers(docs, "doc_id")
    docs, named = nodes(docs)
    signs = written(signed(docs, "node", width=width), "forest-signs")
    classes = with_class_min(signs.select("doc_id", "n_shingles", "set_id"), "set_id", "doc_id", "first")
    classes = written(classes.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("first")), "forest-classes")
    firsts = classes.filter("doc_id = first and n_shingles > 0").select(F.col("doc_id").alias("one")).distinct()
    alone = signs.join(firsts, signs["doc_id"] == firsts["one"], "left_semi").dropDuplicates(["doc_id"])
    large = written(large_regions(alone, min(small, region)), "forest-large")
    pairs = written(candidates(alone, large, region, percent, small), "forest-pairs")
    linked = written(links(docs, pairs, percent, "node", width=width), "forest-links")
    found = components(linked)
    if not large.isEmpty():
        for few in (FEW, 0):
            more = written(left_candidates(alone, large, found, few, min(SIDE, region), percent), "forest-left-pairs")
            if more.isEmpty():
                break
            linked = linked.unionByName(written(links(docs, more, percent, "node", width=width, few=True), "forest-left-links"))
            found = components(linked)
    out = classes.join(found, classes["first"] == found["node"], "left").select(F.col("doc_id").alias("node"), "n_shingles", F.coalesce("component", "first").alias("component"))
    if named is None:
        out = out.select(F.col("node").alias("doc_id"), "node", "n_shingles", F.col("component").alias("component_id"))
    else:
        out = out.join(named, out["node"] == named["_node"], "left").select(F.coalesce("_named", "node").alias("doc_id"), "node", "n_shingles", "component")
        out = with_class_min(written(out, "forest-named"), "component", "doc_id", "component_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("doc_id", "node", "n_shingles", "component_id", kept), docs


def near_duplicates(docs: DataFrame, percent: int = 80, region: int = REGION, width: int = 2, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    return judged(docs, percent, region, width, small)[0].select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, percent: int = 80, width: int = 2) -> DataFrame:
    """The rows of `docs` that stay when one document of each component does; rows without an id stay."""
    found, rows = judged(docs, percent, width=width)
    gone = found.filter("not kept").select(F.col("node").alias("_gone")).distinct()
    left = rows.join(gone, rows["node"] == gone["_gone"], "left_anti")
    return left.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
