"""Exact nearest rows by cells: a search reads only the blocks that may hold one of its `k` best.

The index puts each row into the cell of the centre at the smallest angle, and within the cell into a ring by that angle. By the
triangle inequality a query at angle t of a centre is at an angle of max(0, t - hi, lo - t) or more of all rows of a ring from lo
to hi. A search first reads the rings of the best bounds until they hold some multiple of `k` rows; the k-th score found is a
floor, and a second step reads every other ring whose bound reaches it. No more steps are needed, and none is left to chance:
centres decide what is read, never what is found. Centres and rings are bounded in number and travel with the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions.columns import norm
from ..sources.tables import stage_table

#: Centres are fitted on `SAMPLE_VALUES` numbers at most; every row is indexed.
SAMPLE_VALUES, MOST_CELLS, RINGS = 2_000_000, 1024, 4
#: Rows of a block, and queries that meet it at once, on average: rows and queries are dealt by hashes of their ids.
BLOCK, QUERIES, SLICE = 8192, 4096, 128
#: Slack of angles and scores against rounding: it only adds candidates.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """rows: id, vector, tag, _n (what its products are divided by), cell, ring, part and the columns kept. rings: cell, ring, lo, hi, light, heavy, n."""

    rows: DataFrame
    centres: np.ndarray
    rings: pd.DataFrame
    kept: list[str]
    dim: int


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.arccos(np.clip(vectors @ centres.T / np.where(length > 0, length, 1.0), -1.0, 1.0))


def _centres(rows: DataFrame, cells: int, dim: int, seed: int = 7) -> np.ndarray:
    chosen = rows.filter("_length > 0").orderBy(F.xxhash64("id"), "id").limit(max(cells, SAMPLE_VALUES // dim))
    points = chosen.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    found = np.stack(KMeans(k=cells, distanceMeasure="cosine", initMode="random", maxIter=8, seed=seed).fit(points).clusterCenters())
    length = np.linalg.norm(found, axis=1, keepdims=True)
    usable = length[:, 0] > SLACK  # points that cancel out leave a centre without a direction
    return found[usable] / length[usable] if usable.any() else np.eye(1, dim)


def build(rows: DataFrame, dim: int, keep: list[str] | None = None, inner: bool = False, tag: str | None = None, ring_rows: int = 2048) -> Index:
    """The index of rows (id, vector and the columns to keep), by cosine, or by the inner product with the query's direction.

    `ring_rows` is the mean size of a ring, which sets the number of cells, up to MOST_CELLS. Vectors that are null, of another
    length or hold null or non-finite numbers take no part, nor do zero vectors where the cosine is asked. ids are keys.
    """
    kept = keep or []
    plain = rows.select("id", "vector", (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag"), *kept, norm(F.col("vector")).alias("_length"))
    whole = (F.size("vector") == dim) & (F.col("_length") < float("inf"))
    base = stage_table(plain.filter(whole if inner else whole & (F.col("_length") > 0)))
    usable = base.filter("_length > 0").count()
    cells = min(MOST_CELLS, max(1, usable // (RINGS * ring_rows)))
    centres = _centres(base, cells, dim) if cells > 1 else np.ones((1, dim)) / math.sqrt(dim)

    @pandas_udf("cell int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if vectors.empty:
            return pd.DataFrame({"cell": np.zeros(0, np.int32), "angle": np.zeros(0)})
        angles = _angles(_stacked(vectors), centres)
        cell = angles.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": angles[np.arange(len(cell)), cell]})

    placed = stage_table(base.withColumn("_n", F.lit(1.0) if inner else F.col("_length")).withColumn("_p", nearest("vector")).select("*", "_p.cell", "_p.angle").drop("_p"))
    edges = stage_table(placed.groupBy("cell").agg(F.percentile_approx("angle", [i / RINGS for i in range(1, RINGS)], 1000).alias("edges")))  # staged, as they depend on the order in which parts meet
    ringed = placed.join(F.broadcast(edges), "cell").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("angle"))))  # MOST_CELLS rows at most
    weight = F.col("_length") / F.col("_n")
    sizes = ringed.groupBy("cell", "ring").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.min(weight).alias("light"), F.max(weight).alias("heavy"), F.count("*").alias("n"))
    rings = sizes.orderBy("cell", "ring").toPandas()  # MOST_CELLS * RINGS rows at most
    parts = sizes.select("cell", "ring", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    dealt = ringed.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return Index(dealt.select("id", "vector", "tag", *kept, "_n", "cell", "ring", "part", "parts"), centres, rings, kept, dim)


def _bounds(index: Index, vectors: np.ndarray) -> np.ndarray:
    """The largest score that a row of each ring may have, for each query."""
    at = _angles(vectors, index.centres)[:, index.rings["cell"].to_numpy(int)]
    apart = np.maximum(np.maximum(at - index.rings["hi"].to_numpy(), index.rings["lo"].to_numpy() - at) - SLACK, 0.0)
    top = np.cos(np.minimum(apart, np.pi))
    heavy = index.rings["heavy"].to_numpy()
    return np.maximum(top * heavy, top * index.rings["light"].to_numpy()) + SLACK * np.maximum(heavy, 1.0)


def _probes(index: Index, asked: DataFrame, first: int, rest: bool) -> DataFrame:
    """Each query with the rings it reads: those of the best bounds that hold `first` rows, or (`rest`) the others whose bound reaches `least`."""
    size, cell, ring = (index.rings[c].to_numpy(np.int64) for c in ("n", "cell", "ring"))
    light = Index(None, index.centres, index.rings, [], index.dim)  # what the tasks need

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch) if len(size) else 0, SLICE):
                some = batch.iloc[start : start + SLICE]
                bounds = _bounds(light, _stacked(some["query_vector"]))
                order = np.argsort(-bounds, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                reads = np.empty(bounds.shape, bool)
                np.put_along_axis(reads, order, before < first, axis=1)
                if rest:
                    reads = ~reads & (bounds >= some["least"].to_numpy(float)[:, None])
                i, j = np.nonzero(reads)
                yield some.iloc[i].assign(cell=cell[j].astype(np.int32), ring=ring[j].astype(np.int32), n=size[j])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInPandas(probe, f"{schema}, cell int, ring int, n long")


def _scored(index: Index, probes: DataFrame, rows: DataFrame, k: int, digits: int | None) -> DataFrame:
    """The `k` best rows of each query in each block that it reads. Products are taken as matrices; what may be among the best is summed in order."""
    block = ["cell", "ring", "part", "chunk"]
    parts = rows.select("cell", "ring", "part").distinct()
    left = probes.drop("n").join(parts, ["cell", "ring"])
    right = rows.join(probes.select("cell", "ring", "chunk").distinct(), ["cell", "ring"]).drop("parts")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, as both come from `rows` and `probes`
    taken = ["id", *index.kept]
    out, slack = ["query_id", *taken, "score"], SLACK + (10.0**-digits if digits else 0.0)

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(r):
            r = r.sort_values("id", kind="stable").reset_index(drop=True)
            vectors, lengths = _stacked(r["vector"]), r["_n"].to_numpy()
            spare = slack * max(1.0, (np.linalg.norm(vectors, axis=1) / lengths).max())
            codes, tags = pd.factorize(r["tag"], use_na_sentinel=False)
            for start in range(0, len(q), SLICE):
                some = q.iloc[start : start + SLICE].reset_index(drop=True)
                asked, own = _stacked(some["query_vector"]), some["_q"].to_numpy()
                score = asked @ vectors.T / (own[:, None] * lengths)
                fits = np.array([[wanted is None or t in wanted for t in tags] for wanted in map(lambda w: None if w is None else set(w), some["tags"])])[:, codes]
                score[~fits] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] - spare if len(r) > k else np.full(len(some), -np.inf)
                least = np.maximum(least, some["least"].to_numpy(float) - spare)  # what the first step found already
                i, j = np.nonzero(fits & (score >= least[:, None]))
                total = np.zeros(len(i))
                for d in range(vectors.shape[1]):
                    total += asked[i, d] * vectors[j, d]
                exact = total / (own[i] * lengths[j])
                order = np.lexsort((j, -(np.round(exact, digits) if digits else exact), i))
                i, j, exact = i[order], j[order], exact[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append(r.loc[j[top], taken].assign(query_id=some["query_id"].to_numpy()[i[top]], score=exact[top])[out])
        return pd.concat(found) if found else pd.DataFrame(columns=out)

    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *probes.schema]} | {"score": "double"}
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(meet, ", ".join(f"{c} {kinds[c]}" for c in out))


def search(index: Index, queries: DataFrame, k: int, where: str | None = None, floor: float | None = None, digits: int | None = None, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The `k` best rows of each query (query_id, id, the columns kept, score, place), ties to the smaller id, and how many rows each query was
    compared with (query_id, n_compared, n_rows).

    queries: query_id, query_vector and, if need be, tags: only rows with one of these tags count (null: all). `where` is a condition on the
    columns kept, `floor` a score below which no row counts, `digits` the places to which scores are rounded before they are ranked.
    Queries whose vector is null, of another length, zero or not finite find nothing.
    """
    tags = F.col("tags") if "tags" in queries.columns else F.lit(None).cast("array<string>")
    vectors = queries.select("query_id", "query_vector", tags.alias("tags"), norm(F.col("query_vector")).alias("_q"))
    vectors = vectors.filter((F.size("query_vector") == index.dim) & (F.col("_q") > 0) & (F.col("_q") < float("inf")))
    chunks = max(1, -(-vectors.count() // QUERIES))
    asked = vectors.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).withColumn("least", F.lit(-math.inf if floor is None else floor))
    rows = index.rows.filter(where) if where else index.rows
    begun = _probes(index, asked, first or 4 * k, False)
    near = stage_table(_scored(index, begun, rows, k, digits))
    rank = F.round("score", digits) if digits else F.col("score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(rank.desc(), "id"))
    kth = near.withColumn("place", place).filter(F.col("place") == k).select("query_id", rank.alias("kth"))
    slack = SLACK + (10.0**-digits if digits else 0.0)
    left = asked.join(kth, "query_id", "left").withColumn("least", F.greatest("least", F.col("kth") - slack)).drop("kth")
    ended = _probes(index, left, first or 4 * k, True)
    both = near.unionByName(_scored(index, ended, rows, k, digits))
    found = (both if floor is None else both.filter(rank >= floor)).withColumn("place", place).filter(F.col("place") <= k)
    read = begun.unionByName(ended).groupBy("query_id").agg(F.sum("n").alias("n_compared"))
    return found, vectors.select("query_id").join(read, "query_id", "left").select("query_id", F.coalesce("n_compared", F.lit(0)).alias("n_compared"), F.lit(int(index.rings["n"].sum())).cast("long").alias("n_rows"))
