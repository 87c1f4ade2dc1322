"""Exact top-k by integer inner product, with MaxScore over shards.

A vector's components are the weights of its terms (the dimensions). In a shard each term keeps its postings,
as a dense column where more than an eighth of the shard has the term, else as places and weights, and its
largest and smallest weight, which bound what the term can add for a query. Terms are ordered by that bound;
the largest set of small terms whose bounds together stay below the k-th best score so far is non-essential.
The essential terms' postings are traversed, the others are probed only for rows that are still competitive,
by falling bound. The shards' best rows are merged by a window.

Components are floor(scale * x), whole numbers of any size. Sums are exact: doubles where no sum of a block can reach
2^53, else 64-bit integers, else Python's. Where scores of the table could pass a long, ranks are still those of the true
scores, and a score outside its range is given as the nearest long. Vectors that are null, empty or hold a null or
non-finite component take no part; ties go to smaller ids; rows that repeat an id count once; an empty table gives no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import search_in_blocks, usable

STEP = 8


def largest(weights: np.ndarray) -> int:
    return int(np.abs(weights).max()) if weights.size else 0


class Shard:
    """Postings of one block, for queries whose weights are `most` at most."""

    def __init__(self, weights: np.ndarray, most: int) -> None:
        self.n, self.dim = weights.shape
        bound = 2 * self.dim * largest(weights) * most
        kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
        self.columns = np.ascontiguousarray(weights.T.astype(kind))
        self.high, self.low = self.columns.max(1), self.columns.min(1)
        filled = (self.columns != 0).sum(1)
        self.sparse = {d: np.flatnonzero(self.columns[d]) for d in np.flatnonzero(filled * 8 <= self.n)}

    def add(self, score: np.ndarray, terms: np.ndarray, query: np.ndarray) -> None:
        dense = [d for d in terms if d not in self.sparse]
        if dense:
            score += query[dense] @ self.columns[dense]
        for d in terms:
            if d in self.sparse:
                at = self.sparse[d]
                score[at] += query[d] * self.columns[d, at]

    def top(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best `k`, but for place `own` (-1: none)."""
        query = query.astype(self.columns.dtype)
        bound = np.maximum(query * self.high, query * self.low)
        terms = np.argsort(bound, kind="stable")
        # some good rows, for a first threshold: those with the largest shares of the strongest terms
        strong = terms[-4:]
        share = query[strong] @ self.columns[strong]
        some = np.argpartition(-share, min(4 * k, self.n - 1))[: 4 * k + 1]
        some = some[some != own]
        least = -np.inf
        if len(some) >= k:
            full = query @ self.columns[:, some]
            least = np.partition(full, len(full) - k)[len(full) - k]
        rising = np.cumsum(np.maximum(bound[terms], 0))
        split = int(np.searchsorted(rising, least, side="left")) if least > 0 else 0
        others, essential = terms[:split], terms[split:]
        rest = bound[others].sum()
        score = np.zeros(self.n, self.columns.dtype)
        self.add(score, essential, query)
        at = np.flatnonzero(score + rest >= least)
        at = at[at != own]
        score = score[at]
        for stop in range(split, 0, -STEP):  # the largest bounds first
            probe = others[max(0, stop - STEP) : stop]
            score = score + query[probe] @ self.columns[np.ix_(probe, at)]
            rest = bound[others[: max(0, stop - STEP)]].sum()
            if len(score) > k:
                least = max(least, np.partition(score, len(score) - k)[len(score) - k] + self._floor(query, others[: max(0, stop - STEP)]))
            keep = score + rest >= least
            at, score = at[keep], score[keep]
        best = sorted(range(len(at)), key=lambda i: (-score[i], ids[at[i]]))[:k] if score.dtype == object else np.lexsort((ids[at], -score))[:k]
        return at[best], score[best]

    def _floor(self, query: np.ndarray, terms: np.ndarray):
        """The least that `terms` can add."""
        return np.minimum(query[terms] * self.high[terms], query[terms] * self.low[terms]).sum()


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as 64-bit integers or, where these would not do, as Python's."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 1 << 62:
        return y.astype(np.int64)
    exact = lambda v, w: int(w) if np.isfinite(w) else math.floor(Fraction(v) * Fraction(scale))
    return np.array([[exact(v, w) for v, w in zip(a, b, strict=True)] for a, b in zip(x.tolist(), y.tolist(), strict=True)], object)


def _within(k: int, scale: float):
    def find(query_ids, queries, ids, rows):
        queries = integers(queries, scale)
        shard, out = Shard(integers(rows, scale), largest(queries)), ([], [], [])
        for qid, query in zip(query_ids, queries, strict=True):
            own = int(np.searchsorted(ids, qid))
            own = own if own < len(ids) and ids[own] == qid else -1
            at, score = shard.top(query, ids, own, k)
            out[0].append(np.full(len(at), qid))
            out[1].append(ids[at])
            out[2].append(score.astype(object if shard.columns.dtype == object else np.int64))
        return [np.concatenate(x) if x else [] for x in out]

    return find


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): the `k` best rows of every row for which `is_query` (over `id`) holds."""
    rows = usable(vectors, id_col, vec_col, allow_zero=True)
    peak, dim = rows.agg(F.max(F.array_max(F.transform("vec", lambda v: F.abs(v.cast("double"))))), F.max("dim")).first()
    wide = peak is not None and dim * (Fraction(peak) * Fraction(scale) + 1) ** 2 >= 1 << 63
    return search_in_blocks(rows, is_query, k, _within(k, scale), "long", wide=wide)
