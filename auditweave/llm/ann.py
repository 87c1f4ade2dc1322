"""Approximate nearest neighbours by cosine, over randomly rotated one-bit codes.

Every unit vector, padded with zeros to `CODE_BITS` components, is rotated by one random orthogonal matrix and kept
as the signs of its components, packed in bits, with one correction scalar: its inner product f with its own code's
unit vector. For a query the inner product a with that code comes from a table for each byte of the packed bits.
For a random rotation a / f estimates the cosine without bias, and

    |cosine - a / f| <= eps * sqrt(1 - f^2) / (f * sqrt(bits - 1))

but for a chance that falls as exp(-eps^2 / 2). The best estimates are reranked by the exact cosine in double
precision; then, so is every other row whose upper bound reaches the k-th best exact cosine found.

Vectors are scaled by a power of two first, so that no square is too large or too small for a double and no digit changes.
Vectors that are null, empty, zero or hold a null or non-finite component take no part; ties go to smaller ids;
a query with no candidate has no row; rows that repeat an id count once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vectors import search_in_blocks, usable

EPS, CODE_BITS = 4.0, 256


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """dim x bits: what a random orthogonal matrix does with vectors that are padded with zeros."""
    bits = max(CODE_BITS, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (rows x bytes) and the correction scalar of each row."""
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turn.shape[1])


def byte_tables(turned_query: np.ndarray) -> np.ndarray:
    """For each byte of a code, the share of the inner product that each of its 256 values adds."""
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
    return ((turned_query / np.sqrt(len(turned_query))).reshape(-1, 8) @ signs.T).astype(np.float32)


def _sequential_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row sums in the order of the components, so that equal vectors score equally wherever they stand."""
    return np.cumsum(a * b, axis=1)[:, -1] if len(a) else np.zeros(0)


def scaled(rows: np.ndarray) -> np.ndarray:
    """The rows times powers of two that bring their largest components to between a half and 1."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None]) if len(rows) else rows


def _within(k: int, eps: float):
    def find(query_ids, queries, ids, rows):
        queries, rows = scaled(queries), scaled(rows)
        norm = np.sqrt(_sequential_dot(rows, rows))
        turn = rotation(rows.shape[1])
        codes, f = encode(rows / norm[:, None], turn)
        codes = np.ascontiguousarray(codes.T)
        slack = (eps * np.sqrt(np.maximum(0, 1 - f * f)) / (f * np.sqrt(turn.shape[1] - 1)) + 1e-6).astype(np.float32)
        inverse = (1 / f).astype(np.float32)
        q_norm = np.sqrt(_sequential_dot(queries, queries))
        turned = (queries / q_norm[:, None]) @ turn
        cosine = lambda at, query, length: _sequential_dot(rows[at], query[None, :]) / (norm[at] * length)
        out = [], [], []
        for qid, query, length, t in zip(query_ids, queries, q_norm, turned, strict=True):
            tables = byte_tables(t)
            a = np.take(tables[0], codes[0])
            for j in range(1, len(codes)):
                a += np.take(tables[j], codes[j])
            estimate = a * inverse
            own = np.searchsorted(ids, qid)
            if own < len(ids) and ids[own] == qid:
                estimate[own] = -np.inf
            upper = estimate + slack
            chosen = np.argpartition(-estimate, min(4 * k, len(ids) - 1))[: 4 * k + 1]
            chosen = chosen[estimate[chosen] > -np.inf]
            exact = cosine(chosen, query, length)
            if len(chosen) > k:
                upper[chosen] = -np.inf
                more = np.flatnonzero(upper >= np.partition(exact, len(exact) - k)[len(exact) - k])
                chosen, exact = np.concatenate((chosen, more)), np.concatenate((exact, cosine(more, query, length)))
            if not len(chosen):
                continue
            best = np.lexsort((ids[chosen], -exact))[:k]
            out[0].append(np.full(len(best), qid))
            out[1].append(ids[chosen[best]])
            out[2].append(exact[best])
        return [np.concatenate(x) if x else [] for x in out]

    return find


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", eps: float = EPS) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): the `k` nearest rows of every row for which `is_query` (over `id`) holds."""
    return search_in_blocks(usable(vectors, id_col, vec_col, allow_zero=False), is_query, k, _within(k, eps), "double")
