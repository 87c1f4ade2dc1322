"""The search in shares against all pairs, in several orders and over several batches and chunks."""

import numpy as np
import pytest

from auditweave.operators import blocks

LABELS = 3


def hybrid(q, r, near):
    return near + np.where(r["label"] == q["query_id"] % LABELS, 0.2, 0.0)


ORDERS = {"cosine": lambda q, r, near: near, "hybrid": hybrid, "fixed": lambda q, r, near: -np.fmod(r["id"] * 7919 + q["query_id"], 13).astype(float)}


@pytest.mark.parametrize(("shares", "chunk", "batch"), [(1, 100, 4096), (3, 4, 7), (5, 1, 1)])
def test_best_rows_of_each_order(spark, monkeypatch, shares, chunk, batch):
    monkeypatch.setattr(blocks, "BATCH", batch)
    big = 2**60 + 1  # ids beyond what a float holds
    rng = np.random.default_rng(5)
    data = [(big + i, [float(x) for x in rng.integers(-3, 4, 4)], int(rng.integers(0, LABELS))) for i in range(60)]
    data += [(big + 60, [0.0] * 4, 0), (big + 61, None, 0), (big + 62, [1.0, None, 1.0, 1.0], 0), (big + 63, [1.0, float("nan"), 1.0, 1.0], 1), (big + 64, [1.0] * 3, 1)]
    rows = spark.createDataFrame(data, "id long, vector array<double>, label int")
    queries = rows.filter("id % 5 = 0").selectExpr("id AS query_id", "vector")
    got = {}
    for r in blocks.best_rows(queries, rows, 4, 6, ORDERS, ["label"], own=True, shares=shares, chunk=chunk).collect():
        got.setdefault((r["mode"], r["query_id"]), []).append((r["place"], r["id"], r["label"]))
    fit = [(i, np.array(v), g) for i, v, g in data[:60] if any(v)]
    want = {}
    for q, a, _ in fit:
        for mode, order in ORDERS.items() if q % 5 == 0 else ():
            scored = []
            for i, b, g in fit:
                near = np.array([float(sum(a * b)) / (np.sqrt(sum(a * a)) * np.sqrt(sum(b * b)))])
                if i != q:
                    scored.append((-order({"query_id": np.array([q])}, {"id": np.array([i]), "label": np.array([g])}, near)[0], i, g))
            want[mode, q] = [(n, i, g) for n, (_, i, g) in enumerate(sorted(scored)[:6], 1)]
    assert {key: sorted(x) for key, x in got.items()} == want


def test_a_share_passes_on_no_more_than_k_rows_of_a_query(spark):
    rng = np.random.default_rng(6)
    rows = [{"id": i, "vector": v, "_length": float(np.linalg.norm(v)), "label": 0} for i, v in enumerate(rng.standard_normal((3000, 8)))]
    import pandas as pd

    frame = pd.DataFrame(rows)
    asked = frame.iloc[:20].rename(columns={"id": "query_id"})
    at = blocks._Chunk(asked, ["query_id"], ["label"], ORDERS, 4, True)
    for start in range(0, len(frame), 500):
        at.take(frame.iloc[start : start + 500])
    assert [len(x) for x in at.rows()] == [80] * 3
