"""Pieces that a chunk sends to many buckets."""

import numpy as np
import pyarrow as pa

from auditweave.llm import substrings


class Counted:
    """numpy, with the number of list items that `array` turns into numbers."""

    def __init__(self):
        self.items = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def array(self, values, *more, **named):
        self.items += len(values) if isinstance(values, list) else 0
        return np.array(values, *more, **named)


def sent(texts, buckets):
    shared = np.unique(np.concatenate(list(substrings.minimizers(texts, 50)))) << np.uint64(16)
    docs = pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": [t.decode() for t in texts]})
    notes = pa.table({"kind": pa.array([1], pa.int32()), "id": pa.array([0], pa.int64()), "blob": pa.array([substrings.planes(shared)], pa.binary())})
    return substrings._send_pieces(50, buckets)((pa.scalar(0, pa.int64()),), docs, notes)


def unpacked(table):
    """(bytes, minimizer, owner, row, start, windows) of each place."""
    found = set()
    for meta, body, places in zip(*(table.column(c).to_pylist() for c in ("meta", "body", "places")), strict=True):
        meta, pieces, at = substrings.from_planes(meta, np.int64, 3).tolist(), [], 0
        for value, owner, size in meta:
            pieces.append((body[at : at + size], value, owner))
            at += size
        found |= {(*pieces[k], row, start, n) for k, row, start, n in substrings.from_planes(places, np.int32, 4).tolist()}
    return found


def test_work_of_a_chunk_does_not_grow_with_the_buckets(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 2000, np.uint8)) for _ in range(20)]
    few = sent(texts, 3)
    counted = Counted()
    monkeypatch.setattr(substrings, "np", counted)
    many = sent(texts, 500)
    pieces = len(unpacked(few))
    assert few.num_rows == 3 and many.num_rows > 450 and unpacked(many) == unpacked(few)
    assert pieces > 2000 and counted.items < 12 * pieces  # before, all pieces' owners were turned into numbers for each bucket
