"""Threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Bytes of a table of occurrences, at most about.
TABLE_BYTES = 16 << 20


class Occurrences:
    """How often each symbol stands before a place, from a table for every `step`-th place and a count of what follows it."""

    def __init__(self, transform: np.ndarray, symbols: int) -> None:
        n = len(transform)
        self.step = 1 + n * symbols * 4 // TABLE_BYTES
        self.transform = np.concatenate((transform, np.zeros(self.step, transform.dtype)))
        self.table = np.zeros((n // self.step + 1, symbols), np.int32)
        place = np.arange(n) // self.step + 1
        inside = place < len(self.table)
        np.add.at(self.table, (place[inside], transform[inside]), 1)
        np.cumsum(self.table, axis=0, out=self.table)

    def before(self, places: np.ndarray) -> np.ndarray:
        """places x symbols."""
        rows, rest = np.divmod(places, self.step)
        out = self.table[rows]
        first = rows * self.step
        for j in range(self.step - 1):
            at = np.flatnonzero(rest > j)
            out[at, self.transform[first[at] + j]] += 1
        return out


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` codes or more, by prefix doubling from 8 packed codes (below 256)."""
    n = len(codes)
    padded = np.concatenate((codes.astype(np.uint8), np.zeros(8, np.uint8)))
    key = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    reach = 8
    while True:
        _, rank = np.unique(key, return_inverse=True)
        if reach >= depth or rank.max() == n - 1:
            return np.argsort(rank, kind="stable")
        after = np.zeros(n, np.uint64)
        after[:-reach] = rank[reach:] + 1 if reach < n else after[:-reach]
        key = (rank.astype(np.uint64) << np.uint64(32)) | after
        reach *= 2


def common_prefix_cuts(codes: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """cut[i]: the suffixes at places i - 1 and i of `order` have fewer than `least` codes in common.

    Code 0 ends a string. Starting from the interval of all suffixes, each round extends every interval of
    strings of length l by one code to the left, all at once, over a table of occurrences in the transform; a right
    end that is new is a common prefix of exactly l. Intervals whose end is known are not followed. Rounds stop at `least`.
    """
    n = len(codes)
    used, dense = np.unique(codes, return_inverse=True)
    transform = dense[order - 1]
    table = Occurrences(transform, len(used))
    base = np.concatenate(([0], np.cumsum(np.bincount(dense, minlength=len(used)))[:-1])).astype(np.int32)
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    low, high = np.array([0]), np.array([n])
    for length in range(least):
        next_low, next_high = [], []
        for at in range(0, len(low), 8192):
            a, b = table.before(low[at : at + 8192]), table.before(high[at : at + 8192])
            some = b > a
            if length and used[0] == 0:
                some[:, 0] = False
            i, c = np.nonzero(some)
            ends = base[c] + b[i, c]
            new = ~cut[ends] | (length == 0)
            cut[ends] = True
            next_low.append((base[c] + a[i, c])[new])
            next_high.append(ends[new])
        low, high = np.concatenate(next_low), np.concatenate(next_high)
        if not len(low):
            break
    return cut[:n]


def smaller_owner(strings: list[bytes], owners: np.ndarray, least: int) -> list[np.ndarray]:
    """For each string: which of its windows of `least` bytes also are in a string of a smaller owner."""
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    is_end = np.zeros(len(text), bool)
    is_end[starts + sizes] = True
    used = np.unique(text[~is_end])
    code = np.zeros(256, np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    codes = np.where(is_end, 0, code[text])
    if len(used) > 255:
        raise ValueError("a text of all 256 byte values has no free code")
    order = suffix_order(codes, least)
    group = np.cumsum(common_prefix_cuts(codes, order, least)) - 1
    which = np.repeat(np.arange(len(strings)), sizes + 1)
    whole = np.arange(len(text)) + least <= (starts + sizes)[which]
    owner = np.where(whole, owners[which], np.iinfo(np.int64).max)
    in_order = owner[order]
    first = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, in_order)
    found = np.zeros(len(text), bool)
    found[order] = whole[order] & (first[group] < in_order)
    return [found[a : a + max(0, size - least + 1)] for a, size in zip(starts, sizes, strict=True)]
