"""Word shingle sets of whole texts, as 64-bit hashes, worked out for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers, and the primes and bases of the words' hashes.
K1, K2, K3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_013))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[tuple[int, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * K1
    x = (x ^ (x >> np.uint64(27))) * K2
    return x ^ (x >> np.uint64(31))


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^i modulo the prime, for i < n (a longer table from before serves too)."""
    table = _powers.get((base, prime), np.ones(1, np.uint64))
    while len(table) < n:
        table = np.concatenate((table, table * np.uint64(pow(base, len(table), prime)) % np.uint64(prime)))
    _powers[base, prime] = table
    return table[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62 bits of each word of the bytes: its polynomials over two prime fields, and its length, mixed."""
    out = (ends - starts).astype(np.uint64) * K3
    letters = data.astype(np.uint64) + np.uint64(1)
    for prime, base in FIELDS:
        p = np.uint64(prime)
        terms = letters * powers(base, prime, len(data))
        if len(data) >= 1 << 24:  # below, sums of the terms stay under 2^64
            terms %= p
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        shift = powers(pow(base, -1, prime), prime, len(data) + 1)[starts]
        out = mix(out ^ ((sums[ends] - sums[starts]) % p * shift % p))
    return out


def blocks(values, most: int) -> Iterator[tuple[int, int]]:
    """Runs of positions whose sizes sum to about `most`."""
    start, total = 0, 0
    for i, size in enumerate(values):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(values):
        yield start, len(values)


def shingle_sets(texts: list[bytes], width: int = 2) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of `width` words; a text of fewer words is one run.

    Words are what ASCII white space parts, with A-Z lower-cased; a text without words has the empty set.
    """
    texts = [t.lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = _BLANK[data]
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = turns[0::2], turns[1::2]
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in texts]))
    out = []
    runs = words
    for _ in range(width - 1):
        runs = mix(runs[:-1] * K3 + words[len(words) - len(runs) + 1 :]) if len(runs) else runs
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            whole = words[a : a + 1]
            for at in range(a + 1, b):
                whole = mix(whole * K3 + words[at : at + 1])
            out.append(mix(whole ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
