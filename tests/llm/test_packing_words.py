"""Texts encoded by their distinct words against texts encoded whole; the knapsack step against all multisets."""

import itertools
import random
from array import array

import numpy as np
import pyarrow as pa
import pytest

from auditweave.llm import packing, queries

ODD = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "a\n b c", "x <|endoftext|> y", "<|endoftext|>", "it's I'll  'd 's", "e　 q r", "q 　", "\x1f a b", "a \x85b c", "​ c d", "ｅ́ 9½  ", "one", "\nSich. Nicht", "w" * 300 + " z"]


@pytest.fixture(scope="module")
def tokens():
    return queries.byte_bpe()()


def test_words_give_the_ids_of_whole_texts_in_one_call(tokens, monkeypatch):
    rng = random.Random(4)
    letters = list("ab'sé9½.,|\n\t  　\x1f😀 ") + [" "] * 8
    texts = [*ODD, None, *("".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)), *(" ".join(f"w{rng.randint(0, 3000)}x" for _ in range(20)) for _ in range(300))]
    want = [array("I", list(itertools.chain(*([packing.SPECIAL_ID] * (k > 0) + tokens.encode(x) for k, x in enumerate((t or "").split(packing.SPECIAL)))))).tobytes() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert list(tokens.of_texts(pa.array(["cut off", *texts], kind).slice(1))) == want
    calls, encode = [], tokens.encode
    monkeypatch.setattr(tokens, "encode", lambda x: calls.append(x) or encode(x))
    assert list(tokens.of_texts(pa.array(texts[-300:]))) == want[-300:]
    assert len(calls) <= 301  # all words at once, and the first of each text
    assert list(tokens.of_texts(pa.array([], pa.string()))) == []


def test_runs_of_bounded_bytes_keep_every_row():
    batch = pa.record_batch([pa.array(range(7)), pa.array(["a" * 5, None, "", "b" * 50, "c", "d" * 9, "e" * 9])], names=["id", "text"])
    runs = [r.column(0).to_pylist() for r in packing.by_bytes(iter([batch, batch.slice(0, 0)]), 1, 10)]
    assert runs == [[0, 1, 2], [3], [4, 5], [6]]


@pytest.mark.parametrize("seed", range(20))
def test_the_best_configuration_is_that_of_all_multisets(seed):
    rng = np.random.default_rng(seed)
    sizes, capacity = rng.choice(np.arange(5, 33), rng.integers(1, 6), replace=False), 32
    price = rng.random(len(sizes)) * sizes / capacity
    value, column = packing._best_configuration(sizes, price, capacity)
    every = itertools.product(*(range(capacity // s + 1) for s in sizes))
    assert value == pytest.approx(max(np.dot(c, price) for c in every if np.dot(c, sizes) <= capacity))
    assert value == pytest.approx(column @ price) and column @ sizes <= capacity
