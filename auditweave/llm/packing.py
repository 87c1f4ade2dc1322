"""Best-fit packing of tokenised documents into sequences, by linear grouping.

Each document's ids (byte-level BPE, then an end id) are cut into pieces of at most `capacity`; only the first
piece may be shorter than a full one. Pieces are dealt into buckets of about `bucket_docs` documents, and each
bucket is packed by itself: lengths over an eighth of the capacity are sorted and put in groups of equal
cardinality, each rounded up to its largest; configurations of these few sizes are optimised by column
generation; actual pieces take the configurations' places; what is left and the small pieces go, longest
first, to the open sequence that they fill best.

Null texts count as empty: a piece that holds the end id alone. Repeated rows and rows without an id are packed each. Other columns
than id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Characters at which a word may not begin or end: all that count as blank for the byte-level pattern, and a few more.
BLANKS = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200B}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


class Tokens:
    """Ids of texts as little-endian 32-bit words.

    A blank between two characters that are not blank always begins a new unit of the byte-level pattern, so
    the distinct words of many texts are encoded once, in one go; other texts go to the tokenizer whole.
    """

    def __init__(self, ranks_file: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)

    def ids(self, text: str) -> bytes:
        parts = [array("I", self.encode(x)).tobytes() for x in text.split(SPECIAL)]
        return array("I", [SPECIAL_ID]).tobytes().join(parts)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, each after a blank, and where each word's ids begin and end. The words neither begin nor end with a blank."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), " ")[0].as_py()
        found = np.fromiter(self.encode(" " + joined), np.uint32)
        ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        stop = np.searchsorted(np.cumsum(self.n_bytes[found]), ends) + 1
        return found, np.concatenate(([0], stop[:-1])), stop

    def of_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text. Missing texts count as empty."""
        if not len(texts):
            return
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        number, words = coded.indices.to_numpy(), coded.dictionary
        odd = pc.match_substring_regex(words, f"^$|^{BLANKS}|{BLANKS}$").to_numpy(zero_copy_only=False)
        whole = np.logical_or.reduceat(odd[number], bounds[:-1]) | pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
        found, start, stop = self.of_words(pc.if_else(pa.array(odd), "x", words))
        later = np.ones(len(number), bool)
        later[bounds[:-1]] = False  # a first word has no blank before it
        count = np.where(later, (stop - start)[number], 0)
        place = np.concatenate(([0], np.cumsum(count)))
        rest = found[np.repeat(start[number] - place[:-1], count) + np.arange(place[-1])].tobytes()
        place *= 4
        first = words.take(pa.array(number[bounds[:-1]])).to_pylist()
        for i, (word, odd_one, at, end) in enumerate(zip(first, whole.tolist(), place[bounds[:-1]].tolist(), place[bounds[1:]].tolist(), strict=True)):
            yield self.ids(texts[i].as_py()) if odd_one else array("I", self.encode(word)).tobytes() + rest[at:end]


@functools.lru_cache(maxsize=1)
def _tokens(ranks_file: str, pattern: str) -> Tokens:
    return Tokens(ranks_file, pattern)


def byte_bpe(ranks_file: str, pattern: str) -> Callable[[], Tokens]:
    """A tokenizer that each Python worker makes for itself."""
    return lambda: _tokens(ranks_file, pattern)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches of a task, parted into runs of about `most` bytes of a text column, a row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def cut(docs: DataFrame, tokenizer: Callable[[], Tokens], capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and deal, a hash of the document's row."""
    end = array("I", [end_id]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer()
        for batch in by_bytes(batches, 1):
            out = [], [], [], [], [], []
            for doc, ids, deal in zip(batch.column(0), tokens.of_texts(batch.column(1)), batch.column(2), strict=True):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    stop = at + ((n - at) % capacity or capacity)
                    for column, value in zip(out, (doc.as_py(), k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop]), deal.as_py()), strict=True):
                        column.append(value)
                    at, k = stop, k + 1
            kinds = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col, F.xxhash64(id_col, text_col)).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, deal long")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 250) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how often): a fractional cutting plan by column generation, rounded down."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount, price = inverse @ demand, inverse.sum(0)
        value, column = _best_configuration(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        leave = np.flatnonzero(up)[np.argmin(amount[up] / step[up])]
        basis[:, leave] = column
    amount = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(basis[:, j].astype(int), int(amount[j] + 1e-9)) for j in range(m) if amount[j] >= 1 - 1e-9]


def _best_configuration(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack), by the number of its members."""
    widest = int(sizes.max())
    before = np.arange(capacity + 1) + widest - sizes[:, None]  # where a size leads from each room, behind as many places that no room is
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        value = np.concatenate((np.full(widest, -np.inf), best))[before]
        value += price[:, None]
        last = value.argmax(0)
        reached = value[last, np.arange(capacity + 1)]
        better = reached > best
        if not better.any():
            break
        best = np.where(better, reached, best)
        chosen.append(np.where(better, last, -1))
    column, w = np.zeros(len(sizes)), capacity
    for last in reversed(chosen):
        if last[w] >= 0:
            column[last[w]] += 1
            w -= int(sizes[last[w]])
    return best[capacity], column


def pack(lengths: np.ndarray, capacity: int, groups: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    n = len(lengths)
    sequence, offset = np.full(n, -1), np.zeros(n, np.int64)
    used: list[int] = []

    def put(i: int, k: int) -> None:
        sequence[i], offset[i] = k, used[k]
        used[k] += int(lengths[i])

    for i in np.flatnonzero(lengths == capacity):
        used.append(0)
        put(i, len(used) - 1)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] < capacity]
    large = order[lengths[order] * 8 > capacity]
    if len(large) > groups:
        members = [list(g[::-1]) for g in np.array_split(large, groups)]
        rounded = np.array([lengths[g].max() for g in np.array_split(large, groups)])
        sizes, group_of = np.unique(rounded, return_inverse=True)
        pools = [[] for _ in sizes]
        for g, k in zip(reversed(members), group_of[::-1], strict=True):
            pools[k] = pools[k] + g
        for counts, times in configurations(sizes, np.array([float(len(x)) for x in pools]), capacity):
            for _ in range(times):
                used.append(0)
                for k in np.flatnonzero(counts)[::-1]:
                    for _ in range(counts[k]):
                        if pools[k]:
                            put(pools[k].pop(), len(used) - 1)
    room: dict[int, list[int]] = {}
    mask = 0
    for k, u in enumerate(used):
        if u < capacity:
            room.setdefault(capacity - u, []).append(k)
            mask |= 1 << (capacity - u)
    for i in order[sequence[order] < 0]:
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, k = capacity, len(used)
            used.append(0)
        put(i, k)
        if left > size:
            room.setdefault(left - size, []).append(k)
            mask |= 1 << (left - size)
    return sequence, offset


def pack_documents(
    docs: DataFrame, tokenizer: Callable[[], Tokens], capacity: int = 1024, end_id: int = 2, bucket_docs: int = 16384, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of `docs`."""
    buckets = max(1, round(docs.count() / bucket_docs))
    pieces = cut(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("bucket", F.pmod("deal", F.lit(buckets)).cast("int")).drop("deal")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = pack(table.column("length").to_numpy(), capacity)
        first = table.column("bucket")[0].as_py() << 40
        return table.drop(["bucket"]).append_column("sequence_id", pa.array(sequence + first, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    kind = dict(docs.dtypes)[id_col]
    return pieces.groupBy("bucket").applyInArrow(fill, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
