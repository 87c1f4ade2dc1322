"""Suffix-array dedup: bytes covered by a string of `least` bytes that also starts in a document with a smaller id.

Documents with equal texts are settled by their digest: all but the first go whole. The others are dealt into
chunks of bounded size by their ids and texts, and one exchange of the texts serves three passes over the chunks:

1. Each window of `least` bytes has a minimizer, the least hash of its strings of 28 bytes (of 50), which depends on the
   window's content alone. Chunks send their minimizers to buckets, which send back those of two documents or more.
2. Runs of windows with such a minimizer are cut out as pieces. A chunk keeps one of equal pieces, and sends it
   to the minimizer's bucket; there equal pieces are joined again, and where a minimizer still has several
   different ones, a Burrows-Wheeler transform of them is expanded to the intervals of `least` common bytes.
   A minimizer of very many windows is split: its windows go by themselves, to the buckets of their own hashes.
3. The chunks get back the windows found and cut their texts.

Windows are compared as whole strings, so hashes decide nothing but where they meet. Null texts count as empty;
rows that repeat an id are not earlier than each other, whether their texts are equal or not, and each is judged by its own text;
rows without an id come last. Ids must be whole numbers (any other type raises an error). The other columns are carried along
in one struct, so that no name clashes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import smaller_owner
from .common import whole_numbers, with_class_min, written
from .shingles import blocks, mix

CHUNK_BYTES, BLOCK_BYTES, SHARD_BYTES = 4 << 20, 256 << 10, 96 << 10
HOT_WINDOWS, PIECE_WINDOWS = 30_000, 256
_K = np.uint64(0x9E3779B97F4A7C15)
_U16 = np.uint64(16)
_LOW = np.uint64(0xFFFF)
_LAST = (1 << 63) - 1
NOTES = "_chunk long, kind int, id long, blob binary"


def planes(a: np.ndarray) -> bytes:
    """The array's bytes, all first ones first: sorted or small numbers then compress in a shuffle."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()


def from_planes(data: bytes, kind, width: int = 1) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize * width, -1).T
    return np.ascontiguousarray(rows).view(kind).reshape(-1, width) if width > 1 else np.ascontiguousarray(rows).view(kind).ravel()


def gram_length(least: int) -> int:
    """Bytes of the strings whose hashes compete: long, so that few windows share one by chance, yet several to a window."""
    return min(32, max(16, least * 9 // 16))


def minimizers(texts: list[bytes], least: int) -> Iterator[np.ndarray]:
    """For each text the minimizer, 48 bits, of each of its windows."""
    for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
        data = b"".join(texts[a:b]) + bytes(least)
        n = len(data) - 7
        words = np.ndarray((n,), "<u8", data, strides=(1,)).copy()
        gram = gram_length(least)
        grams = mix(mix(words[: n - 8]) + words[8:] * _K)
        if gram > 16:
            grams = mix(grams[: len(grams) - gram + 16] * _K + grams[gram - 16 :])
        least_hash = grams >> _U16
        width, span = least - gram + 1, 1
        while span * 2 <= width:
            least_hash = np.minimum(least_hash[:-span], least_hash[span:])
            span *= 2
        if span < width:
            least_hash = np.minimum(least_hash[: -(width - span)], least_hash[width - span :])
        at = 0
        for t in texts[a:b]:
            yield least_hash[at : at + max(0, len(t) - least + 1)]
            at += len(t)


class Chunk:
    """The rows of a chunk in order of (id, text), and the notes that came for it."""

    def __init__(self, docs: pa.Table, notes: pa.Table) -> None:
        ids = np.array([_LAST if d is None else d for d in docs.column("id").to_pylist()], np.int64)
        texts = [(t or "").encode("utf-8", "replace") for t in docs.column("text").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.texts = ids[self.order], [texts[i] for i in self.order]
        kinds, values = notes.column("kind").to_pylist(), notes.column("id").to_pylist()
        blobs = notes.column("blob").to_pylist()
        told = {(v, b) for k, v, b in zip(kinds, values, blobs, strict=True) if k == 0}
        copied = {v for v, _ in told}
        self.copies = {i for i, d in enumerate(self.ids.tolist()) if d in copied and (d, hashlib.sha256(self.texts[i]).digest()) in told}
        self.blobs = [b for k, b in zip(kinds, blobs, strict=True) if k]
        self.alone = [i for i in range(len(self.ids)) if i not in self.copies]


def _by_bucket(values: np.ndarray, buckets: int):
    order = np.argsort(values % np.uint64(buckets), kind="stable")
    place = (values[order] % np.uint64(buckets)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(place)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(values[part[0]] % np.uint64(buckets)), part


def _send_minimizers(least: int, buckets: int):
    def work(key, docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(docs, notes)
        hashes, windows = [], []
        for m in minimizers([chunk.texts[i] for i in chunk.alone], least):
            h, n = np.unique(m, return_counts=True)
            hashes.append(h)
            windows.append(n)
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        found, where, documents = np.unique(h, return_inverse=True, return_counts=True)
        n = np.bincount(where, np.concatenate([*windows, np.zeros(0, int)]), len(found)).astype(np.uint64)
        packed = (found << _U16) | np.minimum(n, np.uint64(32767)) | ((documents > 1).astype(np.uint64) << np.uint64(15))
        parts = [(b, planes(packed[at])) for b, at in _by_bucket(found, buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int64()), "_chunk": pa.array([key[0].as_py()] * len(parts), pa.int64()), "blob": pa.array([x for _, x in parts], pa.binary())})

    return work


def _find_shared(hot_windows: int):
    def work(table: pa.Table) -> pa.Table:
        chunks, blobs = table.column("_chunk").to_numpy(), table.column("blob").to_pylist()
        packed = np.concatenate([from_planes(b, np.uint64) for b in blobs])
        row = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
        order = np.argsort(packed, kind="stable")
        packed, row = packed[order], row[order]
        _, first, where = np.unique(packed >> _U16, return_index=True, return_inverse=True)
        several = np.bincount(where, minlength=len(first)) > 1
        several |= np.bincount(where, ((packed >> np.uint64(15)) & np.uint64(1)).astype(float), len(first)) > 0
        hot = np.bincount(where, (packed & np.uint64(32767)).astype(float), len(first)) > hot_windows
        keep = several[where]
        back = ((packed >> _U16) << _U16) | hot[where].astype(np.uint64)
        out = defaultdict(list)
        order = np.argsort(row[keep], kind="stable")
        rows, back = row[keep][order], back[keep][order]
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
            if len(part):
                out[int(chunks[rows[part[0]]])].append(back[part])
        return _notes([(c, planes(np.concatenate(parts))) for c, parts in out.items()], 1)

    return work


def _notes(found: list[tuple[int, bytes]], kind: int) -> pa.Table:
    n = len(found)
    return pa.table({
        "_chunk": pa.array([c for c, _ in found], pa.int64()), "kind": pa.array([kind] * n, pa.int32()),
        "id": pa.array([0] * n, pa.int64()), "blob": pa.array([b for _, b in found], pa.binary()),
    })


def _send_pieces(least: int, buckets: int):
    """Rows of bucket, chunk, pieces (hash, id, length), their bytes, and their places (piece, row, start, windows).

    What the chunk can tell by itself goes by a bucket of its own, below 0, with places only.
    """

    def runs(m: np.ndarray, shared: np.ndarray, hot: np.ndarray):
        """(minimizer, first window, windows, hot) of each run of windows with one shared minimizer."""
        starts = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
        stops = np.concatenate((starts[1:], [len(m)]))
        value = m[starts]
        at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
        keep = shared[at] == value
        yield from zip(value[keep].tolist(), starts[keep].tolist(), stops[keep].tolist(), hot[at[keep]].tolist(), strict=True)

    def work(key, docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(docs, notes)
        flags = np.sort(np.concatenate([from_planes(b, np.uint64) for b in chunk.blobs] + [np.zeros(0, np.uint64)]))
        shared, hot = flags >> _U16, (flags & _LOW) > 0
        index: dict[bytes, int] = {}
        hashes: list[int] = []
        owners: list[int] = []
        places: list[tuple[int, int, int, int]] = []
        known: list[tuple[int, int, int]] = []
        alone = chunk.alone if len(shared) else []
        for i, m in zip(alone, minimizers([chunk.texts[i] for i in alone], least), strict=True):
            if not len(m):
                continue
            text, doc = chunk.texts[i], int(chunk.ids[i])
            for value, start, stop, is_hot in runs(m, shared, hot):
                step = 1 if is_hot else PIECE_WINDOWS
                for a in range(start, stop, step):
                    n = min(step, stop - a)
                    piece = text[a : a + n + least - 1]
                    k = index.get(piece)
                    if k is None:
                        k = index[piece] = len(hashes)
                        hashes.append(_digest48(piece) if is_hot else value)
                        owners.append(doc)
                    elif owners[k] < doc:
                        known.append((i, a, n))
                        continue
                    places.append((k, i, a, n))
        rows = []
        if known:
            rows.append((-1 - key[0].as_py(), None, None, np.array(known, np.int32).tobytes()))
        pieces, place = list(index), np.array(places, np.int64).reshape(-1, 4)
        if is_any := len(pieces):
            value = np.array(hashes, np.uint64)
            local = np.zeros(is_any, np.int64)
            bucket_of = (value % np.uint64(buckets)).astype(np.int64)
            place = place[np.argsort(bucket_of[place[:, 0]], kind="stable")]
            place_bucket = bucket_of[place[:, 0]]
            meta = np.column_stack((value.astype(np.int64), np.array(owners, np.int64), np.array([len(p) for p in pieces], np.int64)))  # once a chunk, not once a bucket
            for b, at in _by_bucket(value, buckets):
                local[at] = np.arange(len(at))
                own = place[np.searchsorted(place_bucket, b) : np.searchsorted(place_bucket, b, side="right")].copy()
                own[:, 0] = local[own[:, 0]]
                rows.append((b, planes(meta[at]), b"".join([pieces[i] for i in at.tolist()]), planes(own.astype(np.int32))))
        n = len(rows)
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int64()), "_chunk": pa.array([key[0].as_py()] * n, pa.int64()),
            "meta": pa.array([r[1] for r in rows], pa.binary()), "body": pa.array([r[2] for r in rows], pa.binary()), "places": pa.array([r[3] for r in rows], pa.binary()),
        })

    return work


def _digest48(piece: bytes) -> int:
    """48 bits of a digest that does not differ between processes."""
    return int.from_bytes(hashlib.blake2b(piece, digest_size=6).digest(), "little")


def _resolve(least: int):
    """The windows of each chunk that are in a document with a smaller id, as (row, first window, windows)."""

    def work(table: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        index: dict[bytes, int] = {}
        least_owner: list[int] = []
        value_of: list[int] = []
        asked: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for chunk, meta, body, places in zip(*(table.column(c).to_pylist() for c in ("_chunk", "meta", "body", "places")), strict=True):
            if meta is None:
                out.append((chunk, places))
                continue
            meta = from_planes(meta, np.int64, 3)
            at, which = 0, []
            for value, owner, size in meta.tolist():
                piece = body[at : at + size]
                at += size
                k = index.setdefault(piece, len(least_owner))
                if k == len(least_owner):
                    least_owner.append(owner)
                    value_of.append(value)
                elif owner < least_owner[k]:
                    least_owner[k] = owner
                which.append(k)
            asked.append((chunk, np.array(which), meta[:, 1], from_planes(places, np.int32, 4)))
        pieces, owners = list(index), np.array(least_owner, np.int64)
        parts: dict[int, list[tuple[int, int]]] = {}
        for group in _shards(value_of, pieces):
            for k, windows in zip(group, smaller_owner([pieces[k] for k in group], owners[group], least), strict=True):
                if windows.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], windows.astype(np.int8), [0]))))
                    parts[k] = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        for chunk, which, owner, places in asked:
            later = owner > owners[which]
            found = []
            for k, row, start, n in places.tolist():
                if later[k]:
                    found.append((row, start, n))
                else:
                    found += [(row, start + a, m) for a, m in parts.get(int(which[k]), ())]
            if found:
                out.append((chunk, np.array(found, np.int32).tobytes()))
        return _notes(out, 2)

    return work


def _shards(values: list[int], pieces: list[bytes]):
    """Pieces of the minimizers that have several, in lists of about SHARD_BYTES that keep a minimizer's pieces together."""
    groups = defaultdict(list)
    for k, value in enumerate(values):
        groups[value].append(k)
    shard, size = [], 0
    for members in groups.values():
        if len(members) < 2:
            continue
        add = sum(len(pieces[k]) for k in members)
        if shard and size + add > SHARD_BYTES:
            yield shard
            shard, size = [], 0
        shard, size = shard + members, size + add
    if shard:
        yield shard


def _cut(least: int, as_text: bool):
    def work(key, docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(docs, notes)
        found = np.frombuffer(b"".join(chunk.blobs), np.int32).reshape(-1, 3)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        first = np.searchsorted(found[:, 0], np.arange(len(chunk.ids) + 1))
        removed, kept = [], []
        for i, text in enumerate(chunk.texts):
            spans: list[list[int]] = []
            if i in chunk.copies:
                spans = [[0, len(text)]] if len(text) >= least else []
            for _, start, n in found[first[i] : first[i + 1]].tolist():
                stop = start + n + least - 1
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([start, stop])
            removed.append([{"start": a, "end": b} for a, b in spans])
            bounds = [0, *(x for s in spans for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
        rows = docs.take(pa.array(chunk.order, pa.int64())).select(["row"])
        rows = rows.append_column("n_bytes", pa.array([len(t) for t in chunk.texts], pa.int64()))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        rows = rows.append_column("removed", pa.array(removed, pa.list_(span)))
        if as_text:
            return rows.append_column("kept", pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
        return rows.append_column("kept", pa.array(kept, pa.binary()))

    return work


def remove_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, hot_windows: int = HOT_WINDOWS, as_text: bool = False) -> DataFrame:
    """row (the columns of `docs` but its text), n_bytes, removed (array of start and end, in bytes) and kept (the remaining bytes; as_text: a string, without what is left of a cut character)."""
    if least < 32:
        raise ValueError("at least 32 bytes")
    whole_numbers(docs, id_col)
    row = F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row)
    text = F.coalesce("text", F.lit(""))
    place = F.xxhash64("id", text)  # not the id alone, which many rows may share or lack
    digests = docs.select("id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"), place.alias("place"))
    classes = written(with_class_min(digests, "digest", "id", "first"), "substring-classes")
    total = classes.agg(F.sum("size")).first()[0] or 0
    chunks, buckets = max(64, -(-total // chunk_bytes)), max(32, -(-total // chunk_bytes))
    dealt = docs.withColumn("_chunk", F.pmod(place, F.lit(chunks))).groupBy("_chunk")
    copies = classes.filter("id <> first").select(F.pmod("place", F.lit(chunks)).alias("_chunk"), F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"), F.col("digest").alias("blob")).distinct()
    with_notes = lambda notes, work, schema: dealt.cogroup(notes.groupBy("_chunk")).applyInArrow(work, schema)
    sent = with_notes(copies, _send_minimizers(least, buckets), "bucket long, _chunk long, blob binary")
    shared = sent.groupBy("bucket").applyInArrow(_find_shared(hot_windows), NOTES)
    cut_out = with_notes(copies.unionByName(shared), _send_pieces(least, buckets), "bucket long, _chunk long, meta binary, body binary, places binary")
    found = cut_out.groupBy("bucket").applyInArrow(_resolve(least), NOTES)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    return with_notes(copies.unionByName(found), _cut(least, as_text), schema)


def digest(removed: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("row.doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """`docs` with the texts that are left (what a cut left of a character goes too), in the same columns."""
    out = remove_repeats(docs, least, as_text=True)
    column = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[column.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
