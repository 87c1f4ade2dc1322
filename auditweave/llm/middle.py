"""Fill-in-middle: texts cut at two line ends and put in another order, by secondary-sort assembly, and restored.

A text is a run of units, its lines with their ends. Two cuts, fixed by the document's id, part it into prefix, middle and
suffix. Each segment is emitted in pieces of whole units (about 64 KB; a longer unit is cut) keyed by document and place in the
output; `repartition` with `sortWithinPartitions`, the DataFrame form of repartitionAndSortWithinPartitions, brings them into
output order, and a task streams them into incremental digests without holding a text. For restoration the assembled pieces are
sorted again within their partitions, by the segments that the marks in the output tell, so that texts move once.

Null texts count as empty; a null id is hashed as an empty string. A row is keyed by its input partition, id and text digest:
rows that repeat both within a partition travel as equal pieces, are assembled once and counted, and give a row each. Ids must be
whole numbers; other columns are not read. An empty table gives no rows. A text that holds a mark stays plain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Of a mark: the place of its segment in the original text.
PLACES = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
PIECE_BYTES, BATCH_BYTES = 64 << 10, 4 << 20
_KEY = "part int, doc_id long, text_hash binary"
_ABOUT = "n long, form string, prefix_chars long, middle_chars long"
_PIECE = f"{_KEY}, place int, at long, data binary, {_ABOUT}"
_ASSEMBLED = f"{_PIECE}, copies long, output_sha256 string"
_KEYS = ("part", "doc_id", "text_hash")


class Cut:
    """The form and the three segments of one text."""

    def __init__(self, doc_id: int | None, text: bytes, seed: str = "7", rate: int = 100, spm: int = 50) -> None:
        h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        self.n = text.count(b"\n") + (bool(text) and not text.endswith(b"\n"))
        self.form, self.prefix_chars, self.middle_chars, self.segments = "plain", None, None, [(b"", text)]
        if text and h3 % 100 < rate and not any(mark in text for mark in PLACES):
            a, b = sorted((h1 % (self.n + 1), h2 % (self.n + 1)))
            first = _line_end(text, 0, a)
            second = _line_end(text, first, b - a)
            parts = {PREFIX: text[:first], MIDDLE: text[first:second], SUFFIX: text[second:]}
            self.form = "spm" if h4 % 100 < spm else "psm"
            self.prefix_chars, self.middle_chars = len(parts[PREFIX].decode()), len(parts[MIDDLE].decode())
            self.segments = [(mark, parts[mark]) for mark in ORDERS[self.form]]

    def pieces(self) -> Iterator[bytes]:
        """The output in pieces; a mark always begins one, and is never split."""
        for mark, segment in self.segments:
            at, lead = 0, mark
            while at < len(segment) or lead or (at == 0 and not mark):
                end = at + PIECE_BYTES
                if end < len(segment):
                    end = segment.rfind(b"\n", at, end) + 1 or end
                yield lead + segment[at:end]
                at, lead = end, b""


def _line_end(text: bytes, at: int, lines: int) -> int:
    """The end of the `lines`-th line from `at`."""
    for _ in range(lines):
        at = text.find(b"\n", at) + 1
        if not at:
            return len(text)
    return at


class _Rows:
    """Rows gathered into batches of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]) -> None:
        self.schema, self.rows, self.bytes = pa.schema(list(zip(names, types, strict=True))), [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size + 100
        if self.bytes >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0


def _rows(ddl: str) -> _Rows:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    return _Rows(list(names), [kinds[t] for t in types])


def _emit(seed: str, rate: int, spm: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), _rows(_PIECE)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                cut, digest = Cut(doc_id, text, seed, rate, spm), hashlib.blake2b(text, digest_size=16).digest()
                about = (cut.n, cut.form, cut.prefix_chars, cut.middle_chars)
                for at, data in enumerate(cut.pieces()):
                    yield from out.add((part, doc_id, digest, 0, at, data, *(about if at == 0 else (None,) * 4)), len(data))
        yield from out.flush()

    return emit


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order: each passes on with the place of its segment; the document's last row has its digest."""
    out = _rows(_ASSEMBLED)
    key = about = digest = None
    copies, last, place = 0, -1, 0

    def close() -> Iterator[pa.RecordBatch]:
        if about is not None:
            yield from out.add((*key, len(PLACES), last + 1, b"", *about, copies, digest.hexdigest()), 0)

    for *found, _, at, data, n, form, prefix_chars, middle_chars in _sorted_rows(batches):
        if tuple(found) != key:
            yield from close()
            key, about, digest, copies, last, place = tuple(found), (n, form, prefix_chars, middle_chars), hashlib.sha256(), 0, -1, 0
        copies += at == 0
        if at == last:
            continue  # the same piece of an equal row
        last = at
        digest.update(data)
        if about[1] != "plain" and data[:3] in PLACES:
            place, data = PLACES[data[:3]], data[3:]
        yield from out.add((*key, place, at, data, None, None, None, None, None, None), len(data))
    yield from close()
    yield from out.flush()


_DIGEST = f"doc_id long, {_ABOUT}, output_sha256 string, restored_sha256 string"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the original order into a second digest; a row for each copy of the document."""
    out, digest = _rows(_DIGEST), hashlib.sha256()
    for _, doc_id, _, place, _, data, n, form, prefix_chars, middle_chars, copies, output in _sorted_rows(batches):
        if place < len(PLACES):
            digest.update(data)
        else:
            for _ in range(copies):
                yield from out.add((doc_id, n, form, prefix_chars, middle_chars, output, digest.hexdigest()), 0)
            digest = hashlib.sha256()
    yield from out.flush()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, found, key, form, copies, last = _rows("doc_id long, form string, text binary"), [], None, None, 0, -1

    def close() -> Iterator[pa.RecordBatch]:
        text = b"".join(found)
        for _ in range(copies):
            yield from out.add((key[1], form, text), len(text))

    for *at_key, _, at, data, _, its_form, _, _ in _sorted_rows(batches):
        if tuple(at_key) != key:
            yield from close()
            found, key, form, copies, last = [], tuple(at_key), its_form, 0, -1
        copies += at == 0
        if at != last:
            found.append(data)
        last = at
    yield from close()
    yield from out.flush()


def _pieces(docs: DataFrame, seed: str, rate: int, spm: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(_emit(seed, rate, spm), _PIECE).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "at")


def transformed(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, form and text of each row: `rate` percent of the documents in the order suffix-prefix-middle (`spm` percent) or
    prefix-suffix-middle, the rest plain."""
    return _pieces(docs, seed, rate, spm).mapInArrow(_join, "doc_id long, form string, text binary").withColumn("text", F.col("text").cast("string"))


def digests(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50) -> DataFrame:
    """A row for each document: n units, form, prefix_chars, middle_chars, and the digests of the output and of the text rebuilt from it."""
    assembled = _pieces(docs, seed, rate, spm).mapInArrow(_assemble, _ASSEMBLED)
    return assembled.sortWithinPartitions(*_KEYS, "place", "at").mapInArrow(_restore, _DIGEST)


def original(text: str, form: str) -> str:
    """The text that an output of `form` was made from."""
    if form == "plain":
        return text
    found, rest = {}, text.encode()
    for mark, after in zip(ORDERS[form], [*ORDERS[form][1:], None], strict=True):
        end = len(rest) if after is None else rest.index(after)
        found[mark], rest = rest[len(mark) : end], rest[end:]
    return b"".join(found[m] for m in sorted(PLACES, key=PLACES.get)).decode()
