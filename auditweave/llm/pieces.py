"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi search.

The automaton reads a segment once; at each place its output links list every piece that ends there, and each
relaxes the best score of the place. Scores are those of the model file, and the segmentation is the one with
the largest sum (ties: the longest last piece). A character that no piece covers becomes its UTF-8 bytes' pieces,
at the score of the worst piece less 10. Blanks become U+2581 and one is put before a text that is not empty, as
the model file asks; no piece crosses from another character to U+2581, so segments that start there are
searched by themselves and remembered.

Null and empty texts have no ids and decode to the empty text. A U+2581 of the text itself decodes to a blank.
A column of the input that has the name of the new one is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

BLANK = "▁"
MEMO, MEMO_CHARS = 200_000, 64


class Pieces(dict):
    """Keys: segments that are not long; values: their ids as little-endian 32-bit words. Emptied when full."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte_id, plain = {}, {}
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[piece] = (len(piece), model.get_score(i), i)
        self.unknown = min(x[1] for x in plain.values()) - 10
        self.unknown_id = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for piece, value in plain.items():
            self.automaton.add_word(piece, value)
        self.automaton.make_automaton()
        self.single = {p for p in plain if len(p) == 1}
        self.splits = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in plain)
        special = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.bytes = [special.get(i, t.replace(BLANK, " ").encode() if t in plain else b"") for i, t in enumerate(self.text)]

    def best(self, segment: str) -> list[int]:
        """Ids of the best segmentation."""
        n = len(segment)
        score, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        if self.single.issuperset(segment):
            for end, piece in self.automaton.iter(segment):
                value = score[end - piece[0] + 1] + piece[1]
                if value > score[end + 1]:
                    score[end + 1], back[end + 1] = value, piece
        else:
            self._with_unknown(segment, score, back)
        out, at = [], n
        while at:
            if back[at]:
                length, _, i = back[at]
                out.append(i)
                at -= length
            else:
                out += [self.byte_id.get(b, self.unknown_id) for b in reversed(segment[at - 1].encode())]
                at -= 1
        return out[::-1]

    def _with_unknown(self, segment: str, score: list, back: list) -> None:
        """The same search where some characters are no pieces: each of them is a step by itself."""
        reached = 0

        def bare(upto: int) -> None:
            for p in range(reached, upto):
                if segment[p] not in self.single and score[p] + self.unknown > score[p + 1]:
                    score[p + 1], back[p + 1] = score[p] + self.unknown, None

        for end, piece in self.automaton.iter(segment):
            if end >= reached:
                bare(end + 1)
                reached = end + 1
            value = score[end - piece[0] + 1] + piece[1]
            if value > score[end + 1]:
                score[end + 1], back[end + 1] = value, piece
        bare(len(segment))

    def __missing__(self, segment: str) -> bytes:
        found = array("I", self.best(segment)).tobytes()
        if len(segment) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[segment] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.splits:
            return self[BLANK + text.replace(" ", BLANK)]
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            return b"".join(map(self.__getitem__, re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", BLANK + text.replace(" ", BLANK))))
        return b"".join([self[BLANK + w] for w in text.split(" ")])

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in array("I", ids)])[1:].decode("utf-8", "replace")


def _mapped(df: DataFrame, model_file: str, column: str, out: str, kind: str, arrow: pa.DataType, do) -> DataFrame:
    df = df.select(*[c for c in df.columns if c != out])
    at = df.columns.index(column)
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{out}` {kind}"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_file)
        for batch in slices(batches):
            values = [do(pieces, x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, out])

    return df.mapInArrow(work, schema)


def encode(docs: DataFrame, model_file: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with the ids of each text, as binary little-endian unsigned 32-bit words."""
    return _mapped(docs, model_file, text_col, out, "binary", pa.binary(), lambda p, x: p.encode(x or ""))


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the text of each row's ids."""
    return _mapped(encoded, model_file, ids_col, out, "string", pa.string(), lambda p, x: p.decode(x or b""))
