"""Secret scans: every rule in one pass over the bytes of a text.

Rules are regular expressions. They are compiled together, by subset construction and minimisation, into
one automaton over bytes, whose transition array is all that a task needs. Where the automaton accepts, the
rule's reversed automaton finds the leftmost start and its anchored one the longest end, so that the spans
are those of a leftmost, non-overlapping, greedy search for each rule by itself.

Null texts count as empty and have no spans; columns of the input other than id and text are not read;
repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Dfa, compile_rules
from .common import slices


@dataclass(frozen=True)
class Rule:
    """`pattern` is the secret; `trigger`, a pattern that ends inside every match, is what the one pass looks for
    (the pattern itself where it is empty); `least` is the fewest characters of the value behind the separator."""

    kind: str
    pattern: str
    trigger: str = ""
    least: int = 0


BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+"
#: The base rules as the contract words them, then well-known token formats. Counted repeats behind
#: a literal stay out of the triggers, since counters of several rules would multiply the states.
RULES = (
    Rule("assign", _ASSIGN, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "-----BEGIN "),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}", "AIza[A-Za-z0-9_-]"),
)


class Walk:
    """An automaton as flat lists, whose indexing is the fastest that Python has; places are those of `classes(data)`."""

    def __init__(self, dfa: Dfa) -> None:
        width = dfa.next.shape[1]
        self.table, self.begin = (dfa.next * width).ravel().tolist(), dfa.start * width
        self.floor, self.dead, self.map = dfa.first_accepting * width, dfa.dead * width, dfa.classes.tobytes()
        self.rules = np.repeat(dfa.rules, width).tolist()

    def classes(self, data: bytes) -> bytes:
        return data.translate(self.map)

    def furthest(self, classes: bytes, places: range) -> int:
        """The last of the places, read in turn, at which the automaton accepts; -1 if there is none."""
        table, floor, dead, s, best = self.table, self.floor, self.dead, self.begin, -1
        for i in places:
            s = table[s + classes[i]]
            if s == dead:
                break
            if s >= floor:
                best = i
        return best

    def first(self, classes: bytes, at: int) -> int:
        """The end of the first accepted prefix of what begins at `at`; -1 if there is none."""
        table, floor, s = self.table, self.floor, self.begin
        for i in range(at, len(classes)):
            s = table[s + classes[i]]
            if s >= floor:
                return i + 1
        return -1


class Scanner:
    """The compiled rules. `spans` gives (rule number, start, end) in bytes."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        triggers = [r.trigger or r.pattern for r in rules]
        self.all = compile_rules(triggers, unanchored=True)
        self.ahead = [compile_rules([r.pattern], unanchored=False) for r in rules]
        self.back = [compile_rules([x], unanchored=False, backward=True) for x in triggers]
        self.seek = [compile_rules([x], unanchored=True) for x in triggers]

    def prepare(self) -> "Scanner":
        """The automata as lists; made once in each task."""
        self.pass_, self.walks = Walk(self.all), [tuple(map(Walk, x)) for x in zip(self.ahead, self.back, self.seek, strict=True)]
        return self

    def runs(self, data: bytes) -> list[tuple[int, int, int]]:
        """(first end, last end, rules as bits) of each run of accepting steps of the one pass."""
        table, floor, s = self.pass_.table, self.pass_.floor, self.pass_.begin
        classes = self.pass_.classes(data)
        for c in classes:
            s = table[s + c]
            if s >= floor:
                break
        else:
            return []
        out, s, of, since, rules = [], self.pass_.begin, 0, 0, self.pass_.rules
        for i, c in enumerate(classes, 1):
            s = table[s + c]
            if s >= floor:
                if of != rules[s]:
                    if of:
                        out.append((since, i - 1, of))
                    of, since = rules[s], i
            elif of:
                out.append((since, i - 1, of))
                of = 0
        return [*out, (since, len(data), of)] if of else out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        found, out = self.runs(data), []
        for k in range(len(self.rules)):
            mine = [(a, b) for a, b, bits in found if bits >> k & 1]
            if mine:
                out += self._of_rule(k, data, mine)
        return sorted(out, key=lambda x: (x[1], x[0]))

    def _of_rule(self, k: int, data: bytes, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """The rule's spans. What a run accepts may begin before `free`, the end of the last match; where a walk back
        tells so, the rule is sought from `free` on, so that each byte is read a bounded number of times."""
        (ahead, backward, seek), least = self.walks[k], self.rules[k].least
        ahead_of, back_of, seek_of = (w.classes(data) for w in self.walks[k])
        free = at = 0
        while True:
            while at < len(runs) and runs[at][1] <= free:
                at += 1
            if at == len(runs):
                return
            end, start = runs[at][0], -1
            if end > free:
                start = backward.furthest(back_of, range(end - 1, free - 1, -1))
            if start < 0:
                end = seek.first(seek_of, free)
                if end < 0:
                    return
                start = backward.furthest(back_of, range(end - 1, free - 1, -1))
            stop = ahead.furthest(ahead_of, range(start, len(data))) + 1
            free = stop or start + 1  # no stop: what ends here is the trigger alone
            if stop and (not least or _value_length(data[start:stop]) >= least):
                yield k, start, stop


def _value_length(match: bytes) -> int:
    """Length of the value: what follows the first separator and its blanks and quote."""
    for i, b in enumerate(match):
        if b in b":=":
            rest = match[i + 1 :].lstrip(b" ")
            return len(rest[1:] if rest[:1] in (b'"', b"'") else rest)
    return 0


def _in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> dict[int, int]:
    """Byte place to code point place, for the ends of the spans only."""
    places, out, at, count = sorted({p for _, a, b in spans for p in (a, b)}), {}, 0, 0
    for p in places:
        count += len(data[at:p].decode("utf-8", "replace"))
        out[p], at = count, p
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id and `found`, an array of (kind, start, end) in code points, end exclusive."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, found array<struct<kind:string,start:long,end:long>>"
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = scanner.prepare()
        for batch in slices(batches):
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "replace")
                spans = ready.spans(data)
                place = _in_code_points(data, spans)
                rows.append([{"kind": kinds[k], "start": place[a], "end": place[b]} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, found_type)], names=[id_col, "found"])

    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns, from `found`."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans")
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every found span of the text replaced by `mask`; overlapping spans become one."""
    scanner = Scanner(rules)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = scanner.prepare()
        for batch in slices(batches):
            out = []
            for text in batch.column(at):
                text = text.as_py()
                data = (text or "").encode("utf-8", "replace")
                parts, done = [], 0
                for _, a, b in ready.spans(data):
                    if a >= done:
                        parts += [data[done:a], mask.encode()]
                    done = max(done, b)
                out.append(text if not done else b"".join([*parts, data[done:]]).decode("utf-8", "replace"))
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, schema)
