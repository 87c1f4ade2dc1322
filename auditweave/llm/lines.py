"""Line dedup: lines that many documents have are dropped from all, by levelled sorted runs of line hashes.

A line's key is the line without blanks at its ends, A-Z in lower case, as 128 bits of hash. `LineRuns` takes documents in
batches. A batch's keys, counted once a document, are merge-anti-joined with the settled runs (keys already found in
`least` documents, which need no more counting), and what is left becomes a run of its own. Runs are tables bucketed
and sorted by key in the shared folder, so runs join and merge bucket by bucket. When a level holds `fanout` runs they are summed
into one run of the next level (full merge joins, without an exchange), and keys that have reached `least` move to the settled runs, which are levelled likewise.

`drop_lines` then takes the settled keys out of texts. Keys that had over 1 / `HOT` of the settled keys' documents when they were
settled (at most `HOT` keys, so a broadcast of at most 1 MB) are found where the text stands; the rest by a join on the key, where a hot
line never comes. Line positions, not lines, travel; texts move once. DataFrame functions only.

A row is a document: rows that repeat an id count each. Null texts count as empty, which is one empty line; a line of blanks alone has an empty key and
is kept unless `least_chars` is 0. If all lines go, the text is empty. Other columns are carried in one struct, so no name clashes;
`n_lines` and `n_dropped` replace columns of these names. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, written

BLANKS, UPPER, LOWER = "\t\n\x0b\x0c\r ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most so many keys are broadcast, of 16 bytes each.
HOT = 50_000
_KEY = ("key_1", "key_2")


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in their order."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER))


def hashed(keys: Column, least_chars: int = 1) -> Column:
    """The two halves of each key's hash; null for keys shorter than `least_chars`."""
    halves = lambda key: F.struct(F.xxhash64(key).alias(_KEY[0]), F.xxhash64(F.lit(1), key).alias(_KEY[1]))
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= least_chars, halves(key)))


class LineRuns:
    """Levelled sorted runs of line keys and the number of documents that have each."""

    def __init__(self, spark: SparkSession, least: int = 10, least_chars: int = 1, fanout: int = 2) -> None:
        self.spark, self.least, self.least_chars, self.fanout = spark, least, least_chars, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.counting: list[list[str]] = []
        self.settled: list[list[str]] = []
        self.tables: dict[str, str] = {}

    def add(self, batch: DataFrame) -> None:
        """Count the documents of `batch`; its keys that are not settled become a run."""
        keys = batch.select(F.explode(hashed(F.array_distinct(line_keys(F.col("text"))), self.least_chars)).alias("key"))
        fresh = keys.filter(F.col("key").isNotNull()).groupBy(*(F.col("key")[k].alias(k) for k in _KEY)).agg(F.count("*").alias("n_docs"))
        for run in (run for level in self.settled for run in level):
            fresh = fresh.join(self.spark.table(run).select(*_KEY).hint("merge"), [*_KEY], "left_anti")
        self._push(self.counting, 0, self._write(fresh))
        level = 0
        while len(self.counting[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def frequent(self) -> DataFrame:
        """Ends the count: key_1, key_2 and n_docs (when it was settled) of the keys in `least` documents or more."""
        counting, settled = ([run for level in levels for run in level] for levels in (self.counting, self.settled))
        found = [self._merged(counting).filter(F.col("n_docs") >= self.least)] if counting else []
        found += [self._merged(settled)] if settled else []
        if not found:
            return self.spark.createDataFrame([], "key_1 long, key_2 long, n_docs long")
        out = written(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "line-keys")
        self.counting, self.settled = [], []
        self._remove(counting + settled)
        return out

    def _merged(self, runs: list[str]) -> DataFrame:
        """Runs merged by key, their counts added; each has a key once."""
        first, *rest = map(self.spark.table, runs)
        for run in rest:
            both = first.join(run.select(*_KEY, F.col("n_docs").alias("more")).hint("merge"), [*_KEY], "full")
            first = both.select(*_KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))
        return first

    def _compact(self, level: int) -> None:
        """Merge the runs of a level: settled keys leave, the rest is one run of the next level."""
        old, self.counting[level] = self.counting[level], []
        merged, reached = self._merged(old), F.col("n_docs") >= self.least
        self._push(self.settled, 0, self._write(merged.filter(reached)))
        self._push(self.counting, level + 1, self._write(merged.filter(~reached)))
        self._remove(old)
        for at, runs in enumerate(self.settled):
            if len(runs) >= self.fanout:
                self.settled[at] = []
                self._push(self.settled, at + 1, self._write(self._merged(runs)))
                self._remove(runs)

    def _push(self, levels: list[list[str]], level: int, run: str) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(run)

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.tables[name] = f"{shared_dir(self.spark)}/{name}"
        run.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", self.tables[name]).saveAsTable(name)
        return name

    def _remove(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, self.tables.pop(name))


def drop_lines(docs: DataFrame, frequent: DataFrame, least_chars: int = 1) -> DataFrame:
    """`docs` without the lines whose keys are in `frequent` (key_1, key_2, n_docs), and n_lines and n_dropped of each."""
    text = F.coalesce("text", F.lit(""))
    row = [F.xxhash64("doc_id", text).alias("row_1"), F.xxhash64(F.lit(1), text, "doc_id").alias("row_2")]
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("others"), F.split(text, "\n").alias("lines"), *row)
    found = docs.select(*row, F.posexplode(hashed(line_keys(F.col("text")), least_chars)).alias("at", "key")).filter(F.col("key").isNotNull())
    total = frequent.agg(F.sum("n_docs")).first()[0] or 0
    is_hot = F.col("n_docs") * HOT > total
    hot = frequent.filter(is_hot).select(*_KEY, F.lit(True).alias("is_hot"))
    other = frequent.filter(~is_hot).select(*(F.col(k).alias(f"other_{k}") for k in _KEY), F.lit(True).alias("is_other"))
    flat = found.select("row_1", "row_2", "at", *(F.col("key")[k].alias(k) for k in _KEY)).join(F.broadcast(hot), [*_KEY], "left")
    # hot lines are found already: their row's hash in place of the key deals them out evenly
    keyed = flat.select("row_1", "row_2", "at", "is_hot", *(F.when(F.col("is_hot"), F.col(r)).otherwise(F.col(k)).alias(k) for r, k in zip(("row_1", "row_2"), _KEY, strict=True)))
    drops = (
        keyed.join(other, (F.col(_KEY[0]) == F.col(f"other_{_KEY[0]}")) & (F.col(_KEY[1]) == F.col(f"other_{_KEY[1]}")), "left")
        .filter("is_hot or is_other").groupBy("row_1", "row_2").agg(F.collect_set("at").alias("drops"))
    )
    both = rows.join(drops, ["row_1", "row_2"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drops", F.array().cast("array<int>")))
    cut = both.select(
        "others", F.array_join(F.transform(kept, lambda at: F.col("lines")[at]), "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return cut.select(*(F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns if c in others or c == "text"), "n_lines", "n_dropped")


def by_files(docs: DataFrame, batches: int = 4) -> list[DataFrame]:
    """The rows of a Parquet table in up to `batches` parts, each of whole files, so that each part reads only its own."""
    files = sorted(docs.inputFiles())
    size = max(1, -(-len(files) // batches))
    return [docs.sparkSession.read.schema(docs.schema).parquet(*files[at : at + size]) for at in range(0, len(files), size)]


def drop_common_lines(docs: DataFrame, batches: Sequence[DataFrame], least: int = 10, least_chars: int = 1) -> DataFrame:
    """`docs` without the lines found in `least` documents or more of `batches`, whose union `docs` is, or is a part of."""
    runs = LineRuns(docs.sparkSession, least, least_chars)
    for batch in batches:
        runs.add(batch)
    return drop_lines(docs, runs.frequent(), least_chars)
