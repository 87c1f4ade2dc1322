"""Hash chains: building, verifying, splitting and sealing.

A chain is sequential: each digest stands on the one before. Chains run side by side; within a task, records come in order of
chain and place and are folded in one pass that carries only the last digest, so that a chain of any length takes the memory of one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: What the first entry of a manifest, and of a log, stands on.
ZEROS = "0" * 64
LOG_GENESIS = "GENESIS"


def folded(records: DataFrame, chain: str, place: str, suffix: Column, first: str, prev: str, own: str) -> DataFrame:
    """`records` with `prev` and `own` = sha256(`prev` followed by `suffix`), in order of `place` within each chain; a chain's first stands on `first`.

    Records that share chain and place follow each other by their suffix. Records without a chain form one. A missing suffix counts as empty.
    """
    rows = records.withColumn("_suffix", F.coalesce(suffix, F.lit(""))).repartition(chain).sortWithinPartitions(chain, place, "_suffix")
    names = [c for c in rows.columns if c not in (prev, own)]
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in names and f.name != "_suffix"), T.StructField(prev, T.StringType()), T.StructField(own, T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tail, begun = None, first, False
        for batch in batches:
            before, after = [], []
            for key, text in zip(batch.column(chain).to_pylist(), batch.column("_suffix").to_pylist(), strict=True):
                if key != current or not begun:
                    current, tail, begun = key, first, True
                before.append(tail)
                tail = hashlib.sha256(f"{tail}{text}".encode()).hexdigest()
                after.append(tail)
            kept = batch.select([n for n in names if n != "_suffix"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*kept.schema.names, prev, own])

    return rows.select(*names).mapInArrow(fold, schema)


def chained(entries: DataFrame, chain: str = "document_id", place: str = "entry_sequence", payload: str = "entry_json", first: str = ZEROS) -> DataFrame:
    """`entries` with prev_hash and entry_hash = sha256(prev_hash || payload), in order of `place` within each chain."""
    return folded(entries, chain, place, F.col(payload), first, "prev_hash", "entry_hash")


def tampered(chain: DataFrame, key: str = "document_id", every: int = 5, entry_type: str = "chunk_created") -> DataFrame:
    """A copy where one entry's stored hash is overwritten for each `every`-th key."""
    hit = (F.col(key) % every == 0) & (F.col("entry_type") == entry_type)
    return chain.withColumn("entry_hash", F.when(hit, F.concat(F.lit("TAMPERED_"), F.substring("entry_hash", 1, 55))).otherwise(F.col("entry_hash")))


def checked(chain: DataFrame, payload: str = "entry_json") -> DataFrame:
    """Whether each row's stored hash follows from its stored previous hash."""
    return chain.withColumn("is_valid", F.coalesce(F.sha2(F.concat("prev_hash", payload), 256) == F.col("entry_hash"), F.lit(False)))


def verify(chain: DataFrame, by: str = "document_id", place: str = "entry_sequence") -> DataFrame:
    """Per chain: validity, entries checked (up to the first failure), and that failure's place.

    A row fails if its hash does not follow, or its stored previous hash is not the row before's stored hash. The
    first row's previous hash is not checked.
    """
    order = Window.partitionBy(by).orderBy(place)
    rows = checked(chain).withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("entry_hash").over(order))
    ok = F.col("is_valid") & (F.col("before").isNull() | (F.col("before") == F.col("prev_hash")))
    failed = F.min(F.when(~ok, F.struct(F.col(place).alias("place"), F.col("n").alias("n"))))
    out = rows.groupBy(by).agg(F.count("*").alias("entries"), failed.alias("failed"))
    return out.select(by, F.col("failed").isNull().alias("is_valid"), F.coalesce("failed.n", "entries").cast("long").alias("entries_checked"), F.col("failed.place").alias("first_failure"))


def broken_documents(chain: DataFrame) -> DataFrame:
    """Documents with an entry whose hash does not follow; linkage is not checked, as entries are not contiguous."""
    return checked(chain).groupBy("document_id").agg(F.bool_and("is_valid").alias("ok")).filter("not ok").select("document_id")


def document_integrity(chain: DataFrame) -> DataFrame:
    return checked(chain).groupBy("document_id").agg(F.count("*").alias("entries"), F.when(F.bool_and("is_valid"), 1.0).otherwise(0.0).alias("score"))


def backfill(documents: DataFrame, chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Three entries for each document that has none: registered, chunks by level, embeddings."""
    lacking = documents.select(F.col("id").alias("document_id")).join(manifest.select("document_id").distinct(), "document_id", "left_anti")
    counts = chunks.groupBy("document_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("level") == 0).alias("leaves"), F.count_if(F.col("level") > 0).alias("summaries"), F.count("embedding").alias("embedded")
    )
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("registered").alias("entry_type"), F.concat(F.lit('{"document": '), F.col("document_id"), F.lit("}")).alias("entry_json")),
        F.struct(F.lit(1).alias("k"), F.lit("chunk_created").alias("entry_type"), F.concat(F.lit('{"leaves": '), F.col("leaves"), F.lit(', "summaries": '), F.col("summaries"), F.lit(', "total": '), F.col("total"), F.lit("}")).alias("entry_json")),
        F.struct(F.lit(2).alias("k"), F.lit("embedding_generated").alias("entry_type"), F.concat(F.lit('{"embedded": '), F.col("embedded"), F.lit("}")).alias("entry_json")),
    )
    rows = lacking.join(counts, "document_id").select("document_id", F.explode(kinds).alias("e")).select("document_id", "e.k", "e.entry_type", "e.entry_json")
    return chained(rows, place="k")


def record_text(previous: Column, row) -> Column:
    """previous|operation|document|node|start|metadata, where a missing document prints None and missing metadata nothing."""
    col = row.__getitem__
    return F.concat(
        previous, F.lit("|"), col("operation_type"), F.lit("|"), F.coalesce(col("document"), F.lit("None")), F.lit("|"), col("node_name"), F.lit("|"),
        col("started_ms").cast("string"), F.lit("|"), F.coalesce(col("metadata"), F.lit("")),
    )


def record_hashes(logs: DataFrame, previous: str) -> DataFrame:
    """The hash that each log record has on top of `previous`."""
    return logs.withColumn("record_hash", F.sha2(record_text(F.lit(previous), {c: F.col(c) for c in logs.columns}), 256))


def _log_suffix() -> Column:
    return record_text(F.lit(""), {c: F.col(c) for c in ("operation_type", "document", "node_name", "started_ms", "metadata")})


def log_chain(logs: DataFrame) -> DataFrame:
    """prev_hash and record_hash of each record, in order of id within its chain_id."""
    return folded(logs, "chain_id", "id", _log_suffix(), hashlib.sha256(LOG_GENESIS.encode()).hexdigest(), "prev_hash", "record_hash")


def verify_log_chain(stored: DataFrame) -> DataFrame:
    """Rows whose stored hash is not the recomputed one. The recomputed hash goes on, so a changed payload
    marks all later rows of its chain, a changed hash only its own."""
    again = folded(stored, "chain_id", "id", _log_suffix(), hashlib.sha256(LOG_GENESIS.encode()).hexdigest(), "_before", "_expected")
    return again.filter(~F.col("record_hash").eqNullSafe(F.col("_expected"))).select("chain_id", "id")


def split_retries(logs: DataFrame, node: str = "RepairPlanner") -> DataFrame:
    """The chain of each record: its trace's, and from the second `node` of the trace on one of its own."""
    order = Window.partitionBy("trace_id").orderBy("started_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum((F.split("node_name", ":")[0] == node).cast("int")).over(order)
    return logs.select("id", "trace_id", F.when(seen >= 2, F.concat("trace_id", F.lit("-retry"))).otherwise(F.col("trace_id")).alias("new_chain"))


def seal(df: DataFrame, key: str, buckets: int = 16, digits: int = 3) -> DataFrame:
    """A digest of each bucket of rows, whatever their order: the sha256 of the digests of its parts, in order, each of
    them the sha256 of the sorted sha256 values of the rows that begin with the same hex digits (more for more rows)."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    rows = df.select((F.col(key) % buckets).alias("bucket"), F.sha2(text, 256).alias("h"))
    digest = lambda of: F.sha2(F.array_join(of, ""), 256)
    parts = rows.groupBy("bucket", F.substring("h", 1, digits).alias("start")).agg(F.count("*").alias("n"), digest(F.array_sort(F.collect_list("h"))).alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])
    return parts.groupBy("bucket").agg(F.sum("n").alias("n_rows"), digest(ordered).alias("digest"))


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """16 hex digits over the keys that are present and not empty."""
    parts = [F.when(F.col(k).isNotNull() & (F.col(k).cast("string") != ""), F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in sorted(keys)]
    return df.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws(";", *parts), 256), 1, 16))
