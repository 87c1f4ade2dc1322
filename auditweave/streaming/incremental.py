"""Structured Streaming forms of the incremental operators. Each is held to the batch operator on the same rows.

`drain` runs a stream over what is there now, into files of the shared folder, and gives the rows back as a table;
`drain_arrivals` lets the rows of a table arrive in portions and starts the stream anew after each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chains import LOG_GENESIS, record_text
from ..sources.tables import shared_folder


def stream_of(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A parquet table, a file or a folder, as a stream of its files (a file needs a pattern for a path)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def _run(stream: DataFrame, base: str, mode: str) -> None:
    """The stream over what is there now; state and place come from `base`, where an earlier run may have left them."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def _rows(stream: DataFrame, base: str, keys: list[str] | None) -> DataFrame:
    spark = stream.sparkSession
    rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows").drop("batch")
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("row")).select(*keys, "row.*")
    return rows.drop("_batch")


def drain(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """All rows that the stream gives until its input is used up; with `keys`, in update mode, the last row of each."""
    base = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    _run(stream, base, mode)
    return _rows(stream, base, keys)


def drain_arrivals(df: DataFrame, place: Column, transform: Callable[[DataFrame], DataFrame], mode: str = "append", keys: list[str] | None = None, parts: int = 4, last: DataFrame | None = None) -> DataFrame:
    """As `drain`, of `transform` over rows of `df` that arrive in `parts` portions: even spans of the whole number `place`, rising; then the rows of `last`.

    After each portion the stream is started again from its checkpoint, so that watermarks and state outlive a restart.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    low, high = df.agg(F.min(place), F.max(place)).first()
    step = 1 if low is None else (high - low) // parts + 1
    for k in range(1 if low is None else parts):
        within = F.lit(True) if low is None else place.between(low + k * step, low + (k + 1) * step - 1)
        df.filter(within | place.isNull() if k == 0 else within).write.mode("append").parquet(f"{base}/input")
        stream = transform(stream_of(spark, f"{base}/input", None))
        _run(stream, base, mode)
    if last is not None:
        last.write.mode("append").parquet(f"{base}/input")
        _run(stream := transform(stream_of(spark, f"{base}/input", None)), base, mode)
    return _rows(stream, base, keys)


def node_activity(events: DataFrame, time: str, node: str, is_error: Column, value: str, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows, errors and the sum of `value` of each node in tumbling windows; works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, span).alias("w"), F.col(node).alias("node")).agg(F.count("*").alias("rows"), F.count_if(is_error).alias("errors"), F.round(F.sum(value), 4).alias("total")).select(
        F.col("w.start").alias("window_start"), "node", "rows", "errors", "total"
    )


def followed_within(first: DataFrame, second: DataFrame, key: str, time: str, span: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of a row of `first` and a later row of `second` of the same key within `span`, with the seconds between."""
    mark = lambda df: df.withWatermark(time, late) if df.isStreaming else df
    a = mark(first.select(F.col(key).alias("key"), F.col("id").alias("first_id"), F.col(time))).withColumnRenamed(time, "first_time")
    b = mark(second.select(F.col(key).alias("other"), F.col("id").alias("second_id"), F.col(time))).withColumnRenamed(time, "second_time")
    near = F.expr(f"key = other AND second_time >= first_time AND second_time <= first_time + INTERVAL {span}")
    return a.join(b, near).select("key", "first_id", "second_id", F.timestamp_diff("MICROSECOND", "first_time", "second_time").alias("micros"))


_LOG_START = hashlib.sha256(LOG_GENESIS.encode()).hexdigest()
_TAILS = pa.schema([("chain_id", pa.string()), ("tail", pa.string()), ("time_ms", pa.int64()), ("id", pa.int64())])
_WAITING = pa.schema([("chain_id", pa.string()), ("time_ms", pa.int64()), ("id", pa.int64()), ("suffix", pa.string()), ("record_hash", pa.string())])


def _packed(rows: list[tuple], schema: pa.Schema) -> bytes:
    """Rows as one compressed Arrow stream: a single value of the state."""
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema))
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in pa.ipc.open_stream(packed).read_all().columns), strict=True)


class _ChainCheck(StatefulProcessor):
    """State of a bucket of chains: of each chain the last recomputed hash and the time and id it stands on; the records that wait for the watermark.

    A batch's records are one value of the waiting list, and the tails one value, so that state is read and written by bucket, not by record. When the
    watermark passes a record, it is folded in; one at or before the last that was folded came too late and is reported. A
    chain whose last record is `idle_ms` behind the watermark and that has nothing waiting is forgotten.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tails = handle.getValueState("tails", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")
        self.due = handle.getValueState("due", "time_ms long")

    def _known(self) -> dict[str, tuple]:
        return {chain: rest for chain, *rest in _unpacked(self.tails.get()[0])} if self.tails.exists() else {}

    def _set_timer(self, at: int) -> None:
        """The bucket's one timer."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def _rows(self, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame(found, columns=["chain_id", "id", "state"]).astype({"id": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Records wait; the timer goes to the earliest."""
        tails, found, held = self._known(), [], []
        for frame in rows:
            for row in zip(*(frame[c].tolist() for c in _WAITING.names), strict=True):
                chain, at, record = row[:3]
                if chain in tails and (at, record) <= (tails[chain][1], tails[chain][2]):
                    found.append((chain, record, "late"))
                else:
                    held.append(row)
        if held:
            self.waiting.appendValue((_packed(held, _WAITING),))
            first = int(min(row[1] for row in held))
            if not self.due.exists() or first < self.due.get()[0]:
                self._set_timer(first)
        yield from self._rows(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark has passed: fold what is due, in order, and forget chains that have been idle."""
        mark = timerValues.getCurrentWatermarkInMs()
        tails, found = self._known(), []
        waiting = {tuple(place): rest for (packed,) in self.waiting.get() for *place, suffix, stored in _unpacked(packed) for rest in [(suffix, stored)]}
        for place in sorted((k for k in waiting if k[1] <= mark), key=lambda k: k[1:]):
            chain, at, record = place
            suffix, stored = waiting.pop(place)
            tail = hashlib.sha256(f"{tails[chain][0] if chain in tails else _LOG_START}{suffix}".encode()).hexdigest()
            tails[chain] = (tail, at, record)
            if tail != stored:
                found.append((chain, record, "broken"))
        busy = {chain for chain, _, _ in waiting}
        idle = [chain for chain, (_, at, _) in tails.items() if at + self.idle_ms <= mark and chain not in busy]
        found += [(chain, tails.pop(chain)[2], "expired") for chain in idle]
        self.due.clear()  # the timer is used up
        if tails:
            self.tails.update((_packed([(chain, *rest) for chain, rest in tails.items()], _TAILS),))
        else:
            self.tails.clear()
        if waiting:
            self.waiting.put([(_packed([(*place, *rest) for place, rest in waiting.items()], _WAITING),)])
        else:
            self.waiting.clear()
        times = [at for _, at, _ in waiting] + [at + self.idle_ms for chain, (_, at, _) in tails.items() if chain not in busy]
        if times:
            self._set_timer(min(times))
        yield from self._rows(found)

    def close(self) -> None:
        pass


def broken_records(logs: DataFrame, late: str = "10 minutes", idle_ms: int = 7 * 86_400_000, buckets: int = 256) -> DataFrame:
    """chain_id, id and state of each record of a stream whose stored hash is not the one recomputed from the chain so far (broken), of records that came
    after the watermark had passed later ones of their chain (late), and of the last record of chains that were forgotten (expired).

    Records may come in any order within `late` of each other: they wait, and are folded in order of started_ms and id once the watermark passes. A chain
    forgotten after `idle_ms` would begin anew. Chains are dealt into `buckets` by a hash; a bucket with new records has its state read and written
    as a whole, so that many short chains cost no call each. The session must keep state in RocksDB (`rocksdb_state`).
    """
    suffix = record_text(F.lit(""), {c: F.col(c) for c in ("operation_type", "document", "node_name", "started_ms", "metadata")})
    rows = logs.select(
        F.pmod(F.xxhash64("chain_id"), F.lit(buckets)).alias("bucket"), "chain_id", F.col("started_ms").alias("time_ms"), "id",
        F.coalesce(suffix, F.lit("")).alias("suffix"), "record_hash", F.timestamp_millis("started_ms").alias("at"),
    )
    # without the column that carries the watermark, Spark hands late records on, too
    dealt = rows.withWatermark("at", late).drop("at").groupBy("bucket")
    return dealt.transformWithStateInPandas(_ChainCheck(idle_ms), "chain_id string, id long, state string", "Append", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which operators with timers need; the session's setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
