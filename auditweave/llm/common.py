"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_numbers(df: DataFrame, id_col: str) -> None:
    """Refuse ids that are no whole numbers, before any work is done."""
    kind = dict(df.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; ids must be whole numbers")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches of a task, parted into runs of at most `rows` rows, which bound what is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Folders of local sessions that have none set, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may lack it, as in tests; it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _LOCAL[app] = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-auditweave-")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove what was written to a folder below the shared one, once nothing reads it any more."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def with_class_min(df: DataFrame, key: str, id_col: str, out: str, salts: int = 64) -> DataFrame:
    """Add `out`, the smallest `id_col` among the rows of the same `key`; null where `key` is null.

    A key may hold a third of all rows, so both the aggregation and the join back run on (key, salt): a
    key's rows are dealt over `salts` tasks and its minimum is copied only to the salts that it really has.
    """
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")
    per_salt = df.filter(F.col(key).isNotNull()).select(key, id_col, salt.alias("_salt")).groupBy(key, "_salt").agg(F.min(id_col).alias("_m"))
    least = (
        per_salt.groupBy(key)
        .agg(F.min("_m").alias(out), F.collect_list("_salt").alias("_salts"))
        .select(F.col(key).alias("_key"), out, F.explode("_salts").alias("_s"))
    )
    left = df.withColumn("_salt", salt)
    return left.join(least, (left[key] == least["_key"]) & (left["_salt"] == least["_s"]), "left").drop("_salt", "_key", "_s")
