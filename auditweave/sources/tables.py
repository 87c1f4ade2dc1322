"""Reading and staging tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import CSV
#: The values that status columns may take.
ALLOWED = {"status": ("PENDING", "PROCESSING", "READY", "FAILED"), "badge": ("green", "yellow", "red", "gray"), "action": ("ACCEPT", "MODIFY", "INCORRECT", "SKIP")}


#: Folders of local sessions that have none set, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. Only a local session may lack it, as in tests; it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _LOCAL[app] = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-auditweave-")
    return found.rstrip("/")


def stage_table(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again: the lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unknown_values(df: DataFrame, column: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Each value and how often it stands, with whether it is an allowed one; unknown ones are kept but counted."""
    known = allowed or ALLOWED[column]
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("is_allowed", F.coalesce(F.col("value").isin(*known), F.lit(False)))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and n of each table, in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` without the rows of the keys that `new` brings, and `new`."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_seed(df: DataFrame, path: str) -> None:
    """`df` as gzipped CSV files with a header. A gz file is read by one task, so it is written in the partitions that `df` has."""
    df.write.mode("overwrite").options(**CSV).option("emptyValue", '""').option("compression", "gzip").csv(path)


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of gzipped CSV files under `schema`, and the lines that do not fit it (wrong number of fields, or a text where a number belongs): record, parsed (what could be read), file."""
    declared = T.StructType([*schema.fields, T.StructField("_record", T.StringType())])
    rows = spark.read.schema(declared).options(**CSV).option("nullValue", "\x00").option("emptyValue", "").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").csv(path)
    good = rows.filter("_record is null").select(*schema.fieldNames())
    return good, rows.filter("_record is not null").select(F.col("_record").alias("record"), F.to_json(F.struct(*schema.fieldNames())).alias("parsed"), F.input_file_name().alias("file"))


def load_seed(spark: SparkSession, path: str, schema: T.StructType, key: str, target: str) -> DataFrame:
    """Replace, in the table at `target` (Parquet, a folder for each `key`), the rows of the keys that the CSV files bring; gives the lines that do not fit.

    Only the folders of these keys are overwritten, so that a load may be repeated: the other documents are neither read nor written.
    A key without any fitting row is not touched. Rows without a key fit no folder and count as lines that do not fit.
    """
    good, bad = read_seed(spark, path, schema)
    lost = good.filter(F.col(key).isNull()).select(F.lit(None).cast("string").alias("record"), F.to_json(F.struct(*schema.fieldNames())).alias("parsed"), F.input_file_name().alias("file"))
    keyed = good.filter(F.col(key).isNotNull()).hint("rebalance", key)
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(target)
    return bad.unionByName(lost)


def seeded_table(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The table that load_seed writes."""
    return spark.read.schema(schema).parquet(target)
