"""From raw documents to packed training sequences, in five stages; each is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm import neardup, packing, quality, secrets, substrings
from auditweave.llm.common import table, written
from auditweave.llm.queries import byte_bpe


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of `docs`, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 0.8 of its five-word shingles."""
    return neardup.keep_first(docs, percent=80, width=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes or more that an earlier document has."""
    return substrings.without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mask for each secret found."""
    clean = secrets.redact(docs)
    return clean.select(*[F.char_length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, byte_bpe())


STAGES = [
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: No stage but the secret scan could be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
