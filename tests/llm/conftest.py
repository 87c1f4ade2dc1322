import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 48271 + 11) % 2147483647
        out.append(WORDS[x % len(WORDS)] + str(x % 7))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and blank texts, repeated rows, copies, a long text, and columns of clashing names."""
    base = prose(1, 80)
    rows = [
        (1, base, "en", "s", 5, "x", 1), (2, base, None, "s", None, None, 2), (2, base, None, "s", None, None, 2), (3, None, "en", None, 0, "y", 3),
        (4, "", "fr", "s", 0, "z", 4), (5, " \t\n ", "fr", "s", 0, "z", 5), (6, base.upper() + " tail", "en", "s", 0, "", 6), (7, prose(2, 20000), "en", "t", 9, "x", 7),
        (8, "é" * 30 + base[:120] + "ü", "de", "t", 9, "x", 8), (None, prose(3, 50), "en", "t", 9, "x", 9), (9, "a" * 400, "en", "t", 9, "x", 10), (10, "b" + "a" * 300, "en", "t", 9, "x", 11),
        (11, "one", "en", "t", 9, "x", 12), (12, "ONE", "en", "t", 9, "x", 12),
    ]
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("kept", T.StringType()), ("bucket", T.LongType())]
    return spark.createDataFrame(rows, T.StructType([T.StructField(*f) for f in fields]))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
