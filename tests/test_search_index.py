"""The session index in several parts, with strings that all rows have."""

import glob

import pyarrow.parquet as pq

from auditweave.operators import search


def test_a_string_of_all_rows_is_dealt_into_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i % 90, f"user#{i}", None if i % 3 else "User@x.org") for i in range(100)], "id long, name string, email string")  # ten ids repeat
    path = str(tmp_path / "index")
    search.build_index(rows, ["name", "email"], path, rows_of_part=10)
    find = lambda term: sorted((r["id"], r["name"]) for r in search.found(spark, path, ["name", "email"], term).collect())
    for term in ("user", "ER#4", "@X", "#", "x.org", "none", ""):
        want = [(i % 90, f"user#{i}") for i in range(100) if term.lower() in f"user#{i}" or (i % 3 == 0 and term.lower() in "user@x.org")]
        assert find(term) == sorted(want)
    sizes = [pq.read_metadata(f).num_rows for f in glob.glob(f"{path}/postings/**/*.parquet", recursive=True)]
    grams = [pq.read_table(f, columns=["gram"]).column("gram").to_pylist() for f in glob.glob(f"{path}/postings/**/*.parquet", recursive=True)]
    holding = sum("use" in g for g in grams)
    assert holding >= 8 and max(sizes) < 300  # all hundred rows hold "use"; before, one task wrote them all
