"""Digests as sums of halves, and checks that read past the tables."""

import hashlib

from auditweave.operators import journal as jr


def test_digest_is_the_sum_of_the_first_twelve_digits(spark):
    rows = [(i, None if i % 3 else f"t{i}") for i in range(2000)]
    got = jr.digest(spark.createDataFrame(rows, "b int, a string")).first()
    own = [int(hashlib.sha256(f"{a if a is not None else chr(0)}\x1f{b}".encode()).hexdigest()[:12], 16) for b, a in rows]
    assert (got["n_rows"], got["digest"]) == (2000, str(sum(own)))
    assert tuple(jr.digest(spark.createDataFrame([], "b int, a string")).first()) == (0, "0")


def test_the_tables_are_not_shuffled_for_a_few_changes(spark, tmp_path):
    """Checking or reverting a change joins the table as the larger side, whose rows stay where they are."""
    spark.range(200_000).selectExpr("id", "cast(id % 7 AS string) AS chunk_id").write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    changes = spark.createDataFrame([(1, "chunk_deletion", "links", "5", None, '{"id":5,"chunk_id":"5"}', None), (2, "chunk_deletion", "links", "999999", None, '{"id":999999,"chunk_id":"0"}', None)],
                                    "query_id int, kind string, table_name string, key string, column_name string, before string, after string")
    back = jr.reverted({"links": links}, changes)["links"]
    found = jr.verified({"links": links}, changes)
    assert back.count() == 200_001 and {(r["key"], r["is_restored"]) for r in found.collect()} == {("5", True), ("999999", False)}
    for df in (back, found):
        assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
