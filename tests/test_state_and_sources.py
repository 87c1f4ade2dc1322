"""As-of joins, variant metadata, seed loads, the chain fold and the event-time buffer on small made tables."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from auditweave.functions import variant as vt
from auditweave.operators import asof, chains, execution
from auditweave.sources import tables
from auditweave.streaming import incremental as st


@pytest.mark.parametrize("span", [1, 7, 86_400])
def test_as_of_equals_a_search(spark, span):
    rng = random.Random(span)
    entries = [(rng.choice([1, 2, 3]), rng.randint(-20, 60), i, rng.choice([None, i % 5])) for i in range(120)] + [(None, 1, 500, 1), (1, None, 501, 1)]
    questions = [(q, rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(-30, 70)])) for q in range(200)]
    got = asof.latest_before(
        spark.createDataFrame(questions, "q long, doc long, t long"), spark.createDataFrame(entries, "doc long, s long, seq long, v long"), "doc", "t", "s", "seq", "v", "found", span
    ).collect()
    assert len(got) == len(questions)
    for r in got:
        stood = [(seq, v) for d, s, seq, v in entries if r["doc"] is not None and r["t"] is not None and d == r["doc"] and s is not None and s <= r["t"]]
        assert (tuple(r["found"]) if r["found"] else None) == (max(stood, key=lambda x: x[0]) if stood else None)


def test_default_times_and_scores(spark):
    manifest = spark.createDataFrame(
        [(1, 0, "registered", 100, None), (1, 1, "chunk_created", 200, 4), (1, 2, "chunk_created", 150, 8), (2, 3, "registered", 9000, None), (3, 4, "chunk_created", 50, None), (4, 5, "chunk_created", 50, 0)],
        "document_id int, entry_sequence long, entry_type string, created_s long, total_chunks long",
    )
    chunks = spark.createDataFrame([(1,)] * 6 + [(3,)] * 2, "document_id int")
    asked = spark.createDataFrame([(1, 1, None), (2, 1, 199), (3, 1, 99), (4, 2, None), (5, 9, 5), (6, 3, None), (7, 4, None), (8, 9, None)], "question_id long, document_id int, at_s long")
    got = {r["question_id"]: (r["at_s"], r["manifest_count"], r["current_count"], r["score"]) for r in asof.reconstructable_at(asked, manifest, chunks).collect()}
    assert got == {
        1: (200, 8, 6, 0.75), 2: (199, 8, 6, 0.75), 3: (99, None, 6, None), 4: (5400, None, 0, None), 5: (5, None, 0, None), 6: (50, 0, 2, 0.0), 7: (50, 0, 0, 1.0), 8: (None, None, 0, None)
    }


def test_as_of_of_empty_tables(spark):
    entries, questions = spark.createDataFrame([], "doc long, s long, seq long, v long"), spark.createDataFrame([(1, 1, 1)], "q long, doc long, t long")
    assert asof.latest_before(questions, entries, "doc", "t", "s", "seq", "v", "found").first()["found"] is None
    assert asof.latest_before(questions.limit(0), entries, "doc", "t", "s", "seq", "v", "found").collect() == []


def test_variant_keys_and_kinds(spark):
    texts = ['{"a": null, "b": [1, null, "x"], "c": "t", "d": true, "e": {"f": 5}}', '{"a"', None, "[]", '{"b": "s", "d": "true"}', "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, m string").withColumn("v", vt.parsed("m"))
    rows = df.orderBy("id").select(
        vt.has("v", "$.a").alias("a"), vt.elements("v", "$.b", "string").alias("b"), vt.kind("v").alias("k"), vt.kind("v", "$.a").alias("ka"), vt.text("v", "$.d").alias("d"), vt.number("v", "$.e.f").alias("f")
    ).collect()
    assert [r["a"] for r in rows] == [True, False, False, False, False, False]
    assert [r["b"] for r in rows] == [["1", None, "x"], None, None, None, None, None]
    assert [r["k"] for r in rows] == ["object", None, None, "array", "object", "null"]
    assert rows[0]["ka"] == "null" and [r["d"] for r in rows] == ["true", None, None, None, "true", None] and rows[0]["f"] == 5


def brute_kappa(rows):
    """Cells of the pooled table, verdict by verdict."""
    cells = {(True, True): 0, (False, False): 0, (True, False): 0, (False, True): 0}
    for sv, ae in rows:
        if sv is None or ae is None or "step_cross_validation" not in json.loads(ae):
            continue
        inline, cross = json.loads(sv), json.loads(ae)["step_cross_validation"]
        shadow = {x.get("step_index", -1): x.get("faithful", True) for x in (cross or {}).get("verdicts", []) if isinstance(x, dict)}
        for i, x in enumerate(inline if isinstance(inline, list) else []):
            if isinstance(x, dict):
                other = shadow[i] if i in shadow else shadow.get(x.get("step_index", i))
                if other is not None:
                    cells[bool(x.get("faithful", True)), other] += 1
    return cells


def test_verdict_kappa_by_hand_and_search(spark):
    rng = random.Random(8)
    verdict = lambda: rng.choice(["x", {}, {"faithful": True}, {"faithful": False}, {"faithful": None}, {"step_index": rng.randint(0, 4)}, {"step_index": rng.randint(0, 4), "faithful": False}, {"step_index": None}])
    rows = []
    for _ in range(150):
        inline = rng.choice([[verdict() for _ in range(rng.randint(0, 5))], {"a": 1}, None])
        evidence = rng.choice([{"step_cross_validation": {"verdicts": [v for v in (verdict() for _ in range(5)) if not (isinstance(v, dict) and v.get("step_index", 0) is None)]}}, {"step_cross_validation": None}, {"other": 1}])
        rows.append((json.dumps(inline) if inline is not None else None, json.dumps(evidence)))
    got = execution.verdict_kappa(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, step_verdicts string, async_evidence string")).first()
    want = brute_kappa(rows)
    assert (got["both"], got["neither"], got["inline_only"], got["shadow_only"]) == (want[True, True], want[False, False], want[True, False], want[False, True])
    none = execution.verdict_kappa(spark.createDataFrame([(1, "[]", '{"step_cross_validation": {}}')], "id int, step_verdicts string, async_evidence string")).first()
    assert none["kappa"] is None and none["evaluations"] == 1


def test_a_seed_load_twice_gives_the_same_rows_and_reports_bad_lines(spark, tmp_path):
    schema = spark.createDataFrame([], "document_id int, id long, text string, n double").schema
    old = [(1, 1, "old", 1.0), (2, 2, 'a "quoted",\r\ntext\n', 2.5), (2, 3, "", None), (3, 4, None, 0.0), (3, 5, " kept \t", 1e-9)]
    tables.write_seed(spark.createDataFrame(old, schema).repartition(3), str(tmp_path / "old"))
    assert tables.load_seed(spark, str(tmp_path / "old"), schema, "document_id", str(tmp_path / "t")).collect() == []
    read = lambda: sorted(map(tuple, tables.seeded_table(spark, str(tmp_path / "t"), schema).select(*schema.fieldNames()).collect()), key=repr)
    assert read() == sorted(old, key=repr)
    (tmp_path / "new").mkdir()
    import gzip

    with gzip.open(tmp_path / "new" / "part.csv.gz", "wt") as f:
        f.write('document_id,id,text,n\n1,10,"new\n""line""",3\n1,x,bad number,1\n9,11,,\n,12,no key,1\n4,13,too,1,many\n')
    for _ in range(2):
        bad = tables.load_seed(spark, str(tmp_path / "new"), schema, "document_id", str(tmp_path / "t")).collect()
        assert len(bad) == 3 and all(r["file"].endswith("part.csv.gz") for r in bad)
        assert read() == sorted([r for r in old if r[0] != 1] + [(1, 10, 'new\n"line"', 3.0), (9, 11, None, None)], key=repr)


def test_fold_of_odd_records(spark):
    rows = [("a", 2, "y", 1), ("a", 1, "x", 2), ("b", 1, None, 3), (None, 1, "n", 4), ("a", 2, "y", 5)]
    got = chains.folded(spark.createDataFrame(rows, "c string, p int, t string, prev string"), "c", "p", F.col("t"), "0", "prev", "own").orderBy("c", "p").collect()
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    a1 = sha("0", "x")
    assert [(r["c"], r["prev"], r["own"]) for r in got] == [
        (None, "0", sha("0", "n")), ("a", "0", a1), ("a", a1, sha(a1, "y")), ("a", sha(a1, "y"), sha(sha(a1, "y"), "y")), ("b", "0", sha("0")),
    ]
    assert chains.folded(spark.createDataFrame([], "c string, p int, t string"), "c", "p", F.col("t"), "0", "prev", "own").collect() == []


def test_a_chain_of_a_million_records(spark):
    n = 1_000_000
    got = chains.folded(spark.range(n).withColumn("c", F.lit(1)), "c", "id", F.col("id").cast("string"), "0", "prev", "own").filter(F.col("id") == n - 1).first()
    tail = "0"
    for i in range(n):
        tail = hashlib.sha256(f"{tail}{i}".encode()).hexdigest()
    assert got["own"] == tail


def chain_rows(spark, chain, times, broken=()):
    rows = [(i, chain, "node", None, "n", t, "{}") for i, t in enumerate(times)]
    stored = chains.log_chain(spark.createDataFrame(rows, "id long, chain_id string, operation_type string, document string, node_name string, started_ms long, metadata string"))
    return stored.withColumn("record_hash", F.when(F.col("id").isin(*broken), "x").otherwise(F.col("record_hash")) if broken else F.col("record_hash"))


def test_records_wait_late_ones_are_reported_and_idle_chains_expire(spark):
    times = [1000 * i for i in range(60)]
    logs = chain_rows(spark, "a", times, broken=(7, 40)).unionByName(chain_rows(spark, "idle", [1000 * i for i in range(5)]))
    arrives = F.col("id") + F.pmod(F.col("id") * 7, F.lit(8)) + F.when((F.col("chain_id") == "a") & (F.col("id") == 12), 40).otherwise(0)
    beat = logs.filter("chain_id = 'a' and id = 59").withColumn("chain_id", F.lit("heartbeat")).withColumn("started_ms", F.lit(200_000).cast("long"))
    with st.rocksdb_state(spark):
        found = st.drain_arrivals(logs, arrives, lambda s: st.broken_records(s, "10 seconds", idle_ms=30_000), last=beat, parts=3).collect()
    by = {k: sorted((r["chain_id"], r["id"]) for r in found if r["state"] == k) for k in ("broken", "late", "expired")}
    assert by["late"] == [("a", 12)]
    # without record 12 all later ones stand on another digest
    assert by["broken"] == [("a", 7), *(("a", i) for i in range(13, 60))]
    assert by["expired"] == [("a", 59), ("idle", 4)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_the_shared_folder_of_a_session_without_one(spark, monkeypatch):
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: (a[0] if a else None) if key == "spark.checkpoint.dir" else get(self, key, *a))
    assert tables.shared_folder(spark) == tables.shared_folder(spark)
    assert tables.stage_table(spark.range(3)).count() == 3
