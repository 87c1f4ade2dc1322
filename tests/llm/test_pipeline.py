"""The pipeline's stages, each against brute force on its own input, and as one run."""

import corpus_pipeline
from auditweave.llm import quality, secrets

from .test_text_operators import brute_components, brute_spans


def test_stages_take_effect_and_keep_the_columns(spark, sf_dir, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "repeated passages", "secrets", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.dtypes == before.dtypes
        a, b = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "quality":
            scores = {r["doc_id"]: r["predicted"] for r in quality.classify(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            assert set(b) == {d for d, p in scores.items() if p}
        if name == "near copies":
            assert set(b) == {d for d, (_, c) in brute_components(list(a.items()), width=5).items() if c == d}
        if name == "repeated passages":
            assert set(a) == set(b)
            seen = set()
            for d in sorted(a):
                own = {a[d].encode()[i : i + 50] for i in range(len(a[d].encode()) - 49)}
                if not own & seen:
                    assert b[d] == a[d]
                else:
                    assert len(b[d]) < len(a[d])
                seen |= own
        if name == "secrets":
            assert not any(brute_spans(t) for t in b.values())
            assert all(b[d] == a[d] for d in a if not brute_spans(a[d]) and "[secret]" not in b[d])
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).count() >= before.count()


def test_run(spark, sf_dir, odd_docs, no_docs):
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() > 0
    for table in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, sf_dir)
            if "sequence_id" in table.columns:
                break
        table.count()


def test_kinds_are_in_the_order_of_the_contract():
    assert tuple(r.kind for r in secrets.RULES[:3]) == secrets.BASE_KINDS
