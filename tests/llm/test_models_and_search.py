"""Searches against brute force; classifiers by held-out accuracy; packing and the pipeline by their promises."""

import math
import zlib
from array import array
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave.llm import ann, langid, maxscore, packing, quality, queries, urlrules
from auditweave.llm.vectors import sortable

from ..compare import connect, duckdb_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duckdb_rows(connect(sf_dir), queries.oracle_sql()[name])


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-20, 20, 24).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)]  # copies: ties
    rows += [(400, None), (401, []), (402, [float("nan")] * 24), (403, [float("inf")] + [1.0] * 23), (404, [None] + [1.0] * 23), (405, [0.0] * 24), (7, rows[7][1]), (406, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute_search(df, every, k, score):
    found = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect() if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all()}
    out = []
    for q in sorted(found):
        if q % every == 0:
            ranked = sorted((-score(found[q], v), i) for i, v in found.items() if i != q and len(v) == len(found[q]))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
    return out


def test_maxscore_is_exact(spark):
    df = vectors(spark).withColumn("embedding", F.transform("embedding", lambda x: x / 16 + 0.01))
    got = [tuple(r) for r in maxscore.top_k(df, F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()]
    assert got == brute_search(df, 20, 20, lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b)))


@pytest.mark.parametrize("peaks", [(2.0**23, 2.0**24), (2.0**40, 3.0), (1e300, 1e290), (1.7e308, 5e307)])
def test_large_weights_are_ranked_exactly(spark, peaks):
    rows = [(20, [peaks[0], -1.0, 0.5])] + [(i, [peaks[i % 2] / (i % 5 + 1), float(i), -peaks[1] * (i % 3)]) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in maxscore.top_k(df, F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()]
    whole = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    score = {i: sum(a * b for a, b in zip(whole[20], w, strict=True)) for i, w in whole.items() if i != 20}
    best = sorted(score, key=lambda i: (-score[i], i))[:5]
    assert got == [(20, n, i, max(-(2**63), min(2**63 - 1, score[i]))) for n, i in enumerate(best, 1)]


def test_sortable_bytes():
    some = [0, 1, -1, 255, 256, -255, -256, -257, 2**64, -(2**64), 10**400, -(10**400)]
    assert sorted(some, key=sortable) == sorted(some)


def test_searches_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.top_k(df, F.col("id") % 20 == 0).count() == 0 and ann.nearest(df, F.col("id") % 50 == 0).count() == 0


def test_cosines_of_very_large_and_small_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [1e200, 0.0, 0.0, 0.0]), (2, [1e-200, 0.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0]), (4, [1e308, 1e308, 0.0, 0.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 2, 4, 3] and np.allclose([g[3] for g in got], [1, 1, 0.5**0.5, 0])


def test_sparse_postings_and_small_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(1, 9, 40) * (rng.random(40) < 0.06)).astype(float).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from auditweave.llm.vectors import search_in_blocks, usable

    found = search_in_blocks(usable(df, "vec_id", "embedding", True), F.col("id") % 20 == 0, 20, maxscore._within(20, 64.0), "long", 64, 8)
    assert [tuple(r) for r in found.orderBy("query_id", "rank").collect()] == brute_search(df, 20, 20, lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b)))


def test_nearest_by_codes_has_full_recall_here(spark):
    df = vectors(spark).filter("vec_id <> 405")
    want = brute_search(df, 50, 5, lambda a, b: float(np.cumsum(a * b)[-1] / (np.sqrt(np.cumsum(b * b)[-1]) * np.sqrt(np.cumsum(a * a)[-1]))))
    got = [tuple(r) for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-15)
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    y = np.array(labels, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_quality_is_learned(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_quality_gam(spark, sf)
    known = rows.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(known) > 40 and auc([r["quality"] for r in known], [r["score"] for r in known]) > 0.9
    for r in rows.select("doc_id", "held_out").limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_additive_model_finds_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells by itself
    model = quality.fit(x, y, rounds=20, pair_rounds=60)
    assert {tuple(sorted(p[:2])) for p in model.pairs[:1]} == {(0, 1)}
    assert auc(y, model.score(x)) > 0.98


def test_scores_are_plain_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), bins=8, rounds=10, pair_rounds=10, pairs=2)
    for row, score in zip(x, model.score(x), strict=True):
        place = [sum(row[j] >= c for c in model.cuts[j]) for j in range(3)]
        total = model.base + sum(model.tables[j][place[j]] for j in range(3)) + sum(t[place[i], place[j]] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def plain_tree(g, h, depth):
    """The best cut of each node by trying every one."""
    worth = lambda a, b: a.sum() ** 2 / (b.sum() + 1)
    cuts = [(worth(g[:c], h[:c]) + worth(g[c:], h[c:]), -c) for c in range(1, len(g))]
    if depth and cuts and max(cuts)[0] > worth(g, h) + 1e-9:
        c = -max(cuts)[1]
        return plain_tree(g[:c], h[:c], depth - 1) + plain_tree(g[c:], h[c:], depth - 1)
    return [g.sum() / (h.sum() + 1)] * len(g)


def test_one_round_of_boosting_by_plain_trees():
    rng = np.random.default_rng(4)
    x = rng.random((200, 2))
    y = (x[:, 0] > 0.4).astype(float)
    model, base = quality.fit(x, y, bins=6, rounds=1, pair_rounds=0), np.log(y.mean() / (1 - y.mean()))
    total = np.full(200, base)
    for j in range(2):
        place = np.array([sum(v >= c for c in model.cuts[j]) for v in x[:, j]])
        p = 1 / (1 + np.exp(-total))
        g, h = (np.array([w[place == b].sum() for b in range(len(model.tables[j]))]) for w in (y - p, p * (1 - p)))
        step = 0.1 * np.array(plain_tree(g, h, 2))
        assert np.allclose(model.tables[j], step)
        total += step[place]


def test_quality_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(no_docs, labels.limit(0)).count() == 0
    assert quality.keep_good(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_languages_are_told(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_language_id(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def plain_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


def test_predictions_are_those_of_plain_substring_search(spark, docs):
    rows = docs.select("doc_id", "text").filter("length(text) < 3000").limit(40)
    samples = langid.learn(docs, F.lit(True), sample_docs=6, sample_chars=4000)
    assert len(samples) > 2
    got = {r["doc_id"]: r for r in langid.predict(rows, samples).collect()}
    for r in rows.collect():
        text = (r["text"] or "").lower()
        if any(map(str.isalpha, text)):
            bits, name, n = min((plain_phrases(text, s) * math.log2(len(s) + 1), name, plain_phrases(text, s)) for name, s in samples.items())
            assert got[r["doc_id"]]["lang_pred"] == name and abs(got[r["doc_id"]]["score"] - (1 - n / len(text))) < 1e-12


def test_samples_are_whole_texts_within_their_bounds(spark):
    rows = [(i, "ab cd " * n, lang) for i, (n, lang) in enumerate([(1, "x"), (300, "x"), (2, "x"), (1, "x"), (900, "y"), (800, "y"), (2, None)])]
    got = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), sample_docs=2, sample_chars=100)
    assert set(got) == {"x", "y"} and len(got["x"]) <= 100 and len(got["y"]) in (5400, 4800)


def test_phrases_against_substring_search():
    sample, text = "abracadabra banana", "cadabbananax abra"
    start = langid.suffix_automaton(sample)
    assert langid.phrases(text, start) == (plain_phrases(text, sample), len(text))


def test_language_of_odd_tables(odd_docs, no_docs):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd_docs).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[1] != "und"
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, {}).collect()} == {"und"}


def longest_rule(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(h + p, v) for v, h, p in urlrules.FIXED_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_rules(spark, sf_dir):
    urls = [r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "a://b.net/es/?q", "x://com", "x://com/", "x://y.com?z/", "x://a.net/fr/#f", "x://b://c.com/", "http://notexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("doc_id", F.lit(1)).withColumn("host", F.lit("h"))
    got = urlrules.judge(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = longest_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_mined_rules_block_what_labels_say(spark):
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.org/{'x' if i % 2 else 'y'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(pages, labels).collect()}
    assert all((got[i] == "block") == (i % 4 == 0) for i in range(200))
    assert {r["verdict"] for r in urlrules.judge(pages, labels.limit(0)).collect()} == {"allow"}


def test_mined_verdicts_are_those_of_plain_enumeration(spark, sf_dir):
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    tokens = {r["page_id"]: tuple(sorted(r["t"])) for r in pages.select("page_id", urlrules.url_tokens(F.col("url")).alias("t")).collect()}
    bad = defaultdict(bool)
    for r in labels.collect():
        bad[r["doc_id"]] |= r["quality"] == 0 or r["toxic"] == 1
    known = [(set(tokens[d]), b) for d, b in bad.items() if d in tokens]
    count = defaultdict(lambda: [0, 0])
    for t, b in known:
        for k in range(1, len(t) + 1):
            for some in combinations(sorted(t), k):
                count[some][b] += 1
    n, share = len(known), [sum(b == side for _, b in known) / len(known) for side in (0, 1)]
    rules = []
    for some, both in count.items():
        for side in (0, 1):
            sure = both[side] / sum(both)
            if both[side] >= math.ceil(0.02 * n) and sure >= 0.5 and sure / share[side] >= 1.05:
                rules.append((set(some), (sure, side)))
    assert {side for _, (_, side) in rules} == {0, 1}
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(pages, labels, fixed=(), min_support=0.02).collect()}
    for page, t in tokens.items():
        best = max((x for some, x in rules if some <= set(t)), default=(0, 0))
        assert got[page] == ("block" if best[1] else "allow")


def test_rules_on_empty_tables(spark, sf_dir):
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert urlrules.judge(pages.limit(0), labels).count() == 0


def test_many_sure_allow_rules_crowd_out_no_block_rule(spark):
    good = "http://good.org/a/b/c/d/e/f/g/h"  # ten tokens: 1023 antecedents, all of them sure
    rows = [(i, good if i % 4 else "http://bad.net/x") for i in range(200)] + [(200, "http://bad.net/x?new=1"), (201, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0 or i % 20 == 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(pages, labels, fixed=()).collect()}
    assert got == {i: "block" if i == 200 or (i < 200 and i % 4 == 0) else "allow" for i in range(202)}


def test_packing_keeps_every_id_in_few_gapless_sequences(spark, docs, odd_docs, no_docs):
    tokenizer = queries.byte_bpe()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    for df in (docs, odd_docs):
        rows = packing.pack_documents(df, tokenizer).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        ids = defaultdict(list)
        for d, t in texts:
            ids[d].append(model.encode(t, add_special_tokens=False).ids + [2])
        by = defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
            cuts = [zlib.crc32(array("I", x[r["start"] : r["start"] + r["length"]]).tobytes()) for x in ids[r["doc_id"]]]
            assert r["ids_crc32"] in cuts and (r["length"] == 1024 or r["piece"] == 0)
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(len(x) for xs in ids.values() for x in xs)
        assert sum(r["length"] for r in rows) == total and len(by) <= max(total / 1024 * 1.05 + 1, 2)
    assert packing.pack_documents(no_docs, tokenizer).count() == 0


def test_packing_of_many_lengths_is_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 1025, 6000)
    sequence, offset = packing.pack(lengths, 1024)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 1024 and used.min() > 0 and len(used) < 1.03 * lengths.sum() / 1024
    assert (np.bincount(sequence, offset == 0) == 1).all()


def test_special_token_text_as_the_tokenizer_has_it():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    tokens = queries.byte_bpe()()
    for text in ("", " ", "a  b", "x <|endoftext|> y", "<|endoftext|>", "it's I'll  'd a_b 12 3\r\n\r\n z　 q", "cafe\u0301 9½"):
        assert array("I", tokens.ids(text)).tolist() == model.encode(text, add_special_tokens=False).ids
