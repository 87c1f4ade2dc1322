"""Rules matched once for all requests that say the same."""

from auditweave.operators import retrieval


def test_equal_requests_are_answered_once(spark, monkeypatch):
    seen = []

    def posted(texts, *more):
        seen.append(texts.count())
        return usual(texts, *more)

    usual = retrieval.posted
    monkeypatch.setattr(retrieval, "posted", posted)
    rules = [(1, "c1", "d1", ["oil"], 5, 10), (2, "GENERAL", None, ["hot"], 4, 1), (3, "GENERAL", None, [], 1, 1), (4, "c1", None, ["Hot", "oil"], 6, 1)]
    rules = spark.createDataFrame([(*r, True, True, None) for r in rules], "rule_id int, category string, device string, keywords array<string>, priority int, created_s int, is_active boolean, is_approved boolean, expires int")
    kinds = [("c1", "d1", "Oil"), ("c1", None, "OIL"), (None, "d1", "hot oil"), ("c1", "d2", "hot OIL"), (None, None, ""), ("c1", "d1", None), ("c1", "d1", "oil")]
    asked = [(i, *kinds[i % 7]) for i in range(140)] + [(0, "c1", "d2", "hot oil")]  # an id that repeats has the best of its answers
    got = {r["query_id"]: r["rule_id"] for r in retrieval.match_rules(spark.createDataFrame(asked, "query_id int, category string, device string, text string"), rules, 100).collect()}
    of = {0: 1, 1: 3, 2: 2, 3: 4, 4: 3, 5: 3, 6: 1}
    assert got == {i: of[i % 7] for i in range(1, 140)} | {0: 4}
    assert seen == [6]  # before, all 141
