"""Secrets, shingles, near copies, repeated strings and pieces against brute force."""

import hashlib
import random
import re
import time
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditweave.llm import bwt, neardup, pieces, secrets, substrings
from auditweave.llm.automaton import compile_rules
from auditweave.llm.queries import tokenizer_file
from auditweave.llm.shingles import shingle_sets

from .conftest import prose

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_spans(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_secret_spans_are_those_of_regular_expressions(spark, docs):
    rng = random.Random(3)
    parts = ["password", "PASSWD", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abc", "abcdef1", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "fedcba98", "é", "-", ".", "=="]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    texts = made + [r["text"] for r in docs.select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.digest(secrets.scan_secrets(df)).collect():
        want = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, _, _ in want) for kind in secrets.BASE_KINDS]


def test_other_rules_add_spans_and_redaction_masks_all(spark):
    text = "x ghp_" + "A1" * 20 + " -----BEGIN RSA PRIVATE KEY----- password=hunter22x"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [s["kind"] for s in secrets.scan_secrets(df).first()["found"]] == ["github", "private_key", "assign"]
    assert secrets.redact(df).first()["text"] == "x [secret] [secret] [secret]"


def test_overlapping_and_repeated_secrets(spark):
    texts = [
        'token="token":' + "a" * 50, "token=token=token=x secret: :password=abcdefg", "-----BEGIN -----BEGIN RSA PRIVATE KEY-----" * 3, "AKIA" * 20 + " AKIA" + "A" * 15 + "AKIA" + "0" * 16,
        "token='abcdef' token: token: abcdefg", "AIza" * 40, "xox" * 9 + "xoxb-" * 9, 'api_key"="secret:abcdef"token=1', "0123456789abcdef" * 4 + "g" + "a" * 23 + "g" + "b" * 24,
    ]
    found = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        text = texts[r["doc_id"]]
        want = brute_spans(text) + [(rule.kind, m.start(), m.end()) for rule in secrets.RULES[3:] for m in re.finditer(rule.pattern, text)]
        assert sorted((s["kind"], s["start"], s["end"]) for s in r["found"]) == sorted(want)


def test_a_long_value_takes_time_in_proportion():
    scanner = secrets.Scanner().prepare()
    began = time.perf_counter()
    for text in (b'token="token":' + b"a" * 1_000_000, b"token=" + b"Ab9" * 300_000, b"token=abc " * 100_000, b"0af" * 300_000):
        scanner.spans(text)
    assert time.perf_counter() - began < 10


def test_automaton_agrees_with_the_expression_and_is_minimal():
    dfa = compile_rules(["(a|b)*abb", "c{2,3}"], unanchored=False)
    assert dfa.next.shape[0] == 9  # the start, 4 that follow a or b, 3 that count c, and the dead one
    for text in ("abb", "aabb", "babb", "ab", "cc", "ccc", "c", "cccc", ""):
        s = dfa.start
        for b in text.encode():
            s = dfa.next[s, dfa.classes[b]]
        assert dfa.rules[s] == bool(re.fullmatch("(a|b)*abb", text)) + 2 * bool(re.fullmatch("c{2,3}", text))


def sets_of(text, width=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width=2, percent=80):
    sets = {d: sets_of(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_shingle_sets(width):
    texts = ["a b c", "A  B\tc", "a b", "one", "", "a b a b a b", "ä b c d e f"]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts], width)] == [len(sets_of(t, width)) for t in texts]
    same = shingle_sets([b"x y z q r s", b"X y Z q  r s"], width)
    assert (same[0] == same[1]).all()


def variants(first: int, n: int, base: list[str]) -> list[tuple[int, str]]:
    """Texts of one base: one word in 33 replaced, in some two or three times as many."""
    made = []
    for i in range(n):
        rng = random.Random(i)
        made.append((first + i, " ".join(w if rng.random() > 0.03 * (1 + i % 3) else f"w{rng.randint(0, 9)}" for w in base)))
    return made


def near(df, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, **more).collect()}


@pytest.mark.parametrize("more", [{}, {"region": 3}, {"region": 20}, {"small": 4}])
def test_near_copies_are_those_of_all_pairs(spark, docs, more):
    made = spark.createDataFrame(variants(10_000, 60, prose(5, 60).split()), "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(made)
    assert near(df, **more) == brute_components([(r["doc_id"], r["text"]) for r in df.collect()])


def test_large_groups_of_copies_and_near_copies(spark):
    base = prose(6, 150)
    few = variants(60_000, 700, base.split())
    copies = spark.range(1, 50_001).select(F.col("id").alias("doc_id"), F.lit(base).alias("text"))
    got = near(copies.unionByName(spark.createDataFrame(few, "doc_id long, text string")))
    want = brute_components([(1, base), *few])
    assert len(got) == 50_700 and {d: got[d] for d in want} == want and {got[d] for d in range(1, 50_001)} == {want[1]}


def test_word_hashes_tell_structured_words_apart():
    word, other = "a", "b"
    for _ in range(11):
        word, other = word + other, other + word
    one, two = shingle_sets([f"{word} end".encode(), f"{other} end".encode()])
    assert len(word) == 2048 and one[0] != two[0]


def test_pairs_in_a_large_group_that_is_not_linked_are_found(spark):
    words = [f"t{i}" for i in range(150)]
    made = []
    for i in range(400):  # all are alike at 0.75; 40 pairs share more of what is their own, which makes 0.80
        twin = i // 2 if i < 80 else -1 - i
        made.append((i, " ".join(words + [f"p{twin}x{k}" for k in range(6)] + [f"o{i}x{k}" for k in range(19)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == brute_components(made)
    assert [c for _, (_, c) in sorted(got.items())][:80] == [i - i % 2 for i in range(80)]


def test_a_group_gives_candidates_in_proportion():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    places, rows = [], []
    for i in range(1500):
        s = base.copy()
        s[rng.integers(0, 400, 12)] = rng.integers(0, 1 << 63, 12).astype(np.uint64)
        signature = neardup.signature(np.unique(s))
        rows += [(place, i, len(np.unique(s)), neardup._sketch(signature)) for place in neardup._places(signature)]
    rows.sort()
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["place", "doc_id", "n_shingles", "sketch"])
    found = [p for b in neardup._in_order(20_000, 80, 32)([batch]) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert 1499 <= len(set(found)) < 1500 * 12


def brute_removed(rows, least=50):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for i in range(len(t) - least + 1):
            first.setdefault(t[i : i + least], float("inf") if d is None else d)
    out = []
    for d, t in rows:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] < (float("inf") if d is None else d):
                covered[i : i + least] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~covered])
        spans = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
        out.append((d, len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df, **more):
    got = substrings.digest(substrings.remove_repeats(df, **more)).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr)


@pytest.mark.parametrize("more", [{}, {"hot_windows": 5, "chunk_bytes": 50_000}])
def test_removed_bytes_are_those_of_all_windows(docs, odd_docs, more):
    for df in (docs, odd_docs):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]
        assert removed(df, **more) == brute_removed(rows)


def test_interval_expansion_finds_the_common_prefixes():
    rng = np.random.default_rng(4)
    for _ in range(20):
        strings = [bytes(rng.integers(97, 100, rng.integers(5, 40)).astype(np.uint8)) for _ in range(12)]
        owners = rng.integers(0, 6, 12)
        got = bwt.smaller_owner(strings, owners, 5)
        for s, o, found in zip(strings, owners, got, strict=True):
            want = [any(s[i : i + 5] in t and p < o for t, p in zip(strings, owners, strict=True)) for i in range(max(0, len(s) - 4))]
            assert found.tolist() == want


def test_occurrences_are_counted_from_a_coarse_table(monkeypatch):
    transform = np.random.default_rng(8).integers(0, 5, 333)
    for most in (1 << 20, 1000, 300):
        monkeypatch.setattr(bwt, "TABLE_BYTES", most)
        got = bwt.Occurrences(transform, 5).before(np.arange(334))
        assert (got == [[(transform[:i] == c).sum() for c in range(5)] for i in range(334)]).all()


def best_by_table(p, segment):
    """Viterbi over all substrings."""
    plain = {t: (p.automaton.get(t)[1], i) for i, t in enumerate(p.text) if p.automaton.exists(t)}
    score, back = [0.0], [None]
    for end in range(1, len(segment) + 1):
        options = [(score[start] + plain[segment[start:end]][0], end - start, [plain[segment[start:end]][1]]) for start in range(max(0, end - 20), end) if segment[start:end] in plain]
        if segment[end - 1] not in plain:
            options.append((score[end - 1] + p.unknown, 1, [p.byte_id[b] for b in segment[end - 1].encode()]))
        top = max(options, key=lambda o: (o[0], o[1]))
        score.append(top[0])
        back.append(top)
    out, at = [], len(segment)
    while at:
        out = back[at][2] + out
        at -= back[at][1]
    return out


def test_pieces_are_the_best_and_come_back(docs):
    p = pieces.Pieces(tokenizer_file("piece_bpe_32k.model"))
    texts = [r["text"] for r in docs.select("text").limit(60).collect()] + ["", " ", "a  b", "  x ", "\U0001f600 tab\tand\nline", "été zzzz\x00"]
    for text in texts:
        assert p.decode(p.encode(text)) == text
    for word in {w for t in texts for w in t.split(" ")[:30]}:
        segment = pieces.BLANK + word
        if pieces.BLANK not in word:
            assert array("I", p[segment]).tolist() == best_by_table(p, segment)


def test_odd_and_empty_tables(odd_docs, no_docs):
    model = tokenizer_file("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(odd_docs, model), model)
    assert back.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert secrets.digest(secrets.scan_secrets(odd_docs)).count() == odd_docs.count()
    rows = neardup.near_duplicates(odd_docs).collect()
    component = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == odd_docs.count() and [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    assert component[2] == 1 and component[6] == 1 and component[12] == 11 and [component[k] for k in (3, 4, 5, 7)] == [3, 4, 5, 7]
    assert neardup.keep_first(odd_docs).columns == odd_docs.columns
    left = substrings.without_repeats(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()
    for empty in (secrets.scan_secrets(no_docs), neardup.near_duplicates(no_docs), substrings.remove_repeats(no_docs), pieces.encode(no_docs, model)):
        assert empty.count() == 0


def shared_id_docs(spark):
    """Ids that repeat with equal, near and quite different texts; rows without an id; columns of clashing names."""
    a, b, c = prose(11, 90), prose(12, 90), prose(13, 90)
    near = a + " tail"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "y"), (6, near, "z"), (6, c, "z"), (7, near, "x"), (7, near, "x"), (None, a, "x"), (None, c, "x"), (9, c, "n"), (3, prose(14, 5), "x"), (3, None, "x"), (3, "", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, node string")


def test_repeats_in_rows_that_share_an_id(spark):
    rows, df = shared_id_docs(spark)
    order = lambda d: (d is None, d or 0)
    out = {}
    for d, t, _ in rows:
        data, gone = (t or "").encode(), set()
        earlier = {x for e, u, _ in rows if order(e) < order(d) for x in (u or "").encode().__getitem__ and [(u or "").encode()[i : i + 50] for i in range(len((u or "").encode()) - 49)]}
        for i in range(len(data) - 49):
            if data[i : i + 50] in earlier:
                gone.update(range(i, i + 50))
        out.setdefault((d, hashlib.sha256(data).hexdigest()), len(gone))
    for _ in range(2):
        got = substrings.remove_repeats(df, chunk_bytes=300)
        found = sorted(((r["row"]["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"])) for r in got.collect()), key=repr)
        assert found == sorted(((d, len((t or "").encode()), out[d, hashlib.sha256((t or "").encode()).hexdigest()]) for d, t, _ in rows), key=repr)
    assert next(r for r in substrings.without_repeats(df).collect() if r["doc_id"] == 5 and r["node"] == "y")["text"] == prose(12, 90)


def test_near_copies_in_rows_that_share_an_id(spark):
    rows, df = shared_id_docs(spark)
    keyed = [(i, t or "") for i, (_, t, _) in enumerate(rows)]
    label = brute_components(keyed)
    ids = {}
    for i, (_, c) in label.items():
        if rows[i][0] is not None:
            ids[c] = min(ids.get(c, 1 << 60), rows[i][0])
    for _ in range(2):
        got = [r for r in neardup.near_duplicates(df).collect() if r["doc_id"] is not None]
        want = [(rows[i][0], n, ids[c], rows[i][0] == ids[c]) for i, (n, c) in label.items() if rows[i][0] is not None]
        # an empty set is linked with nothing: it stands for itself under its id
        want = [(d, n, c, k) if n else (d, 0, d, True) for d, n, c, k in want]
        assert sorted(map(tuple, got)) == sorted(want)
        kept = sorted(map(tuple, neardup.keep_first(df, width=2).collect()), key=repr)
        assert (5, prose(12, 90), "y") in kept and (6, prose(13, 90), "z") in kept and (5, prose(11, 90), "x") not in kept
        assert sum(r[0] is None for r in kept) == 2


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for operator in (substrings.remove_repeats, neardup.near_duplicates):
        with pytest.raises(TypeError, match="whole numbers"):
            operator(df)


def test_the_shared_folder_of_a_session_without_one(spark, monkeypatch):
    from auditweave.llm import common

    set_before = spark.conf.get("spark.checkpoint.dir", None)
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: (a[0] if a else None) if key == "spark.checkpoint.dir" else get(self, key, *a))
    folder = common.shared_dir(spark)
    assert folder.startswith("file:///") and folder == common.shared_dir(spark) and folder != set_before
    held = common.written(spark.range(5), "some")
    assert held.count() == 5
    with pytest.raises(ValueError, match="not below"):
        common.discard(spark, "file:///tmp/elsewhere")
    common.discard(spark, held.inputFiles()[0].rsplit("/", 1)[0].replace("file:///", "file:///", 1))
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        held.count()
