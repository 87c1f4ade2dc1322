"""The prefix trie, line dedup and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditweave.llm import lines, middle, queries, trie

from ..compare import connect, duckdb_rows, spark_rows
from .conftest import prose

NAMES = ["op11_prefix_trie", "op12_line_dedup", "op13_fill_in_middle"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duckdb_rows(connect(sf_dir), queries.oracle_sql()[name])


# --- prefix trie


def brute_trie(paths):
    """paths: conv_id -> sequence of (role, text)."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)

    def below(node):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        found = [below(x) for x in children[node]]
        return own + sum(s for s, _ in found), sum(n for _, n in found) or 1

    out = []
    for node in [*members]:
        saved, leaves = below(node)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def ordered(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: tuple((r.decode(), t.decode()) for _, _, r, t in sorted(found[c])) for c in found}


def brute_rebuilt(rows):
    own = ordered(rows)
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, ())[:h] + turns[h:]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, path string, zone int"


def odd_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-n, n):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", None, ""]), rng.choice(["é", "a", "", None, "bb"]), "x", 1))
    return rows + rows[:5] + [(None, 1, "user", "nobody", "x", 1)]


def test_rebuilt_conversations_with_odd_rows(spark):
    rows = odd_turns(1, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    assert trie_rows(trie.trie(trie.rebuilt(df))) == brute_trie(brute_rebuilt([r[:4] for r in rows]))
    assert trie_rows(trie.trie(trie.paths(df))) == brute_trie(ordered([r[:4] for r in rows]))


def test_trie_of_no_conversations(spark):
    assert trie_rows(trie.trie(trie.rebuilt(spark.createDataFrame([], SCHEMA)))) == []


def block_rows(paths, sizes, whole_at):
    """Peels in rounds of blocks of the given sizes, as trie() does, without Spark."""
    ended = defaultdict(list)
    for c, p in paths.items():
        ended[p].append(c)
    code = {}
    turn = lambda t: code.setdefault(t, len(code).to_bytes(16, "big") + len(t[1].encode()).to_bytes(8, "big"))
    names = [n for n, _ in trie._PART]
    chains = [
        (None, None, b"".join(map(turn, p)), [dict(zip(names, (len(p), min(c), len(c), 0, 0, 0, hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest()), strict=True))])
        for p, c in ended.items()
    ]
    rounds = []
    while True:
        chains.sort(key=lambda x: x[2])
        whole = len(chains) <= whole_at
        size = len(chains) if whole else sizes
        blocks = [trie.Block(chains[i : i + size], i, whole) for i in range(0, len(chains), size)]
        rounds.append(blocks)
        chains = [c for b in blocks for c in b.chains]
        if whole:
            break
    known, out = {}, []
    for blocks in reversed(rounds):
        for b in blocks:
            out += [(*node[:2], known[node[8], node[9], node[1] - 1] if node[8] is not None else node[2], *node[3:8]) for node in b.nodes]
        known = {(z, s, d): c if c is not None else known[to_z, to_s, d] for b in blocks for z, s, d, c, to_z, to_s in b.links}
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [2, 3, 7])
def test_blocks_of_any_size_give_one_trie(size):
    rng = random.Random(size)
    for _ in range(30):
        paths = {c: tuple((rng.choice("ab"), rng.choice(["x", "é"])) for _ in range(rng.choice([0, 1, 2, 4, 7, 30]))) for c in range(rng.randint(1, 80))}
        for c in range(1, len(paths), 3):
            paths[c] = paths[c - 1][: rng.randint(0, 9)] + paths[c][:2]
        assert block_rows(paths, max(size, 3), whole_at=6) == brute_trie(paths)


def test_many_rounds_in_spark(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, i, "user", rng.choice("abc") if i < 6 else "snapshot") for c in range(300) for i in range(rng.choice([1, 4, 8, 40]))]
    monkeypatch.setattr(trie, "LAST_ROWS", 20)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(trie.trie(trie.paths(df))) == brute_trie(ordered(rows))


# --- line dedup

KEY = re.compile(r"[\x20\x09-\x0D]+")


def brute_lines(rows, least, least_chars=1):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    texts = [t or "" for t in rows]
    n = defaultdict(int)
    for t in texts:
        for k in {key(x) for x in t.split("\n")}:
            n[k] += len(k) >= least_chars
    kept = [[x for x in t.split("\n") if n[key(x)] < least] for t in texts]
    return [("\n".join(k), len(t.split("\n")), len(t.split("\n")) - len(k)) for t, k in zip(texts, kept, strict=True)]


def line_table(spark, seed=2, n=120):
    rng = random.Random(seed)
    made = ["Common line", "  common LINE\t", "rare", "É", "é", " ", "", "\x0bx\x0c", "X", *(f"only {i}" for i in range(40))]
    texts = ["\n".join(rng.choice(made) for _ in range(rng.randint(1, 12))) for _ in range(n)]
    texts += [None, "", "\n", "Common line", "common line\ncommon line", "\n".join(["z"] * 30000 + [f"q{i}" for i in range(30000)])]
    rows = [(i % 100 if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    rows += [rows[3]] * 12
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_lines string, lines int")


@pytest.mark.parametrize("parts", [1, 7])
def test_batches_of_any_number_drop_the_same_lines(spark, parts):
    rows, df = line_table(spark)
    batches = [df.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(parts)) == i) for i in range(parts)]
    got = lines.drop_common_lines(df, batches, least=10)
    assert got.columns == ["doc_id", "text", "lines", "n_lines", "n_dropped"]
    want = [(r[0], t, r[3], n, d) for r, (t, n, d) in zip(rows, brute_lines([r[1] for r in rows], 10), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_lines_found_by_the_join_alone(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 3)
    rows, df = line_table(spark, 3)
    got = lines.drop_common_lines(df, [df], least=4, least_chars=2).select("text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_lines([r[1] for r in rows], 4, 2), key=repr)


def test_a_settled_key_is_counted_no_more_and_runs_are_few(spark):
    runs = lines.LineRuns(spark, least=2, fanout=2)
    batch = spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id long, text string")
    for _ in range(5):
        runs.add(batch)
    assert all(len(level) < 2 for level in runs.counting + runs.settled)
    assert len(runs.tables) == sum(map(len, runs.counting + runs.settled))
    assert sorted(r["n_docs"] for r in runs.frequent().collect()) == [2, 4]
    assert not runs.tables


def test_line_dedup_of_an_empty_table(spark, no_docs):
    assert lines.drop_common_lines(no_docs, [no_docs]).collect() == []
    assert lines.LineRuns(spark).frequent().collect() == []


def test_line_dedup_runs_no_python(spark, sf_dir):
    plan = queries.op12_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- fill-in-middle


def brute_middle(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_table(spark):
    rng = random.Random(4)
    texts = [None, "", "\n", "\n\n\n", "one", "a\nb", "a<P>b\nc", "x\n<M>", "é\nü\n" * 50, "<\nP>", prose(4, 180_000), "y" * 200_000 + "\n" + "é" * 150_000, "l\n" * 60_000]
    texts += ["".join(rng.choice(["a", "é", "\n", "<", "P>", " "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = [(None if i % 9 == 8 else i % 150, t, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[10]] * 3 + [rows[4]] * 40
    return rows, spark.createDataFrame(rows, "doc_id long, text string, form string, part int")


@pytest.mark.parametrize("rate", [100, 60])
def test_middle_equals_brute_force_and_comes_back(spark, rate):
    rows, df = middle_table(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r[0], *brute_middle(*r[:2], rate)[:4], sha(brute_middle(*r[:2], rate)[4]), sha(r[1] or "")) for r in rows]
    for table in (df, df.repartition(1)):
        assert sorted(map(tuple, middle.digests(table, rate=rate).collect()), key=repr) == sorted(want, key=repr)
    texts = [(r["doc_id"], r["form"], r["text"]) for r in middle.transformed(df, rate=rate).collect()]
    assert sorted(texts, key=repr) == sorted(((r[0], brute_middle(*r[:2], rate)[1], brute_middle(*r[:2], rate)[4]) for r in rows), key=repr)
    assert sorted((i or -1, middle.original(t, f)) for i, f, t in texts) == sorted((r[0] or -1, r[1] or "") for r in rows)


def test_restoration_reads_the_output_alone(spark):
    """Pieces changed after assembly are restored as changed: nothing of the original text is carried along."""
    cut = middle.Cut(3, b"a\nb\nc\nd\n")
    assert b"".join(cut.pieces()) == brute_middle(3, "a\nb\nc\nd\n")[4].encode()
    assert middle.original("<S>Z<P>x<M>y", "spm") == "xyZ"


def test_middle_of_an_empty_table(no_docs):
    assert middle.digests(no_docs).collect() == [] and middle.transformed(no_docs).collect() == []
