"""Registered queries of this package, one for each operator, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, lines, maxscore, middle, neardup, packing, pieces, quality, secrets, substrings, trie, urlrules
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_ann_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op3_bwt_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe():
    import public_tokenizers

    return packing.byte_bpe(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.decode(pieces.encode(docs, model), model)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = lines.drop_common_lines(docs, lines.by_files(docs), least=10, least_chars=1)
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"), seed="7", rate=100, spm=50)


def queries():
    found = (
        op1_secret_scan, op2_ann_rotated_codes, op3_bwt_intervals, op4_maxscore_topk, op5_lsh_forest, op6_quality_gam, op7_url_filter,
        op8_best_fit_packing, op9_sentencepiece, op10_language_id, op11_prefix_trie, op12_line_dedup, op13_fill_in_middle,
    )
    return {f.__name__: f for f in found}


_VECTORS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: {component}) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {more}
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, {score} AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % {every} = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
"""
_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 2 THEN [words[1]]
         ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM same JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.to_id),
c AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
#: The inner list_reduce is one byte of CRC-32, eight shifts with the reflected polynomial.
_TRIE = """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS half, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i < h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i >= h
), p AS (
  SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY half, i) FILTER (WHERE half IS NOT NULL), []) AS path FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), m AS (SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth, path FROM p),
v AS (
  SELECT list_slice(path, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM m GROUP BY ALL
), e AS (
  SELECT v.*, u.conv_id AS parent_conv_id, CASE WHEN v.depth = 0 THEN 0 ELSE (v.n_convs - 1) * octet_length(encode(v.path[v.depth].text)) END AS saved,
         (SELECT count(*) FROM v w WHERE w.depth = v.depth + 1 AND list_slice(w.path, 1, v.depth) = v.path) AS n_children
  FROM v LEFT JOIN v u ON u.depth = v.depth - 1 AND u.path = list_slice(v.path, 1, v.depth - 1)
), s AS (SELECT path AS below, unnest(range(0, depth + 1)) AS d, saved, n_children FROM e),
g AS (SELECT list_slice(below, 1, d) AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM s GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM e JOIN g USING (path)
"""
_LINES = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM t),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, length(key) >= 1 AND count(DISTINCT r) >= 10 AS often FROM k GROUP BY key),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE often) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT often), '')) AS kept_sha256 FROM k JOIN f USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM t JOIN s USING (r)
"""
_MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^
]*
|[^
]+') END AS units FROM t),
n AS (SELECT *, len(units) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS x FROM u),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
s AS (SELECT *, array_to_string(list_slice(units, 1, a), '') AS p, array_to_string(list_slice(units, a + 1, b), '') AS m, array_to_string(list_slice(units, b + 1, n), '') AS e FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s
"""
_DOT = "list_dot_product(q.vec, c.vec)"


def oracle_sql() -> dict[str, str]:
    return {
        "op5_lsh_forest": _NEAR, "op11_prefix_trie": _TRIE, "op12_line_dedup": _LINES, "op13_fill_in_middle": _MIDDLE,
        "op2_ann_rotated_codes": _VECTORS.format(
            component="CAST(x AS DOUBLE)", more="AND len(list_filter(embedding, lambda x: x <> 0)) > 0", every=50, k=5,
            score=f"{_DOT} / (sqrt(list_dot_product(c.vec, c.vec)) * sqrt(list_dot_product(q.vec, q.vec)))",
        ),
        "op4_maxscore_topk": _VECTORS.format(component="floor(64 * CAST(x AS DOUBLE))", more="", every=20, k=20, score=f"CAST({_DOT} AS BIGINT)"),
    }
