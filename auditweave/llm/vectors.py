"""Blocks of vectors and queries, which the two vector searches share.

The query set meets all rows in blocks: rows and queries are dealt into blocks of bounded size, and each task
gets one block of either. Only a block's best `k` rows of each query leave it. Vectors travel in the type that they
are stored in, once for each block of the other side: blocks are as large as tasks may hold, or smaller
where there are too few for `TASKS` tasks (which decides nothing but where the work is done).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS, QUERIES, TASKS = 32_768, 8192, 12


def usable(vectors: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """id, vec, dim: rows whose vector is not null nor empty and has finite components only.

    Several rows with one id count as one, with the smallest of their vectors.
    """
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    keep = finite & (F.size("vec") > 0)
    if not allow_zero:
        keep = keep & F.exists("vec", lambda v: v != 0)
    one = vectors.select(F.col(id_col).alias("id"), F.col(vec_col)).filter(F.col("id").isNotNull() & F.col(vec_col).isNotNull())
    rows = one.select("id", F.col(vec_col).alias("vec")).filter(keep)
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def search_in_blocks(rows: DataFrame, is_query, k: int, within, score_type: str, rows_block: int = ROWS, queries_block: int = QUERIES, wide: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best of each query, ties to the smaller id.

    `within(query ids, queries, row ids, rows)` gives, for a pair of blocks, arrays (query id, row id, score)
    with the block's best `k` rows of each query. Vectors of another length than the query's are no candidates.
    wide: scores are Python integers of any size, which are ranked as they are and returned as the nearest long.
    """
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    rows_block = max(1, min(rows_block, -(-n // TASKS)))
    row_blocks, query_blocks = max(1, -(-n // rows_block)), max(1, -(-n_queries // queries_block))
    block = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    right = rows.select("dim", block(row_blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), "id", "vec")
    left = rows.filter(is_query).select("dim", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("b"), block(query_blocks).alias("q"), "id", "vec")
    arrow = pa.float64() if score_type == "double" else pa.int64()

    def pair(queries: pa.Table, block_rows: pa.Table) -> pa.Table:
        found = ([], [], [])
        if queries.num_rows and block_rows.num_rows:
            found = within(*_matrix(queries), *_matrix(block_rows))
        out = {"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64())}
        if not wide:
            return pa.table(out | {"score": pa.array(found[2], arrow)})
        scores = [int(x) for x in found[2]]
        return pa.table(out | {"score": pa.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in scores], arrow), "size": pa.array(list(map(sortable, scores)), pa.binary())})

    by, more = ["dim", "b", "q"], ", size binary" if wide else ""
    best = left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(pair, f"query_id long, vec_id long, score {score_type}{more}")
    order = Window.partitionBy("query_id").orderBy(F.desc("size" if wide else "score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sortable(x: int) -> bytes:
    """Bytes in the order of the integers: sign and length, then the number (its complement, if negative)."""
    size = (abs(x).bit_length() + 7) // 8
    if x < 0:
        return (0x8000 - size).to_bytes(2, "big") + ((1 << 8 * size) + x).to_bytes(size, "big")
    return (0x8000 + size).to_bytes(2, "big") + x.to_bytes(size, "big")


def _matrix(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = block.column("id").to_numpy()
    flat = block.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.argsort(ids, kind="stable")  # so that ties go to smaller ids
    return ids[order], flat.reshape(len(ids), -1)[order]
