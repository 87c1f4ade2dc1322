"""A query set against all rows: the best rows of each query in one or several orders, by cosine and what the rows hold.

Rows are dealt into a fixed number of shares and queries into chunks of bounded size. A task takes one chunk and one share, holds the queries'
vectors and the best rows so far, and lets the share's rows pass in batches. So memory is bounded, products are taken as matrices, and a share
passes on no more than `k` rows of each query and order: what moves grows with the queries, not with queries times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import norm

#: Shares of the rows; queries of a chunk, on average; queries and rows whose products are held at once.
SHARES, QUERIES, SLICE, BATCH = 24, 8192, 256, 4096
#: Slack of matrix products against rounding: it only adds candidates, which are summed in order.
SLACK = 1e-6

#: The value of an order (highest first) of query columns, row columns and cosines, as arrays that fit each other's shape.
Order = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray], np.ndarray]


class _Chunk:
    """The queries of one chunk and, for each order, their best rows so far."""

    def __init__(self, queries: pd.DataFrame, columns: list[str], kept: list[str], orders: dict[str, Order], k: int, own: bool) -> None:
        self.queries = {c: queries[c].to_numpy() for c in columns}
        self.vectors, self.lengths = np.stack(queries["vector"].to_numpy()).astype(float), queries["_length"].to_numpy()
        self.kept, self.orders, self.k, self.own = kept, orders, k, own
        self.found = {name: pd.DataFrame() for name in orders}
        self.least = {name: np.full(len(queries), -np.inf) for name in orders}

    def take(self, rows: pd.DataFrame) -> None:
        vectors, lengths = np.stack(rows["vector"].to_numpy()).astype(float), rows["_length"].to_numpy()
        held = {c: rows[c].to_numpy() for c in ["id", *self.kept]}
        wide = {c: x[None, :] for c, x in held.items()}
        new = {name: [self.found[name]] for name in self.orders}
        for start in range(0, len(self.lengths), SLICE):
            part = slice(start, start + SLICE)
            asked = {c: x[part][:, None] for c, x in self.queries.items()}
            near = self.vectors[part] @ vectors.T / (self.lengths[part][:, None] * lengths)
            barred = asked["query_id"] == wide["id"] if self.own else None
            for name, order in self.orders.items():
                value = np.broadcast_to(order(asked, wide, near), near.shape)
                if barred is not None:
                    value = np.where(barred, -np.inf, value)
                least = self.least[name][part]
                if len(rows) > self.k and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(value, -self.k, axis=1)[:, -self.k])
                i, j = np.nonzero(value >= (least - SLACK)[:, None])
                if barred is not None:
                    other = ~barred[i, j]
                    i, j = i[other], j[other]
                q = i + start
                total = np.zeros(len(i))
                for d in range(vectors.shape[1]):  # in order, as SQL sums them
                    total += self.vectors[q, d] * vectors[j, d]
                cosine = total / (self.lengths[q] * lengths[j])
                row = {c: x[j] for c, x in held.items()}
                exact = order({c: x[q] for c, x in self.queries.items()}, row, cosine)
                new[name].append(pd.DataFrame({"q": q, "value": exact, "score": cosine, **row}))
        for name, parts in new.items():
            both = pd.concat([p for p in parts if len(p)] or [parts[-1]], ignore_index=True)
            both = both.iloc[np.lexsort((pd.factorize(both["id"], sort=True)[0], -both["value"].to_numpy(float), both["q"].to_numpy(int)))]
            place = both.groupby("q").cumcount().to_numpy()
            both = both[place < self.k]
            last = both[place[place < self.k] == self.k - 1]
            self.least[name][last["q"].to_numpy(int)] = last["value"].to_numpy(float)
            self.found[name] = both

    def rows(self) -> Iterator[pd.DataFrame]:
        for name, found in self.found.items():
            if len(found):
                yield found.assign(mode=name, query_id=self.queries["query_id"][found["q"].to_numpy(int)])[["query_id", "mode", "id", *self.kept, "score", "value"]]


def best_rows(queries: DataFrame, rows: DataFrame, dim: int, k: int, orders: dict[str, Order], kept: list[str], own: bool = False, shares: int = SHARES, chunk: int = QUERIES) -> DataFrame:
    """query_id, mode, id, the columns kept, score (the cosine), value and place of the `k` best rows of each query in each order, ties to the smaller id.

    queries: query_id, vector and what the orders read; rows: id, vector and the columns kept, of other names. With `own` a query does not meet the row of its id. Vectors that
    are null, zero, of another length or not finite take no part. ids are keys.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *queries.schema]}
    lacks = lambda c: F.lit("" if kinds[c] == "string" else 0).cast(kinds[c]).alias(c)  # noqa: E731  # no nulls, which would turn whole numbers into floats
    length = norm(F.col("vector"))
    usable = lambda df: df.withColumn("_length", length).filter((F.size("vector") == dim) & (F.col("_length") > 0) & (F.col("_length") < float("inf")))
    columns, taken = [c for c in queries.columns if c != "vector"], ["id", *kept]
    chunks = max(1, -(-queries.count() // chunk))
    left = usable(queries).withColumn("_chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = usable(rows.select("id", "vector", *kept)).withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    common = ["vector", "_length", "_chunk", "_share"]
    both = left.select(F.lit(False).alias("_row"), *common, *columns, *map(lacks, taken)).unionByName(right.select(F.lit(True).alias("_row"), *common, *map(lacks, columns), *taken))
    dealt = both.repartitionById(chunks * shares, F.col("_chunk") * shares + F.col("_share")).drop("_chunk", "_share").sortWithinPartitions("_row")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, at = [], None
        for batch in batches:
            is_row = batch["_row"].to_numpy(bool)
            if not is_row.all():
                waiting.append(batch[~is_row])
            if waiting and at is None and is_row.any():
                at = _Chunk(pd.concat(waiting, ignore_index=True), columns, kept, orders, k, own)
            arrived = batch[is_row]
            for start in range(0, len(arrived) if at else 0, BATCH):
                at.take(arrived.iloc[start : start + BATCH])
        if at:
            yield from at.rows()

    schema = ", ".join([f"query_id {kinds['query_id']}", "mode string", *(f"{c} {kinds[c]}" for c in taken), "score double", "value double"])
    place = F.row_number().over(Window.partitionBy("query_id", "mode").orderBy(F.desc("value"), "id"))
    return dealt.mapInPandas(meet, schema).withColumn("place", place).filter(F.col("place") <= k)
