"""Exact top-k by inner product with vector-approximation blocks.

Vectors are packed into blocks. A block holds every component twice: as a cell number of a uniform
grid per dimension (one byte, the approximation) and exactly. For a query q, a vector in cells with
middles m and half widths h scores between q.m - |q|.h and q.m + |q|.h. A task takes one block of
vectors and one block of queries: it scans the cells for these bounds, takes the kth largest lower
bound as limit, reads the exact vectors of what remains in the order of their upper bounds, and
stops as soon as k exact scores are above every upper bound that is left. The k best of each block
are merged by a window over few rows per query.

Queries are a set of their own against all rows, block by block; nothing is broadcast. Exact scores
are 64-bit integers; components beyond 2^28 after scaling could overflow them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.storage import dealt, shuffle_width

CELLS = 256
PACKED = "dim int, block long, ids binary, exact binary"


def scaled(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows without a full finite vector go."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
        .select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"))
    )


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of at most `block_rows` vectors of one length, numbered by a hash of their ids."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, vs = held.pop(dim)
            made = np.array(ids, np.int64)
            exact = np.stack(vs).astype(np.int64) if dim else np.zeros((len(ids), 0), np.int64)
            number = int(np.uint64(xor_mix(made)) >> np.uint64(1))
            return pd.DataFrame(
                {"dim": [dim], "block": [number], "ids": [made.tobytes()], "exact": [exact.tobytes()]}
            )

        for batch in batches:
            for key, v in zip(batch["vec_id"], batch["v"]):
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(key)
                vs.append(np.asarray(v, np.int64))
                if len(ids) >= block_rows:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.mapInPandas(pack, PACKED)


def xor_mix(ids: np.ndarray) -> np.uint64:
    """A number for a block from what it holds, the same whenever its task runs again."""
    h = (ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return np.bitwise_xor.reduce(h + np.arange(len(h), dtype=np.uint64))


class Approximation:
    """Cells of a block: one byte per component on a uniform grid per dimension."""

    def __init__(self, exact: np.ndarray):
        self.low = exact.min(axis=0).astype(np.float64)
        span = exact.max(axis=0) - self.low
        self.half = np.maximum(span / (2 * CELLS), 0.5)
        self.cells = np.clip((exact - self.low) // (2 * self.half), 0, CELLS - 1).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, queries by vectors, widened by what rounding can take."""
        step = 2 * self.half
        q = queries.astype(np.float64)
        scores = (q * step) @ self.cells.T.astype(np.float64)
        scores += (q @ (self.low + self.half))[:, None]
        slack = np.abs(q) @ self.half
        slack += 1e-9 * (np.abs(q) @ (np.abs(self.low) + step * CELLS)) + 1
        return scores - slack[:, None], scores + slack[:, None]


def best_of_block(exact: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
                  read_rows: int = 64) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best other vectors of a block for every query."""
    lower, upper = Approximation(exact).bounds(queries)
    out = []
    for i, own in enumerate(query_ids):
        allowed = ids != own
        there = int(allowed.sum())
        if not there:
            continue
        want = min(k, there)
        limit = np.partition(np.where(allowed, lower[i], -np.inf), -want)[-want]
        left = np.flatnonzero(allowed & (upper[i] >= limit))
        left = left[np.argsort(-upper[i][left], kind="stable")]
        scores = np.empty(0, np.int64)
        read = 0
        while read < len(left):
            if read >= want and np.partition(scores, -want)[-want] > upper[i][left[read]]:
                break
            more = left[read : read + read_rows]
            scores = np.concatenate([scores, exact[more] @ queries[i]])
            read += len(more)
        seen = left[:read]
        first = np.lexsort((ids[seen], -scores))[:want]
        out.extend((int(own), int(ids[seen[j]]), int(scores[j])) for j in first)
    return out


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, query_rows: int = 1024,
          block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products, ties to the smaller vec_id.

    Both inputs are (vec_id, v) as `scaled` makes them. Only vectors of the query's length are
    candidates, and not those with the query's id. Repeated rows are candidates as often as they
    occur, and a repeated query is one query. Empty inputs give an empty result.
    """
    asked = packed(queries.dropDuplicates(["vec_id", "v"]), query_rows).select(
        "dim", F.col("ids").alias("qids"), F.col("exact").alias("q")
    )
    # Every block of vectors meets every block of queries, so copies of the queries are dealt out to
    # `salts` places, no more than there are blocks, and the vectors, which are moved once, are spread over them.
    salts = min(shuffle_width(queries.sparkSession), vectors.count() // block_rows + 1)
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = packed(vectors, block_rows).withColumn("salt", (F.col("block") % salts).cast("int"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for dim, ids, exact, qids, q in batch.itertuples(index=False):
                ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                exact = np.frombuffer(exact, np.int64).reshape(len(ids), dim)
                q = np.frombuffer(q, np.int64).reshape(len(qids), dim)
                out += best_of_block(exact, ids, q, qids, k)
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    # Spark judges `asked` by its size before it is copied, and would send all copies through the driver.
    pairs = held.join(dealt(asked), ["dim", "salt"]).select("dim", "ids", "exact", "qids", "q")
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
