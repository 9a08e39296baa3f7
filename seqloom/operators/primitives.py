"""Compaction, sorting, reduction, random numbers and list ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.chains import trace_chains
from seqloom.operators.scan import dense_index
from seqloom.storage import Scratch


def compact(
    df: DataFrame, valid: str, order_by: Sequence[str], backward: bool = False, out: str = "idx"
) -> DataFrame:
    """Rows whose flag is 1, numbered by their place in the compacted array."""
    kept = df.where(F.col(valid) == 1)
    numbered = dense_index(kept, order_by, out=out)
    if not backward:
        return numbered
    return numbered.withColumn(out, F.lit(kept.count() - 1) - F.col(out))


def sort(df: DataFrame, keys: Sequence[str], descending: bool = False) -> DataFrame:
    """Global sort by key columns (numbers or strings); values travel along."""
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys])


def sort_positions(df: DataFrame, keys: Sequence[str], out: str = "idx") -> DataFrame:
    """The place of each row in the sorted order, without moving everything into one task."""
    return dense_index(df, keys, out=out)


def reduce_column(df: DataFrame, value: str) -> DataFrame:
    """(add, multiply, min, max) of one column; multiply works in DOUBLE."""
    col = F.col(value)
    return df.agg(
        F.sum(col).alias("add"),
        F.product(col).alias("multiply"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )


def random_words(df: DataFrame, index: str, seed: int) -> DataFrame:
    """(index, r0..r3): four unsigned 32-bit numbers per index from the MD5 of seed and index.

    The numbers depend on nothing but seed and index, so a lost task makes the same ones again.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(index).cast("string")).cast("binary"))
    parts = [
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"r{i}")
        for i in range(4)
    ]
    return df.select(F.col(index), *parts)


def list_rank(df: DataFrame, node: str, following: str, scratch: Scratch) -> DataFrame:
    """(id, head, rank) for lists given by the next node of each node, NULL at the end.

    Nodes on cycles have no head and are left out.
    """
    nxt = df.select(F.col(node).cast("long").alias("id"), F.col(following).cast("long").alias("nxt"))
    back = nxt.where(F.col("nxt").isNotNull()).select(
        F.col("nxt").alias("_n"), F.col("id").alias("prv")
    )
    links = nxt.join(back, nxt.id == back._n, "left").select("id", "prv", "nxt")
    traced = trace_chains(links, scratch, ("id", "head", "rank", "is_cycle"))
    return traced.where(~F.col("is_cycle")).select("id", "head", "rank")
