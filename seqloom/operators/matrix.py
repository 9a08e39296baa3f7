"""Sparse matrix times vector and tridiagonal systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.storage import Scratch, lookup


def spmv(
    matrix: DataFrame, vector: DataFrame, row: str, col: str, value: str, vcol: str, vvalue: str
) -> DataFrame:
    """(row, y): y = sum over columns of value * x. Entries with the same place add up.

    The vector is looked up by column, which may be hot, and products are summed before they are
    shuffled by row.
    """
    side = vector.select(F.col(vcol).alias("_c"), F.col(vvalue).alias("_x"))
    entries = matrix.select(F.col(row).alias("row"), F.col(col).alias("_col"), F.col(value).alias("_a"))
    met = lookup(entries, side, "_col", "_c", "inner")
    return met.groupBy("row").agg(F.sum(F.col("_a") * F.col("_x")).alias("y"))


def solve_tridiagonal(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(system, i, x) for many systems given as rows (system, i, a, b, c, d).

    Row i of a system reads a*x[i-1] + b*x[i] + c*x[i+1] = d. Cyclic reduction: each round rewrites
    every row with the rows `step` before and after it and doubles `step`, until no row has a
    neighbour left. A system of any size spreads over tasks, since rows meet by (system, i).
    The matrix should be diagonally dominant, as for any reduction without pivoting.
    """
    state = scratch.write(df.select("system", "i", *[F.col(n).cast("double") for n in "abcd"]))
    span = state.groupBy("system").agg((F.max("i") - F.min("i")).alias("n")).agg(F.max("n")).first()[0]
    step = 1
    while span is not None and step <= span:
        mine = lambda n: F.when(F.col("_to") == 0, F.col(n))
        before = lambda n: F.when(F.col("_to") == 1, F.col(n))
        after = lambda n: F.when(F.col("_to") == -1, F.col(n))
        sent = state.withColumn("_to", F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1))))
        sent = sent.withColumn("i", F.col("i") + F.col("_to") * step)
        met = sent.groupBy("system", "i").agg(
            *[F.max(mine(n)).alias(n) for n in "abcd"],
            *[F.max(before(n)).alias(f"p{n}") for n in "abcd"],
            *[F.max(after(n)).alias(f"q{n}") for n in "abcd"],
        )
        zero = F.lit(0.0)
        down = F.coalesce(-F.col("a") / F.col("pb"), zero)
        up = F.coalesce(-F.col("c") / F.col("qb"), zero)
        part = lambda w, n: w * F.coalesce(F.col(n), zero)
        state = scratch.write(
            met.where(F.col("b").isNotNull()).select(
                "system", "i",
                part(down, "pa").alias("a"),
                (F.col("b") + part(down, "pc") + part(up, "qa")).alias("b"),
                part(up, "qc").alias("c"),
                (F.col("d") + part(down, "pd") + part(up, "qd")).alias("d"),
            )
        )
        step *= 2
    return state.select("system", "i", (F.col("d") / F.col("b")).alias("x"))
