"""Minimum spanning forest by Boruvka rounds.

Each round picks the lightest edge of every component (a group-by with map-side combine), merges
along the picks and renames the remaining edges, of which only the lightest per pair is kept. The
number of components at least halves per round. Names are looked up with joins
whose hot keys adaptive execution splits, since a hub may be an end of most edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.storage import Scratch, lookup


def spanning_forest(edges: DataFrame, scratch: Scratch, weight: str = "ceid") -> DataFrame:
    """Weights of the edges (c1, c2, weight) that form the lightest spanning forest.

    Weights are distinct and of any type with an order, so the forest is unique.
    """
    live, rest = scratch.write_counting(
        _lightest(edges.select(F.col("c1").alias("a"), F.col("c2").alias("b"), F.col(weight).alias("w"))),
        F.lit(True),
    )
    picked = []
    while rest:
        ends = F.array(
            F.struct(F.col("a").alias("node"), F.struct("w", F.col("b").alias("to")).alias("best")),
            F.struct(F.col("b").alias("node"), F.struct("w", F.col("a").alias("to")).alias("best")),
        )
        best, nodes = scratch.write_counting(
            live.select(F.explode(ends).alias("e"))
            .groupBy("e.node")
            .agg(F.min("e.best").alias("best"))
            .select("node", "best.w", "best.to"),
            F.lit(True),
        )
        picked.append(best.select("w"))
        renamed = live
        roots = _roots(best, nodes, scratch)
        for end in ("a", "b"):
            named = roots.select("node", F.col("root").alias(f"_{end}"))
            renamed = (
                lookup(renamed, named, end, "node", "inner")
                .drop(end)
                .withColumnRenamed(f"_{end}", end)
            )
        live, rest = scratch.write_counting(
            _lightest(renamed.where(F.col("a") != F.col("b"))), F.lit(True)
        )
    if not picked:
        return edges.select(weight).limit(0)
    return reduce(DataFrame.unionByName, picked).select(F.col("w").alias(weight)).distinct()


def _lightest(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        .groupBy("a", "b")
        .agg(F.min("w").alias("w"))
    )


def _roots(best: DataFrame, nodes: int, scratch: Scratch) -> DataFrame:
    """(node, root) of the trees that the picks form.

    The only cycles are pairs that picked the same edge; the smaller node of a pair is the root.
    """
    back = best.select("node", F.col("w").alias("_w"))
    met = lookup(best, back, "to", "node", "inner")
    is_root = (F.col("w") == F.col("_w")) & (F.col("node") < F.col("to"))
    tree = scratch.write(
        met.select("node", F.when(is_root, F.col("node")).otherwise(F.col("to")).alias("root"))
    )
    while True:
        up = tree.select("node", F.col("root").alias("_up"))
        jumped, moved = scratch.write_counting(
            lookup(tree, up, "root", "node", "inner").select(
                "node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")
            ),
            F.col("moved"),
        )
        tree = jumped.select("node", "root")
        if not moved:
            return tree
