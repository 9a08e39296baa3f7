"""Connected components of any graph: (id, label) with the smallest id as label.

Hook and shortcut on a shrinking graph: every node points to its smallest neighbour if that is
smaller, pointers are followed to their roots, edges are renamed to the roots and doubled edges fall
away. A node with very many edges is met by map-side combine and by salted lookups only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.storage import Scratch, dealt, lookup


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Labels of all nodes that occur in `edges` (two LONG columns, any direction, repeats allowed)."""
    named = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    pairs = scratch.write(_distinct(named))
    alone = pairs.where(F.col("a") == F.col("b")).select(F.col("a").alias("id"))
    live = pairs.where(F.col("a") != F.col("b"))
    maps = []
    while not live.isEmpty():
        both = F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("other")),
        )
        tree = scratch.write(
            live.select(F.explode(both).alias("e"))
            .groupBy("e.node")
            .agg(F.min("e.other").alias("other"))
            .select("node", F.least("node", "other").alias("root"))
        )
        nodes = tree.count()
        tree = _follow(tree, nodes, scratch)
        maps.append((tree, nodes))
        renamed = live
        for end in ("a", "b"):
            to = tree.select("node", F.col("root").alias(f"_{end}"))
            renamed = (
                lookup(renamed, to, end, "node", "inner")
                .drop(end)
                .withColumnRenamed(f"_{end}", end)
            )
        live = scratch.write(_distinct(renamed.where(F.col("a") != F.col("b"))))
    if not maps:
        return alone.select("id", F.col("id").alias("label"))
    labels = maps[0][0].select(F.col("node").alias("id"), F.col("root").alias("label"))
    for tree, nodes in maps[1:]:
        up = tree.select("node", F.col("root").alias("_up"))
        labels = lookup(labels, up, "label", "node", "left").select(
            "id", F.coalesce("_up", "label").alias("label")
        )
    loners = alone.join(dealt(labels.select("id")), "id", "left_anti")
    return labels.unionByName(loners.select("id", F.col("id").alias("label")))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _follow(tree: DataFrame, nodes: int, scratch: Scratch) -> DataFrame:
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


def degree_two_components(vertices: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) for vertices (vid, n1, n2) with NULL for a missing neighbour."""
    ends = F.explode(F.array(F.coalesce("n1", "vid"), F.coalesce("n2", "vid")))
    return connected_components(vertices.select(F.col("vid").alias("a"), ends.alias("b")), scratch)
