"""Connected components of link tables by contraction, state written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.storage import Scratch


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every end of a link; label is the smallest node reachable.

    Each round every node points to the neighbour (or itself) that comes first in a hashed order,
    pointers are followed once more, and links are renamed to what they point to. In a hashed order
    a fixed share of the names goes in each round on chains as well, and a star of any size goes in
    one. Groups are only reduced by min, and joins have a unique side, so a hub is no hot task.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "links")
    nobody = F.col("u") != F.col("v")
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(nobody)
    ends = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges, left = scratch.write_counting(ends, F.lit(True))
    names = scratch.write(edges.select(F.col("u").alias("node"), F.col("u").alias("name")).distinct())
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    while left:
        first = edges.groupBy("u").agg(F.min(order("v")).alias("m"))
        first = scratch.write(first.select("u", F.least("m", order("u"))["id"].alias("to")))
        onward = first.select(F.col("u").alias("to"), F.col("to").alias("then"))
        to = scratch.write(first.join(onward, "to").select("u", F.col("then").alias("to")))
        there = to.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        renamed = (
            edges.join(to, "u").join(there, "v")
            .filter(F.col("to") != F.col("to_v"))
            .select(F.col("to").alias("u"), F.col("to_v").alias("v"))
            .distinct()
        )
        edges, left = scratch.write_counting(renamed, F.lit(True))
        names = scratch.write(
            names.join(to.withColumnRenamed("u", "name"), "name", "left").select(
                "node", F.coalesce("to", "name").alias("name")
            )
        )
    smallest = names.groupBy("name").agg(F.min("node").alias("label"))
    done = Scratch(spark, "components").write(names.join(smallest, "name").select("node", "label"), keep=True)
    scratch.drop_all()
    return done
