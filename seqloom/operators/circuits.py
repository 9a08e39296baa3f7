"""Circuit graph: components of the successor graph and the places where two of them touch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import graph as g
from seqloom.operators.scan import dense_index
from seqloom.storage import Scratch, dealt

# Edge ids of a block; the circuits of a block are met by a task at once.
BLOCK = 1 << 16


def circuit_vertices(chains: DataFrame) -> DataFrame:
    """(circuit, label): one row per component. The node whose id is the label stands for it."""
    return chains.where(F.col("id") == F.col("label")).select("circuit", "label")


def touching_pairs(graph: g.Graph, chains: DataFrame, scratch: Scratch) -> DataFrame:
    """(c1, c2, e1, e2) for neighbours in an entering list that lie in different circuits.

    Copies of a word are neighbours, and their ids are in a row. So the circuits of all edges are dealt out once, by
    blocks of ids, and only the last copy of a word looks for an edge elsewhere, the first copy of another word.
    The result reads tables of `scratch` that are kept.
    """
    block = lambda c: F.expr(f"{c} div {BLOCK}")
    # The first edge of a block is also the neighbour of the last one of the block before.
    twice = F.when(F.expr(f"id > 0 AND id % {BLOCK} = 0"), F.array(block("id"), block("id") - 1))
    names = chains.select("id", "circuit", F.explode(F.coalesce(twice, F.array(block("id")))).alias("block"))
    ends = F.array(
        F.struct((F.col("e") + F.col("cnt") - 1).alias("id"), F.coalesce("nx", F.lit(-1)).alias("nx"), F.lit(False).alias("first")),
        F.struct(F.col("e").alias("id"), F.lit(-1).cast("long").alias("nx"), F.lit(True).alias("first")),
    )
    ends = g.entering_ranges(graph).select("later", F.explode(ends).alias("_e")).select("later", "_e.*")
    ends = ends.where("NOT first OR later").select("id", "nx", "first", block("id").alias("block"))

    def meet(names: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        low = int(names["block"].iloc[0]) * BLOCK
        circuit = np.full(BLOCK + 1, -1, np.int64)
        circuit[names["id"].to_numpy(np.int64) - low] = names["circuit"].to_numpy(np.int64)
        at, nx, first = ends["id"].to_numpy(np.int64) - low, ends["nx"].to_numpy(np.int64), ends["first"].to_numpy(bool)
        last = np.zeros(BLOCK, bool)
        last[at[~first]] = True
        inner = np.flatnonzero((circuit[:-1] >= 0) & ~last & (circuit[:-1] != circuit[1:]))
        away, asked = ~first & (nx >= 0), at[first]
        none = lambda n: np.full(n, -1, np.int64)
        return pd.DataFrame({
            "e1": np.concatenate([inner + low, at[away] + low, none(len(asked))]),
            "e2": np.concatenate([inner + low + 1, nx[away], asked + low]),
            "a": np.concatenate([circuit[inner], circuit[at[away]], none(len(asked))]),
            "b": np.concatenate([circuit[inner + 1], none(away.sum()), circuit[asked]]),
        })

    met = names.groupBy("block").cogroup(ends.groupBy("block")).applyInPandas(meet, "e1 long, e2 long, a long, b long")
    met = scratch.write(met, keep=True)
    asked = met.where("e1 < 0").select("e2", F.col("b").alias("_b"))
    far = met.where("b < 0").drop("b").join(dealt(asked), "e2").where(F.col("a") != F.col("_b"))
    far = scratch.write(far.select("e1", "e2", "a", F.col("_b").alias("b")), keep=True)
    return met.where("e1 >= 0 AND b >= 0").unionByName(far).select(
        F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2"), "e1", "e2"
    )


def first_touch(pairs: DataFrame) -> DataFrame:
    """(c1, c2, pick): the first edge of each pair of circuits, pick = (c1, c2, e1, e2).

    Ordered by `pick`, these are the only edges a lightest spanning forest can use, and they order
    like their `ceid`; the forest can be found without numbering all parallel edges.
    """
    first = pairs.groupBy("c1", "c2").agg(F.min(F.struct("e1", "e2")).alias("_e"))
    return first.select("c1", "c2", F.struct("c1", "c2", "_e.e1", "_e.e2").alias("pick"))


def circuit_edges(pairs: DataFrame) -> DataFrame:
    """(ceid, c1, c2, e1, e2): parallel edges are kept; ceid is the rank by (c1, c2, e1, e2)."""
    return dense_index(pairs, ["c1", "c2", "e1", "e2"], out="ceid").select(
        "ceid", "c1", "c2", "e1", "e2"
    )


def circuit_edge_counts(pairs: DataFrame) -> DataFrame:
    """(circuit, edges): edges counted at the smaller of their two circuits."""
    return pairs.groupBy(F.col("c1").alias("circuit")).agg(F.count(F.lit(1)).alias("edges"))
