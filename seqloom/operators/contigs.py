"""Contigs: the base strings along the paths of the successor graph.

A contig may be longer than a row should be, so it is kept as numbered parts of bounded length.
Cycles have no start and are contigs of their own: `cycle_parts` begins each at its least rotation, so
a circular sequence is the same text whatever its edges are numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import encoding as enc
from seqloom.operators.scan import dense_index
from seqloom.storage import Scratch, dealt

PART_EDGES = 4096


def contig_parts(
    chains: DataFrame, edges: DataFrame, length: int, part_edges: int = PART_EDGES
) -> DataFrame:
    """(contig, part, seq): the first edge gives its whole word, each later one its last base.

    `chains` has (id, head, rank, is_cycle), `edges` has (eid, lmer). A group holds at most
    `part_edges` rows.
    """
    path = chains.where(~F.col("is_cycle")).select("id", "head", "rank")
    met = path.join(dealt(edges.select(F.col("eid").alias("id"), "lmer")), "id")
    text = F.when(F.col("rank") == 0, enc.decode_word(F.col("lmer"), length)).otherwise(
        enc.decode_base(enc.last_base(F.col("lmer")))
    )
    part = F.floor(F.col("rank") / part_edges).cast("long")
    rows = met.select(F.col("head").alias("contig"), part.alias("part"), "rank", text.alias("text"))
    return rows.groupBy("contig", "part").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), ""
        ).alias("seq")
    )


def contig_lengths(chains: DataFrame, length: int) -> DataFrame:
    """(contig, edges, bases) per path."""
    return (
        chains.where(~F.col("is_cycle"))
        .groupBy(F.col("head").alias("contig"))
        .agg(F.count(F.lit(1)).alias("edges"))
        .select("contig", "edges", (F.col("edges") + (length - 1)).alias("bases"))
    )


def cycle_starts(chains: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, head, rank, size, base, start): edges of cycles with the rank at which the least rotation begins.

    `base` is the last base of an edge; `size` bases in a row are the cycle. Ranks of texts of length
    1, 2, 4, ... from every place on come from those of half the length by doubling, all cycles at
    once, until they are as long as the longest cycle. A cycle that is shorter than the ranked length
    is read round several times, which does not change which rotation is least. Of equal rotations
    (of a repeating cycle) the one with the smallest rank begins.
    """
    ring = chains.where("is_cycle").select("id", "head", "rank")
    base = edges.select(F.col("eid").alias("id"), enc.last_base(F.col("lmer")).cast("long").alias("base"))
    sizes = ring.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
    ring = scratch.write(ring.join(dealt(base), "id").join(dealt(sizes), "head"))
    longest = ring.agg(F.max("size")).first()[0] or 0
    state = ring.withColumn("key", F.col("base"))
    have = 1
    while have < longest:
        # The place `have` further on tells its key to this one.
        told = state.select(
            "head", F.pmod(F.col("rank") - F.lit(have), F.col("size")).alias("rank"), F.col("key").alias("more")
        )
        pairs = scratch.write(state.join(dealt(told), ["head", "rank"]))
        kinds = scratch.write(pairs.select("key", "more").distinct())
        order = dense_index(kinds, ["key", "more"], out="next")
        state = scratch.write(
            pairs.join(dealt(order), ["key", "more"]).drop("key", "more").withColumnRenamed("next", "key")
        )
        have *= 2
    first = state.groupBy("head").agg(F.min(F.struct("key", "rank"))["rank"].alias("start"))
    return state.drop("key").join(dealt(first), "head")


def cycle_parts(chains: DataFrame, edges: DataFrame, scratch: Scratch, part_edges: int = PART_EDGES) -> DataFrame:
    """(contig, part, seq, bases): cycles of bases as parts in the order of their least rotation.

    A contig is named by the edge it begins with, `bases` is the length of the whole cycle.
    """
    placed = cycle_starts(chains, edges, scratch)
    at = F.pmod(F.col("rank") - F.col("start"), F.col("size"))
    names = placed.where("rank = start").select("head", F.col("id").alias("contig"))
    rows = placed.join(dealt(names), "head").select(
        "contig", F.floor(at / part_edges).cast("long").alias("part"), at.alias("at"),
        enc.decode_base(F.col("base")).alias("text"), F.col("size").alias("bases"),
    )
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return rows.groupBy("contig", "part", "bases").agg(F.array_join(pieces, "").alias("seq")).select(
        "contig", "part", "seq", "bases"
    )
