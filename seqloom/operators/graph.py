"""De Bruijn multigraph from counted words.

Everything up to the edges works on distinct words, never on single copies. With words numbered in
unsigned order, the edges leaving a vertex are one contiguous range of edge ids, and the edges
entering it are at most four ranges. Pairing, list positions and neighbours are therefore arithmetic
on ranges; copies are unrolled last. A word that makes up a third of all windows is one row here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import encoding as enc
from seqloom.operators.scan import repeat_rows, scan_columns
from seqloom.operators.words import split_words
from seqloom.storage import Scratch, dealt


@dataclass
class Graph:
    """Stage tables of one graph. `length` is the word (edge) length; vertices are one shorter.

    Slots, arcs and vertex numbers are made on first use only; pairing goes without numbers, and what
    needs one pass over the words alone goes without slots.
    """

    length: int
    words: DataFrame  # lmer, cnt, eid0
    scratch: Scratch

    @cached_property
    def slots(self) -> DataFrame:
        """One row per vertex, see vertex_slots."""
        return self.scratch.write(vertex_slots(self.words, self.length), keep=True)

    @cached_property
    def vertices(self) -> DataFrame:
        """vidx, kmer, ecount, lcount, ep, lp and the columns of the slots."""
        return self.scratch.write(index_vertices(self.slots, self.length), keep=True)

    @cached_property
    def arcs(self) -> DataFrame:
        """One row per distinct word with its ranges, see build_arcs."""
        return self.scratch.write(build_arcs(self.words, self.slots, self.length), keep=True)

    def numbered_arcs(self) -> DataFrame:
        """Arcs with the vertex numbers v1 and v2."""
        number = self.vertices.select("kmer", "vidx")
        k1, k2 = number.toDF("prefix", "v1"), number.toDF("suffix", "v2")
        return self.arcs.join(dealt(k1), "prefix").join(dealt(k2), "suffix")


def index_words(counts: DataFrame, length: int) -> DataFrame:
    """(lmer, cnt, eid0): eid0 is the number of edges before this word in unsigned order."""
    keyed = counts.select(
        "lmer", "cnt", enc.unsigned_order(F.col("lmer"), length).alias("_key")
    )
    return scan_columns(keyed, {"eid0": "cnt"}, ["_key"]).select("lmer", "cnt", "eid0")


def vertex_base_counts(counts: DataFrame, length: int) -> DataFrame:
    """(kmer, lc0..lc3, ec0..ec3): leaving and entering multiplicity per base."""
    return vertex_slots(counts.withColumn("eid0", F.lit(None).cast("long")), length).select(
        "kmer", *[f"lc{b}" for b in range(4)], *[f"ec{b}" for b in range(4)]
    )


def vertex_slots(words: DataFrame, length: int) -> DataFrame:
    """(kmer, lc0..lc3, ec0..ec3, ee0..ee3, lstart): what meets at each vertex.

    lc and ec are leaving and entering multiplicities per base, ee the first edge of each entering
    range and lstart the first leaving edge. At most eight words meet at a vertex.
    """
    split = split_words(words, length)
    ends = F.array(
        F.struct(F.col("prefix").alias("kmer"), F.col("last_base").alias("slot")),
        F.struct(F.col("suffix").alias("kmer"), (F.col("first_base") + 4).alias("slot")),
    )
    rows = split.select("cnt", "eid0", F.explode(ends).alias("_e")).select("cnt", "eid0", "_e.*")
    # Dealt out as they are: a vertex in the making has thirteen numbers, and hardly two of its words are in one task.
    rows = rows.repartition("kmer")
    slot = F.col("slot")
    count = [
        F.coalesce(F.max(F.when(slot == i, F.col("cnt"))), F.lit(0)).cast("long") for i in range(8)
    ]
    first = [F.max(F.when(slot == i, F.col("eid0"))) for i in range(4, 8)]
    return rows.groupBy("kmer").agg(
        *[count[b].alias(f"lc{b}") for b in range(4)],
        *[count[b + 4].alias(f"ec{b}") for b in range(4)],
        *[first[b].alias(f"ee{b}") for b in range(4)],
        F.min(F.when(slot < 4, F.col("eid0"))).alias("lstart"),
    )


def _total(side: str) -> Column:
    return sum((F.col(f"{side}{b}") for b in range(1, 4)), F.col(f"{side}0"))


def index_vertices(slots: DataFrame, length: int) -> DataFrame:
    """Vertex table: dense index in unsigned k-mer order, degrees and list offsets."""
    wide = (
        slots.withColumn("ecount", _total("ec"))
        .withColumn("lcount", _total("lc"))
        .withColumn("_one", F.lit(1).cast("long"))
        .withColumn("_key", enc.unsigned_order(F.col("kmer"), length - 1))
    )
    numbered = scan_columns(wide, {"vidx": "_one", "ep": "ecount", "lp": "lcount"}, ["_key"])
    return numbered.drop("_one", "_key")


def build_arcs(words: DataFrame, slots: DataFrame, length: int) -> DataFrame:
    """One row per distinct word, describing all of its copies by ranges.

    Copy i of a word has edge id eid0 + i. As the edge enters its head vertex at list position
    p0 + i, its successor is lstart2 + p0 + i while i < slen. `q0` is its first position in the
    leaving list of its tail vertex, and pc0..pc3 / pe0..pe3 are the sizes and first ids of the
    ranges entering there, from which the predecessor follows. `nx_last` is the edge after the last
    copy in the entering list of the head vertex.
    """
    split = split_words(words, length)
    head = slots.select(
        F.col("kmer").alias("_k2"),
        F.col("lstart").alias("lstart2"),
        _total("lc").alias("lcount2"),
        *[F.col(f"ec{b}").alias(f"_c{b}") for b in range(4)],
        *[F.col(f"ee{b}").alias(f"_n{b}") for b in range(4)],
    )
    tail = slots.select(
        F.col("kmer").alias("_k1"),
        F.col("lstart").alias("lstart1"),
        *[F.col(f"ec{b}").alias(f"pc{b}") for b in range(4)],
        *[F.col(f"ee{b}").alias(f"pe{b}") for b in range(4)],
    )
    base = F.col("first_base")
    offset: Column = F.lit(0).cast("long")
    following: Column = F.lit(None).cast("long")
    for b in range(1, 4):
        before = sum((F.col(f"_c{j}") for j in range(1, b)), F.col("_c0"))
        offset = F.when(base == b, before).otherwise(offset)
    for b in range(3):
        after = F.coalesce(*[F.col(f"_n{j}") for j in range(b + 1, 4)])
        following = F.when(base == b, after).otherwise(following)
    joined = split.join(dealt(head), split.suffix == head._k2).join(dealt(tail), split.prefix == tail._k1)
    return joined.select(
        "lmer", "cnt", "eid0", "prefix", "suffix",
        offset.alias("p0"),
        "lstart2",
        F.greatest(F.least(F.col("lcount2") - offset, F.col("cnt")), F.lit(0)).alias("slen"),
        following.alias("nx_last"),
        (F.col("eid0") - F.col("lstart1")).alias("q0"),
        *[f"pc{b}" for b in range(4)],
        *[f"pe{b}" for b in range(4)],
    )


def build_graph(counts: DataFrame, length: int, scratch: Scratch) -> Graph:
    stored = scratch.write(counts.select("lmer", "cnt"))
    words = scratch.write(index_words(stored, length), keep=True)
    scratch.drop(stored)
    return Graph(length, words, scratch)


def unroll(arcs: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows for every copy (column `copy`) of every word, spread evenly before they multiply."""
    return repeat_rows(arcs, "cnt", ["eid0"]).select(*columns)


def edge_id() -> Column:
    return F.col("eid0") + F.col("copy")


def successor() -> Column:
    """The edge at the same position of the leaving list of the head vertex, or NULL."""
    return F.when(F.col("copy") < F.col("slen"), F.col("lstart2") + F.col("p0") + F.col("copy"))


def predecessor() -> Column:
    """The edge at the same position of the entering list of the tail vertex, or NULL."""
    at = F.col("q0") + F.col("copy")
    found: Column = F.lit(None).cast("long")
    for b in range(3, -1, -1):
        before = sum((F.col(f"pc{j}") for j in range(b)), F.lit(0))
        found = F.when(
            (at >= before) & (at < before + F.col(f"pc{b}")), F.col(f"pe{b}") + at - before
        ).otherwise(found)
    return found


def next_entering() -> Column:
    """The following edge in the entering list of the head vertex, or NULL."""
    return F.when(F.col("copy") < F.col("cnt") - 1, edge_id() + 1).otherwise(F.col("nx_last"))


def edges(graph: Graph) -> DataFrame:
    """(eid, v1, v2, s, lmer, copy): every edge with its vertices and its paired successor."""
    return unroll(
        graph.numbered_arcs(), edge_id().alias("eid"), "v1", "v2", successor().alias("s"), "lmer", "copy"
    )


def paired_edges(graph: Graph) -> DataFrame:
    """(eid, v2, s) without vertex numbers or arcs: v2 is the packed k-mer of the head vertex."""
    copies = repeat_rows(successor_ranges(graph), "size", ["e"])
    at = F.col("copy")
    return copies.select((F.col("e") + at).alias("eid"), F.col("kmer").alias("v2"), (F.col("l") + at).alias("s"))


def edge_ranges(graph: Graph) -> DataFrame:
    """(eid0, cnt, v1, v2, s0, slen): all edges, copies of a word as one range (see `checks.as_ranges`)."""
    return graph.numbered_arcs().select("eid0", "cnt", "v1", "v2", (F.col("lstart2") + F.col("p0")).alias("s0"), "slen")


def euler_vertices(graph: Graph) -> DataFrame:
    return graph.vertices.select("vidx", F.col("kmer").alias("vid"), "ep", "ecount", "lp", "lcount")


def leaving_list(graph: Graph) -> DataFrame:
    """(vidx, pos, eid): position inside the vertex; ids ascend with the position."""
    return unroll(
        graph.numbered_arcs(), F.col("v1").alias("vidx"), (F.col("q0") + F.col("copy")).alias("pos"),
        edge_id().alias("eid"),
    )


def entering_list(graph: Graph) -> DataFrame:
    return unroll(
        graph.numbered_arcs(), F.col("v2").alias("vidx"), (F.col("p0") + F.col("copy")).alias("pos"),
        edge_id().alias("eid"),
    )


def vertex_class(vertices: DataFrame) -> DataFrame:
    """Sink when more edges enter than leave, source when fewer."""
    e, lv = F.col("ecount"), F.col("lcount")
    kind = F.when(e > lv, "sink").when(e < lv, "source").otherwise("balanced")
    return vertices.select("vidx", F.col("kmer").alias("vid"), "ecount", "lcount", kind.alias("class"))


def successor_links(graph: Graph) -> DataFrame:
    """(id, prv, nxt) of the successor graph: chains and cycles of edges."""
    return unroll(
        graph.arcs, edge_id().alias("id"), predecessor().alias("prv"), successor().alias("nxt")
    )


def pair_ranges(graph: Graph) -> DataFrame:
    """(e, l, size): entering edges e + i are followed by leaving edges l + i, i < size; up to four rows per vertex.

    They come from the slots as they are made, without a row per word or copy.
    """
    slots = vertex_slots(graph.words, graph.length)
    leaving = _total("lc")
    ranges = []
    for b in range(4):
        before: Column = sum((F.col(f"ec{j}") for j in range(b)), F.lit(0).cast("long"))
        size = F.greatest(F.least(leaving - before, F.col(f"ec{b}")), F.lit(0))
        ranges.append(F.struct(F.col(f"ee{b}").alias("e"), (F.col("lstart") + before).alias("l"), size.alias("size")))
    made = slots.select(F.explode(F.array(*ranges)).alias("_r")).select("_r.*")
    return made.where("size > 0")


def successor_ranges(graph: Graph) -> DataFrame:
    """(kmer, e, l, size): edges e + i that enter a vertex are followed by l + i, i < size, and by none if l is NULL.

    Every edge is in one range; a vertex has up to eight.
    """
    slots = vertex_slots(graph.words, graph.length)
    leaving = _total("lc")
    ranges = []
    for b in range(4):
        before: Column = sum((F.col(f"ec{j}") for j in range(b)), F.lit(0).cast("long"))
        size = F.greatest(F.least(leaving - before, F.col(f"ec{b}")), F.lit(0))
        ranges.append(F.struct(F.col(f"ee{b}").alias("e"), (F.col("lstart") + before).alias("l"), size.alias("size")))
        rest = F.struct((F.col(f"ee{b}") + size).alias("e"), F.lit(None).cast("long").alias("l"), (F.col(f"ec{b}") - size).alias("size"))
        ranges.append(rest)
    made = slots.select("kmer", F.explode(F.array(*ranges)).alias("_r")).select("kmer", "_r.*")
    return made.where("size > 0")


def entering_ranges(graph: Graph) -> DataFrame:
    """(e, cnt, nx, later): words as ranges of edges that enter a vertex, up to four rows per vertex.

    `nx` is the first edge of the next range there, or NULL, `later` tells that another range comes before.
    """
    slots = vertex_slots(graph.words, graph.length)
    ranges = []
    for b in range(4):
        after = [F.col(f"ee{j}") for j in range(b + 1, 4)]
        ranges.append(F.struct(
            F.col(f"ee{b}").alias("e"), F.col(f"ec{b}").alias("cnt"),
            (F.coalesce(*after) if after else F.lit(None).cast("long")).alias("nx"),
            sum((F.col(f"ec{j}") for j in range(b)), F.lit(0)).cast("boolean").alias("later"),
        ))
    made = slots.select(F.explode(F.array(*ranges)).alias("_r")).select("_r.*")
    return made.where("cnt > 0")


def link_blocks(graph: Graph, size: int) -> DataFrame:
    """(block, sum_s, sum_p, paired) per `size` edge ids: sums of successors and of predecessors, edges with a successor.

    Ranges of pairs are cut at the ends of blocks, and a piece adds its sum in closed form.
    """
    pairs = pair_ranges(graph)
    none = F.lit(None).cast("long")
    way = lambda at, other: F.struct(F.col(at).alias("at"), F.col(other).alias("to"), F.lit(at == "e").alias("onward"))
    rows = pairs.select("size", F.explode(F.array(way("e", "l"), way("l", "e"))).alias("_w")).select("size", "_w.*")
    blocks = F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + size - 1) div {size}"))
    rows = rows.withColumn("block", F.explode(blocks))
    first = F.greatest(F.col("at"), F.col("block") * size)
    n = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * size) - first
    rows = rows.select("block", "onward", n.alias("n"), (F.col("to") + first - F.col("at")).alias("to"))
    rows = rows.select("block", "onward", "n", F.expr("n * to + n * (n - 1) div 2").alias("sum"))
    total = graph.words.agg(F.sum("cnt")).first()[0] or 0
    every = graph.words.sparkSession.range(-(-total // size)).select(
        F.col("id").alias("block"), F.lit(True).alias("onward"), F.lit(0).cast("long").alias("n"), none.alias("sum")
    )
    onward = F.col("onward")
    return rows.unionByName(every).groupBy("block").agg(
        F.sum(F.when(onward, F.col("sum"))).alias("sum_s"),
        F.sum(F.when(~onward, F.col("sum"))).alias("sum_p"),
        F.sum(F.when(onward, F.col("n")).otherwise(F.lit(0))).alias("paired"),
    )


def unpaired_starts(graph: Graph) -> DataFrame:
    """Edges without a predecessor: at a vertex these are the leaving edges behind the last entering one,
    one range of ids. Only the sums of both sides and the first leaving edge meet at a vertex."""
    split = split_words(graph.words, graph.length)
    zero, cnt = F.lit(0).cast("long"), F.col("cnt")
    ends = F.array(
        F.struct(F.col("prefix").alias("kmer"), cnt.alias("l"), zero.alias("e"), F.col("eid0").alias("first")),
        F.struct(F.col("suffix").alias("kmer"), zero.alias("l"), cnt.alias("e"), F.lit(None).cast("long").alias("first")),
    )
    met = split.select(F.explode(ends).alias("_e")).select("_e.*").groupBy("kmer").agg(
        F.sum("l").alias("l"), F.sum("e").alias("e"), F.min("first").alias("first")
    )
    rest = met.where("l > e").select((F.col("first") + F.col("e")).alias("eid0"), (F.col("l") - F.col("e")).alias("cnt"))
    return unroll(rest, edge_id().alias("eid"))


def contig_starts(links: DataFrame) -> DataFrame:
    """Edges that no edge points to."""
    return links.where(F.col("prv").isNull()).select(F.col("id").alias("eid"))
