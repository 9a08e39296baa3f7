"""Text sinks: FASTA contigs, graph dumps in long and DOT form, successor and circuit graphs.

Line order is kept over part files by a range partitioning, so the files read in name order are one
document. The frame lines of a DOT document are rows as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import encoding as enc
from seqloom.operators import graph as g
from seqloom.storage import lookup


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (section, key, line) in the order of section and key."""
    ordered = lines.repartitionByRange("section", "key").sortWithinPartitions("section", "key", "line")
    ordered.select("line").write.mode("overwrite").text(path)


def _line(df: DataFrame, section: int, key, text) -> DataFrame:
    return df.select(F.lit(section).alias("section"), key.cast("long").alias("key"), text.alias("line"))


def _framed(body: DataFrame, head: str) -> DataFrame:
    spark = body.sparkSession
    frame = spark.createDataFrame(
        [(0, 0, head), (9, 0, "}")], "section int, key long, line string"
    )
    return body.unionByName(frame)


def fasta_lines(parts: DataFrame) -> DataFrame:
    """(section, key, line): a header before the first part of a contig, then one line per part."""
    text = F.when(
        F.col("part") == 0, F.concat(F.lit(">contig_"), F.col("contig"), F.lit("\n"), F.col("seq"))
    ).otherwise(F.col("seq"))
    return parts.select(F.col("contig").alias("section"), F.col("part").alias("key"), text.alias("line"))


def write_fasta(parts: DataFrame, path: str) -> None:
    write_lines(fasta_lines(parts), path)


def debruijn_dot(graph: g.Graph) -> DataFrame:
    """One line `v1 -> v2 [label=base]` per edge, in edge order."""
    k = graph.length - 1
    rows = g.unroll(graph.arcs, "lmer", g.edge_id().alias("eid"))
    text = F.format_string(
        "\t%s -> %s [label=%s]",
        enc.decode_word(enc.prefix_word(F.col("lmer"), graph.length), k),
        enc.decode_word(enc.suffix_word(F.col("lmer"), graph.length), k),
        enc.decode_base(enc.last_base(F.col("lmer"))),
    )
    return _framed(_line(rows, 1, F.col("eid"), text), "digraph G {")


def debruijn_long(graph: g.Graph) -> DataFrame:
    """Vertices, entering list, leaving list and edges, one row each, in that order."""
    v = g.euler_vertices(graph)
    vertices = _line(
        v, 1, F.col("vidx"),
        F.format_string(
            "[%d]:vid[%s], ep[%d], eend[%d], lp[%d], lend[%d]",
            "vidx", F.expr("conv(hex(vid), 16, 10)"), "ep", "ecount", "lp", "lcount",
        ),
    )
    lists = []
    for section, name, fn, base in ((2, "e", g.entering_list, "ep"), (3, "l", g.leaving_list, "lp")):
        rows = lookup(fn(graph), v.select("vidx", base), "vidx", "vidx", "inner")
        at = F.col(base) + F.col("pos")
        lists.append(_line(rows, section, at, F.format_string(f"{name}[%d]: %d", at, "eid")))
    edges = _line(
        g.edges(graph), 4, F.col("eid"),
        F.format_string(
            "[%d]: v1[%d], v2[%d], s[%s]", "eid", "v1", "v2", F.coalesce(F.col("s").cast("string"), F.lit("-"))
        ),
    )
    return vertices.unionByName(lists[0]).unionByName(lists[1]).unionByName(edges)


def dump_graph(graph: g.Graph, path: str, format: str = "long") -> None:
    write_lines({"long": debruijn_long, "dot": debruijn_dot}[format](graph), path)


def successor_dot(links: DataFrame) -> DataFrame:
    """Undirected lines to the successor and to the predecessor of each edge."""
    ends = links.select("id", F.explode(F.array("nxt", "prv")).alias("to")).where("to is not null")
    return _framed(_line(ends, 1, F.col("id"), F.format_string("\t%d -- %d", "id", "to")), "graph G {")


def circuit_dot(circuit_edges: DataFrame) -> DataFrame:
    text = F.format_string("\t%d -- %d [label=e1:%d-e2:%d]", "c1", "c2", "e1", "e2")
    return _framed(_line(circuit_edges, 1, F.col("ceid"), text), "graph G {")
