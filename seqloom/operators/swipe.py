"""Swipe: rotate the successors inside each run of marked neighbours of an entering list.

Over a maximal run of marked edges t..t+r-1 and the edge t+r that ends it, every marked edge takes
the successor of its neighbour and the ending edge takes the one of t. Only marked edges and run
ends change, so the work is done on those rows; the k-th run start belongs to the k-th run end, and
both are numbered along the lists without a window per vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.scan import dense_index
from seqloom.storage import Scratch, dealt, lookup


def swipe_marks(touching: DataFrame) -> DataFrame:
    """(eid, nx) for the touching pairs (e1, e2) the forest uses: the earlier edge and its neighbour."""
    return touching.select(F.least("e1", "e2").alias("eid"), F.greatest("e1", "e2").alias("nx")).distinct()


def changed_successors(edges: DataFrame, marks: DataFrame, scratch: Scratch) -> DataFrame:
    """(eid, s) of the edges whose successor changes.

    `edges` has (eid, v2, s), where v2 is any number of the head vertex; `marks` has (eid, nx) as from
    `swipe_marks`, where nx follows eid in the entering list of v2 and ids ascend along that list.
    """
    marks = scratch.write(marks.select("eid", "nx"))
    touched = scratch.write(
        marks.select(F.explode(F.array("eid", "nx")).alias("eid")).distinct()
    )
    known = scratch.write(
        lookup(edges.select("eid", "v2", "s"), touched, "eid", "eid", "inner")
    )
    successor_of = known.select(F.col("eid").alias("_of"), "s")
    inside = marks.join(dealt(successor_of), F.col("nx") == F.col("_of")).select("eid", "s")
    first = marks.join(dealt(marks.select(F.col("nx").alias("eid"))), "eid", "left_anti").select("eid")
    last = (
        marks.select(F.col("nx").alias("eid")).join(dealt(marks.select("eid")), "eid", "left_anti")
    )
    place = known.select("eid", "v2")
    starts = dense_index(scratch.write(first.join(dealt(place), "eid")), ["v2", "eid"], out="run")
    ends = dense_index(scratch.write(last.join(dealt(place), "eid")), ["v2", "eid"], out="run")
    closing = (
        ends.select("run", "eid")
        .join(dealt(starts.select("run", F.col("eid").alias("_start"))), "run")
        .join(dealt(successor_of), F.col("_start") == F.col("_of"))
        .select("eid", "s")
    )
    return scratch.write(inside.unionByName(closing))


def apply_swipe(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """`edges` with the new successors in column s."""
    new = changed.select("eid", F.col("s").alias("_s"), F.lit(True).alias("_hit"))
    met = lookup(edges, new, "eid", "eid", "left")
    taken = F.when(F.col("_hit"), F.col("_s")).otherwise(F.col("s"))
    return met.withColumn("s", taken).select(*edges.columns)


def swipe(edges: DataFrame, marks: DataFrame, scratch: Scratch) -> DataFrame:
    return apply_swipe(edges, changed_successors(edges, marks, scratch))


def relink(links: DataFrame, changed: DataFrame) -> DataFrame:
    """Successor graph (id, prv, nxt) after the swipe.

    The swipe permutes successors, so the new predecessors of all changed targets are known too.
    """
    out = changed.select("eid", F.col("s").alias("_s"), F.lit(True).alias("_hit"))
    met = lookup(links, out, "id", "eid", "left")
    met = met.withColumn("nxt", F.when(F.col("_hit"), F.col("_s")).otherwise(F.col("nxt")))
    back = changed.where(F.col("s").isNotNull()).select(F.col("s").alias("_t"), F.col("eid").alias("_p"))
    met = lookup(met.select("id", "prv", "nxt"), back, "id", "_t", "left")
    return met.select("id", F.coalesce("_p", "prv").alias("prv"), "nxt")
