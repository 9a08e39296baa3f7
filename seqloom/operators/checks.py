"""Consistency checks of an assembly's tables.

Conditions on single rows are counted by an `Observation` while a table is written, so they cost no pass
of their own. Conditions between rows (an offset and the next one, a vertex and its edges) are one group-by
each: every row is sent under the key of the row it must agree with, and combinable aggregates show whether
both say the same. Nothing is joined and no key collects rows.

Edges are checked as ranges of ids, one range for all copies of a word, so the work grows with the
distinct words and not with the text; a table of single edges is checked as ranges of one.

Each check gives the value it is about, how many rows break it and the smallest number of such a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.storage import Scratch

RANGE_VALUES = ("edges", "successor_unset", "edge_range_bad", "edge_range_first", "successor_range_bad", "successor_range_first")
RESULT = "check string, value long, bad long, first long"


def watched(rows: DataFrame, key: str, values: dict[str, Column], wrong: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """`rows` that report, once they are written, `values` and per condition of `wrong` its count and first key."""
    seen = Observation()
    wanted = [value.alias(name) for name, value in values.items()]
    for name, bad in wrong.items():
        hit = F.coalesce(bad, F.lit(False))
        wanted += [F.count_if(hit).alias(f"{name}_bad"), F.min(F.when(hit, F.col(key))).alias(f"{name}_first")]
    return rows.observe(seen, *wanted), seen


def _agreed(rows: DataFrame, wrong: dict[str, Column]) -> dict[str, tuple[int, int | None]]:
    """Per condition on the groups of `rows` (a column key) the number of keys and the first one."""
    hit = {name: F.coalesce(bad, F.lit(False)) for name, bad in wrong.items()}
    found = rows.agg(
        *[F.count_if(bad).alias(f"{name}_bad") for name, bad in hit.items()],
        *[F.min(F.when(bad, F.col("key"))).alias(f"{name}_first") for name, bad in hit.items()],
    ).first()
    return {name: (found[f"{name}_bad"], found[f"{name}_first"]) for name in wrong}


def steps(vertices: DataFrame) -> dict[str, tuple[int, int | None]]:
    """Offsets that are not the offset before plus the count there; numbers without a neighbour."""
    nothing = F.lit(None).cast("long")
    own = vertices.select(
        F.col("vidx").alias("key"), F.col("ep").alias("ep"), F.col("lp").alias("lp"), nothing.alias("e"), nothing.alias("l")
    )
    due = vertices.select(
        (F.col("vidx") + 1).alias("key"), nothing.alias("ep"), nothing.alias("lp"),
        (F.col("ep") + F.col("ecount")).alias("e"), (F.col("lp") + F.col("lcount")).alias("l"),
    )
    met = own.unionByName(due).groupBy("key").agg(*[F.max(c).alias(c) for c in ("ep", "lp", "e", "l")])
    begin = F.col("key") == 0
    return _agreed(
        met,
        {
            "entering_step": F.col("ep") != F.when(begin, F.lit(0)).otherwise(F.coalesce("e", F.lit(-1))),
            "leaving_step": F.col("lp") != F.when(begin, F.lit(0)).otherwise(F.coalesce("l", F.lit(-1))),
        },
    )


def as_ranges(edges: DataFrame) -> DataFrame:
    """Edges as ranges of ids (eid0, cnt, v1, v2, s0, slen): copy i has the id eid0 + i and, while i < slen,
    the successor s0 + i. A table of single edges (eid, v1, v2, s) is one range for each."""
    if "eid0" in edges.columns:
        return edges.select("eid0", "cnt", "v1", "v2", "s0", "slen")
    one = F.lit(1).cast("long")
    return edges.select(
        F.col("eid").alias("eid0"), one.alias("cnt"), "v1", "v2", F.col("s").alias("s0"),
        F.col("s").isNotNull().cast("long").alias("slen"),
    )


def degrees(vertices: DataFrame, ranges: DataFrame) -> dict[str, tuple[int, int | None]]:
    """Vertices whose counts are not the numbers of their edges; ends of edges that are no vertex."""
    zero = F.lit(0).cast("long")
    rows = vertices.select(
        F.col("vidx").alias("key"), F.col("ecount").alias("e"), F.col("lcount").alias("l"), F.lit(1).alias("known")
    )
    for column, e, l in (("v2", -F.col("cnt"), zero), ("v1", zero, -F.col("cnt"))):
        rows = rows.unionByName(ranges.select(F.col(column).alias("key"), e.alias("e"), l.alias("l"), F.lit(0).alias("known")))
    met = rows.groupBy("key").agg(F.sum("e").alias("e"), F.sum("l").alias("l"), F.max("known").alias("known"))
    return _agreed(met, {"entering_count": F.col("e") != 0, "leaving_count": F.col("l") != 0, "vertex_missing": F.col("known") == 0})


# Ids per block of `successions` (a power of two), and pieces of a block that are held before they are met.
BLOCK_BITS = 20
HELD_PIECES = 1 << 20

# Stand for "no value" in a maximum and in a minimum.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

# Ids [start, stop): the tail of their own edges, least and greatest head of the edges they follow, number of these.
Pieces = tuple[np.ndarray, ...]


def met_pieces(pieces: Pieces) -> Pieces:
    """The same pieces cut where any of them begins or ends, and those of one place put together.

    Pieces that overlap much are halved first: the halves have no overlaps any more once they are met.
    """
    start, stop, *values = pieces
    cuts = np.unique(np.concatenate([start, stop]))
    low, high = np.searchsorted(cuts, start), np.searchsorted(cuts, stop)
    size = high - low
    total = int(size.sum())
    if total > 8 * len(start):
        half = len(start) // 2
        first, second = (met_pieces(tuple(c[part] for c in pieces)) for part in (slice(half), slice(half, None)))
        return met_pieces(tuple(np.concatenate(c) for c in zip(first, second)))
    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(total)
    n = len(cuts) - 1
    made = []
    for value, nothing, meet in zip(values, (LOWEST, HIGHEST, LOWEST, 0), (np.maximum, np.minimum, np.maximum, np.add)):
        out = np.full(n, nothing, np.int64)
        meet.at(out, at, np.repeat(value, size))
        made.append(out)
    held = np.flatnonzero(np.bincount(at, minlength=n))
    return (cuts[held], cuts[held + 1], *[c[held] for c in made])


SUCCESSION = ("missing", "elsewhere", "shared")


def _faults(pieces: Pieces) -> list[int]:
    """Per kind of SUCCESSION the number of ids and the first one (HIGHEST if there is none)."""
    start, stop, tail, low, high, n = met_pieces(pieces)
    known = tail != LOWEST
    out: list[int] = []
    for bad in (~known, known & (n > 0) & ((low != tail) | (high != tail)), n > 1):
        out += [int((stop - start)[bad].sum()), int(start[bad].min(initial=HIGHEST))]
    return out


def successions(ranges: DataFrame) -> dict[str, tuple[int, int | None]]:
    """Successors that are no edge, leave another vertex, or follow two edges.

    Ranges of ids are cut at the ends of blocks and dealt out by block; single edges are never made.
    """
    none = lambda v: F.lit(v).cast("long")
    own = ranges.select(
        F.col("eid0").alias("start"), (F.col("eid0") + F.col("cnt")).alias("stop"), F.coalesce("v1", none(LOWEST)).alias("tail"),
        none(HIGHEST).alias("low"), none(LOWEST).alias("high"), none(0).alias("n"),
    )
    after = ranges.where("slen > 0").select(
        F.col("s0").alias("start"), (F.col("s0") + F.col("slen")).alias("stop"), none(LOWEST).alias("tail"),
        F.coalesce("v2", none(HIGHEST)).alias("low"), F.coalesce("v2", none(LOWEST)).alias("high"), F.col("v2").isNotNull().cast("long").alias("n"),
    )
    rows = own.unionByName(after).where("start < stop")
    rows = rows.withColumn("block", F.explode(F.sequence(F.shiftright("start", BLOCK_BITS), F.shiftright(F.col("stop") - 1, BLOCK_BITS))))
    begin = F.shiftleft("block", BLOCK_BITS)
    rows = rows.withColumns({"start": F.greatest("start", begin), "stop": F.least("stop", begin + (1 << BLOCK_BITS))})
    rows = rows.select("block", "start", "stop", "tail", "low", "high", "n").repartition("block").sortWithinPartitions("block")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # columns block, start, stop, tail, low, high, n; sorted by block
        size = 0
        for batch in batches:
            held.append(batch.to_numpy(np.int64).T)
            size += len(batch)
            if size < HELD_PIECES:
                continue
            table = np.concatenate(held, axis=1)
            done = int(np.searchsorted(table[0], table[0, -1]))  # the last block may go on
            yield from found(table[:, :done])
            rest = met_pieces(tuple(table[1:, done:]))
            held = [np.stack([np.full(len(rest[0]), table[0, -1]), *rest])]
            size = len(rest[0]) if 2 * len(rest[0]) < HELD_PIECES else 0
        if held:
            yield from found(np.concatenate(held, axis=1))

    def found(table: np.ndarray) -> Iterator[pd.DataFrame]:
        edges = np.flatnonzero(np.diff(table[0], prepend=table[0, :1] - 1, append=table[0, -1:] + 1)) if table.size else []
        made = [_faults(tuple(table[1:, a:b])) for a, b in zip(edges, edges[1:])]
        if made:
            yield pd.DataFrame(made, columns=names)

    names = [f"{kind}_{what}" for kind in SUCCESSION for what in ("bad", "first")]
    told = rows.mapInPandas(check, ", ".join(f"{name} long" for name in names))
    total = told.agg(*[F.sum(c).alias(c) if c.endswith("bad") else F.min(c).alias(c) for c in names]).first()
    return {
        f"successor_{kind}": (total[f"{kind}_bad"] or 0, total[f"{kind}_first"] if total[f"{kind}_bad"] else None)
        for kind in SUCCESSION
    }


def graph_checks(words: DataFrame, vertices: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(check, value, bad, first) over words (lmer, cnt), vertices (vidx, ep, lp, ecount, lcount) and
    edges, single ones (eid, v1, v2, s) or ranges (`as_ranges`), which are written and observed on the way.

    `value` is the total a check is about (null where there is none), `first` the smallest number that
    breaks it. A sound assembly has bad = 0 everywhere; `successor_unset` only counts, as edges at the
    end of a path have no successor.
    """
    total = words.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first()["n"]
    e_end, l_end = F.col("ep") + F.col("ecount"), F.col("lp") + F.col("lcount")
    sides = {"entering": ("ep", "ecount", e_end), "leaving": ("lp", "lcount", l_end)}
    vertices, at_vertices = watched(
        vertices.select("vidx", "ep", "lp", "ecount", "lcount"),
        "vidx",
        {side: F.coalesce(F.sum(count), F.lit(0)) for side, (_, count, _) in sides.items()},
        {f"{side}_offset": (F.col(at) < 0) | (end > total) for side, (at, _, end) in sides.items()},
    )
    vertices = scratch.write(vertices)
    def outside(start: Column, count: Column) -> tuple[Column, Column]:
        """How many of `count` numbers from `start` on are none of 0 to total - 1, and how many come before the first of them."""
        inside = F.greatest(F.least(start + count, F.lit(total)) - F.greatest(start, F.lit(0)), F.lit(0))
        return count - inside, F.when(start < 0, 0).otherwise(F.greatest(total - start, F.lit(0)))

    eid0, zero = F.col("eid0"), F.lit(0).cast("long")
    wanted = [F.sum("cnt").alias("edges"), F.sum(F.col("cnt") - F.col("slen")).alias("successor_unset")]
    for name, start, count in (("edge_range", eid0, F.col("cnt")), ("successor_range", F.coalesce("s0", zero), F.col("slen"))):
        bad, before = outside(start, count)
        wanted += [F.sum(bad).alias(f"{name}_bad"), F.min(F.when(bad > 0, eid0 + before)).alias(f"{name}_first")]
    at_edges = Observation()
    edges = as_ranges(edges).observe(at_edges, *[w if "first" in name else F.coalesce(w, zero).alias(name) for name, w in zip(RANGE_VALUES, wanted)])
    edges = scratch.write(edges)
    v, e = at_vertices.get, at_edges.get
    rows = [("words", total, 0, None), ("edges", e["edges"], int(e["edges"] != total), None), ("successor_unset", e["successor_unset"], 0, None)]
    rows += [(side, v[side], int(v[side] != total), None) for side in sides]
    rows += [(name, None, v[f"{name}_bad"], v[f"{name}_first"]) for name in ("entering_offset", "leaving_offset")]
    rows += [(name, None, e[f"{name}_bad"], e[f"{name}_first"]) for name in ("edge_range", "successor_range")]
    between = steps(vertices) | degrees(vertices, edges) | successions(edges)
    rows += [(name, None, bad, first) for name, (bad, first) in between.items()]
    return words.sparkSession.createDataFrame(rows, RESULT)
