"""Stretches: pieces of the chains of a successor graph that one task follows by itself.

An edge is dealt out by a minimizer of its head vertex. Neighbouring vertices mostly share it, so a task holds
stretches of several edges in a row, whatever the reads are. It follows them in numpy and sends one row per
stretch; only these are contracted, stored and traced round by round (`chains`), and every edge takes its
place from its stretch. Copies of a very frequent word are dealt out in pieces, and a task follows a bounded
number of edges at once: that makes stretches shorter, but no other chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import encoding as enc
from seqloom.operators.chains import COLUMNS, trace_chains
from seqloom.operators.scan import COPIES_PER_ROW
from seqloom.storage import Scratch, dealt, shuffle_width

# Edges a task follows at once, and edges of a stretch at most; they bound its arrays and rows.
FOLLOWED = 1 << 21
LONGEST = 1 << 12
NONE = np.int64(-1)

STRETCH = "id long, nxt long, low long, size long, nodes array<long>"


def place_key(kmer: Column, size: int) -> Column:
    """The smallest hash of the m-mers of a k-mer of `size` bases: k-mers that overlap mostly share it."""
    m = max(1, min(6, (size + 1) // 2))
    mask = F.lit((1 << 2 * m) - 1)
    parts = [F.xxhash64(F.shiftright(kmer, 2 * i).bitwiseAND(mask)) for i in range(size - m + 1)]
    return F.least(*parts) if len(parts) > 1 else parts[0]


def unrolled(e: np.ndarray, l: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids e + i and their successors l + i, i < size; NONE follows where l is NONE."""
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    onward = np.repeat(l, size)
    return np.repeat(e, size) + at, np.where(onward == NONE, NONE, onward + at)


def followed(ids: np.ndarray, nxt: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(order, start): places of all ids in the order of their stretches, and where each stretch starts in it.

    A stretch ends where its successor is not among `ids`. A cycle of ids begins at its smallest one.
    """
    n = len(ids)
    by_id = np.argsort(ids, kind="stable")
    found = np.minimum(np.searchsorted(ids, nxt, sorter=by_id), n - 1)
    inside = np.flatnonzero(ids[by_id[found]] == nxt)
    every = np.arange(n)
    before = every.copy()
    before[by_id[found[inside]]] = inside
    first, rank, rest = _ranked(before)
    if len(rest):
        low, jump = ids.copy(), before.copy()
        for _ in range(n.bit_length()):
            low[rest] = np.minimum(low[rest], low[jump[rest]])
            jump[rest] = jump[jump[rest]]
        cut = rest[low[rest] == ids[rest]]
        before[cut] = cut
        first, rank, _ = _ranked(before)
    sizes = np.bincount(first, minlength=n)
    begin = np.cumsum(sizes) - sizes
    order = np.empty(n, np.int64)
    order[begin[first] + rank] = every
    return order, np.flatnonzero(rank[order] % longest == 0)


def _ranked(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, rank, rest) by pointer jumping; `rest` are the places on cycles, which have no first."""
    n = len(before)
    begins = before == np.arange(n)
    first, rank = before.copy(), (~begins).astype(np.int64)
    left = np.flatnonzero(rank)
    for _ in range(n.bit_length() + 1):
        if not len(left):
            break
        via = first[left]
        far = first[via]
        rank[left] += rank[via]
        first[left] = far
        left = left[~begins[far]]
    return first, rank, left


def stretches(ranges: DataFrame, size: int, at_once: int = FOLLOWED, longest: int = LONGEST) -> DataFrame:
    """(id, nxt, low, size, nodes) from ranges (kmer, e, l, size) of edges e + i followed by l + i, NULL by none.

    `id` is the first of the nodes, `low` the smallest, `nxt` follows the last one. It begins a stretch of its own.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            e, l, rows = (batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in range(3))
            ends = np.cumsum(rows)
            done = 0
            while done < len(rows):
                base = ends[done] - rows[done]
                upto = max(done + 1, int(np.searchsorted(ends, base + at_once - n, "right")))
                held.append((e[done:upto], l[done:upto], rows[done:upto]))
                n += int(ends[upto - 1] - base)
                done = upto
                if n >= at_once or done < len(rows):
                    yield from made(held)
                    held, n = [], 0
        if held:
            yield from made(held)

    def made(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, nxt = unrolled(*(np.concatenate(x) for x in zip(*held)))
        order, start = followed(ids, nxt, longest)
        ids, nxt = ids[order], nxt[order]
        for at in range(0, len(start), 1 << 16):
            some = start[at : at + (1 << 16) + 1]
            ends = np.append(some[1:], len(ids)) if at + (1 << 16) >= len(start) else some[1:]
            some = some[: len(ends)]
            inner = ids[some[0] : ends[-1]]
            onward = nxt[ends - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[some]), pa.array(onward, mask=onward == NONE),
                    pa.array(np.minimum.reduceat(inner, some - some[0])), pa.array(ends - some),
                    pa.ListArray.from_arrays(pa.array(np.append(some, ends[-1]) - some[0], pa.int32()), pa.array(inner)),
                ],
                names=["id", "nxt", "low", "size", "nodes"],
            )

    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(COPIES_PER_ROW).cast("long"))
    cut = ranges.select("e", "l", "size", place_key(F.col("kmer"), size).alias("_key"), F.explode(starts).alias("_from"))
    cut = cut.repartition(shuffle_width(ranges.sparkSession), "_key", "_from").sortWithinPartitions("_key")
    pieces = cut.select(
        (F.col("e") + F.col("_from")).alias("e"),
        (F.col("l") + F.col("_from")).alias("l"),
        F.least(F.col("size") - F.col("_from"), F.lit(COPIES_PER_ROW)).cast("long").alias("size"),
    )
    return pieces.mapInArrow(follow, STRETCH)


def trace_stretches(
    ranges: DataFrame, size: int, scratch: Scratch, at_once: int = FOLLOWED, longest: int = LONGEST
) -> DataFrame:
    """(id, label, circuit, head, rank, is_cycle) of every edge, as `trace_chains` gives them for single links.

    The result reads one table, which outlives `scratch`: a row per stretch, unrolled as it is read.
    """
    made = scratch.write(stretches(ranges, size, at_once, longest))
    back = made.where(F.col("nxt").isNotNull()).select(
        F.col("nxt").alias("id"), F.col("id").alias("prv"), F.col("size").alias("dp")
    )
    links = made.select("id", "nxt", "low").join(dealt(back), "id", "left")
    with Scratch(scratch.spark, "stretches") as rounds:
        traced = scratch.write(trace_chains(links, rounds))
    kept = scratch.write(made.select("id", "nodes").join(dealt(traced), "id"), keep=True)
    rows = kept.select("label", "circuit", "head", "rank", "is_cycle", F.posexplode("nodes").alias("_at", "id"))
    return rows.withColumn("rank", F.col("rank") + F.col("_at")).select(*COLUMNS)
