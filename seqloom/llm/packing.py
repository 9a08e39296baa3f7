"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt by a hash of their id into shards of about `shard_docs`, and every shard is
packed on its own, longest first, so tasks are bounded and even whatever the sources and copies are.
Open bins of a shard are kept in the order of their residual capacity. A document goes to the first
bin, from its own length upwards, that is compatible: no bin may hold two documents of one duplicate
cluster, nor more than `per_source` of one source. Bins carry bitmaps for both, and the search goes
on to the next larger residual until a compatible bin is found or none is left. Documents of one
cluster, source and length follow each other, and each search goes on where the last one ended,
since what was incompatible before still is; so a large group of copies does not search in squares.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import n_words


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """Bin of each item; items are given longest first, equal ones side by side."""
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    in_cluster: list[int] = []  # per bin a bitmap over clusters
    in_source: list[list[int]] = []  # per bin and count a bitmap over sources: more than so many
    out = []
    last, resume = None, None
    for length, source, cluster in zip(lengths, sources, clusters):
        own = (length, source, cluster)
        begin = resume if own == last else (length, -1)
        at = bisect.bisect_left(order, begin)
        c, s = 1 << cluster, 1 << source
        while at < len(order):
            bin_ = order[at][1]
            if not in_cluster[bin_] & c and not in_source[bin_][per_source - 1] & s:
                break
            at += 1
        if at < len(order):
            residual, bin_ = order.pop(at)
            resume = (residual, bin_)
        else:
            residual, bin_ = capacity, len(in_cluster)
            in_cluster.append(0)
            in_source.append([0] * per_source)
            resume = (capacity + 1, 0)
        in_cluster[bin_] |= c
        planes = in_source[bin_]
        for i in range(per_source):
            if not planes[i] & s:
                planes[i] |= s
                break
        bisect.insort(order, (residual - length, bin_))
        last = own
        out.append(bin_)
    return out


def pieces(docs: DataFrame, capacity: int, doc_id: str, length: Column, source: Column, cluster: Column) -> DataFrame:
    """(doc_id, source, cluster, piece, start, n_tokens): documents cut at the capacity.

    Documents without tokens make one piece of length 0.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(source.cast("string"), F.lit("")).alias("source"),
        cluster.cast("long").alias("cluster"),
        F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("total"),
    )
    step = F.lit(capacity).cast("long")
    return rows.select(
        "*",
        F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), step)).alias("piece", "start"),
    ).select(
        "doc_id", "source", "cluster", "piece", "start",
        F.least(F.col("total") - F.col("start"), step).alias("n_tokens"),
    )


def pack(docs: DataFrame, capacity: int = 4096, per_source: int = 8, shard_docs: int = 20_000,
         doc_id: str = "doc_id", length: Column | None = None, source: Column | None = None,
         cluster: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, shard, bin): where every piece of every document goes.

    By default the length is the number of words of `text`, the source is `source`, and documents of
    equal text are a cluster. A document over the capacity is cut into full pieces, each a bin of
    its own, and a rest that is packed like any other. Empty and null texts have one piece of length
    0 and no bin. A null source is a source of its own; null ids are dealt like any id; a null
    cluster conflicts with nothing. Repeated rows are packed as often as they occur.
    """
    length = n_words(F.col("text")) if length is None else length
    source = F.col("source") if source is None else source
    cluster = F.xxhash64("text") if cluster is None else cluster
    rows = pieces(docs, capacity, doc_id, length, source, cluster)
    full = F.col("n_tokens") == capacity
    shards = docs.count() // shard_docs + 1
    # Pieces that fill a bin, and empty ones, need no search and do not move.
    alone = rows.filter(full | (F.col("n_tokens") == 0)).select(
        "doc_id", "piece", "start", "n_tokens",
        F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("bin"),
    )
    open_ = rows.filter(~full & (F.col("n_tokens") > 0)).withColumn(
        "shard",
        F.pmod(F.xxhash64(F.lit("shard"), "doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("cluster", "source"))), F.lit(shards)).cast("int"),
    )

    def one_shard(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["n_tokens", "cluster", "source", "doc_id"], ascending=[False, True, True, True], kind="stable")
        sources = pd.factorize(batch["source"])[0].tolist()
        clusters = pd.factorize(batch["cluster"])[0]
        lone = clusters < 0
        clusters[lone] = clusters.max(initial=-1) + 1 + np.arange(lone.sum())
        bins = best_fit(batch["n_tokens"].tolist(), sources, clusters.tolist(), capacity, per_source)
        return batch.assign(bin=np.array(bins, np.int64))[["doc_id", "piece", "start", "n_tokens", "shard", "bin"]]

    packed = open_.groupBy("shard").applyInPandas(
        one_shard, "doc_id long, piece int, start long, n_tokens long, shard int, bin long"
    )
    return packed.unionByName(alone)


def fill(rows: Iterable[tuple[int, int, int]], capacity: int) -> float:
    """Share of the capacity of all opened bins that is used; rows of (shard, bin, n_tokens)."""
    used: dict[tuple[int, int], int] = {}
    for shard, bin_, n in rows:
        used[shard, bin_] = used.get((shard, bin_), 0) + n
    return sum(used.values()) / (capacity * len(used)) if used else 1.0
