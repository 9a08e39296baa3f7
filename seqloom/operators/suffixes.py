"""Suffix array over all strings of a column, by prefix doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.scan import dense_index
from seqloom.storage import Scratch, lookup

FIRST = 8  # bytes compared in the first step


def suffix_array(df: DataFrame, node: str, text: str, scratch: Scratch) -> DataFrame:
    """(idx, id, pos): all suffixes of all strings in byte order, equal ones by id and pos.

    `node` identifies a string (LONG). Each round compares twice as many bytes, through the ranks
    of the round before; the rounds end when no tie is broken any more.
    """
    raw = df.select(F.col(node).cast("long").alias("id"), F.encode(text, "UTF-8").alias("_t"))
    raw = raw.where(F.length("_t") > 0)
    cut = raw.select("id", "_t", F.explode(F.sequence(F.lit(0), F.length("_t") - 1)).alias("pos"))
    start = scratch.write(
        cut.select(
            "id",
            F.col("pos").cast("long").alias("pos"),
            F.hex(F.substring("_t", F.col("pos") + 1, F.lit(FIRST))).alias("key"),
        )
    )
    ranked, classes = _rank(start, ["key"], scratch)
    width = FIRST
    while True:
        ahead = ranked.select(
            "id", (F.col("pos") - width).alias("pos"), F.col("rank").alias("second")
        ).where(F.col("pos") >= 0)
        pairs = scratch.write(
            ranked.join(ahead, ["id", "pos"], "left").select(
                "id", "pos", F.col("rank").alias("first"), F.coalesce("second", F.lit(-1)).alias("second")
            )
        )
        ranked, now = _rank(pairs, ["first", "second"], scratch)
        if now == classes:
            break
        classes, width = now, 2 * width
    return dense_index(ranked, ["rank", "id", "pos"]).select("idx", "id", "pos")


def _rank(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, pos, rank) with the dense rank of the keys, and the number of distinct keys."""
    distinct = scratch.write(rows.select(*keys).distinct())
    numbered = scratch.write(dense_index(distinct, keys, out="rank"))
    classes = numbered.count()
    packed = rows.select("id", "pos", F.struct(*keys).alias("_key"))
    side = numbered.select(F.struct(*keys).alias("_side"), "rank")
    met = lookup(packed, side, "_key", "_side", "inner")
    return scratch.write(met.select("id", "pos", "rank")), classes
