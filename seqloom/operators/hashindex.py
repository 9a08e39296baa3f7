"""Hash index views: probes, slots and values under repeated keys.

Probing is an equi-join; Spark's own hashing does the work of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import hashing as h
from seqloom.operators.scan import dense_index, repeat_rows, scan_columns
from seqloom.storage import lookup, materialize


def probe(
    requests: DataFrame, request_key: str, index: DataFrame, miss_value: int | None = None
) -> DataFrame:
    """`requests` with column `value`; a miss is NULL, or `miss_value` where one is given."""
    side = index.select(F.col("key").alias("_key"), F.col("value"))
    met = lookup(requests, side, request_key, "_key", "left")
    if miss_value is None:
        return met
    return met.withColumn("value", F.coalesce(F.col("value"), F.lit(miss_value)))


def slot_candidates(df: DataFrame, key: str, seed: int, keys: int | None = None) -> DataFrame:
    """(key, bucket, slot1, slot2, slot3): the three places of a key in the three-way table."""
    buckets = h.bucket_count(df.count() if keys is None else keys)
    col = F.col(key)
    return df.select(
        col.cast("long").alias("key"),
        h.bucket_hash(col, buckets).alias("bucket"),
        h.slot_hash(col, seed, 1).alias("slot1"),
        (h.slot_hash(col, seed, 2) + h.SLOTS).alias("slot2"),
        (h.slot_hash(col, seed, 3) + 2 * h.SLOTS).alias("slot3"),
    )


def multi_value_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, count, offset): where the values of each key start in `multi_value_values`."""
    sizes = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    stored = materialize(sizes, "sizes")
    return scan_columns(stored, {"offset": "count"}, ["key"]).select("key", "count", "offset")


def multi_value_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(idx, key, value) with the values of one key next to each other.

    Equal pairs are counted first and made again at the end. A key with very many values is spread
    over tasks by its values; nothing is gathered per key.
    """
    pairs = df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    placed = scan_columns(materialize(pairs, "pairs"), {"idx": "n"}, ["key", "value"])
    rows = repeat_rows(placed, "n", ["idx"])
    return rows.select((F.col("idx") + F.col("copy")).alias("idx"), "key", "value")


def compacting_index(df: DataFrame, key: str) -> DataFrame:
    """(key, idx): distinct keys with dense numbers."""
    keys = materialize(df.select(F.col(key).alias("key")).distinct(), "keys")
    return dense_index(keys, ["key"])
