"""Binary grey (P5) and colour (P6) images as one row per file, and back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header: magic, width, height, maximum, with white space and comment lines between.
_HEADER = r"^(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data, reason): data is the row-major sample buffer.

    The header may be of any length. A file that cannot be read has its reason (`header`, `maximum`
    or `size`) and nulls instead; no file is left out. One byte per sample is supported, so the
    maximum must be 1 to 255. Bytes after the last sample are not data.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.decode("content", "ISO-8859-1")
    head = F.regexp_extract(text, _HEADER, 0)
    field = lambda i: F.regexp_extract("head", _HEADER, i)
    rows = files.select("path", "content", head.alias("head")).select(
        "path", "content", F.length("head").alias("at"), field(1).alias("magic"),
        *[field(i).try_cast("int").alias(name) for i, name in ((2, "width"), (3, "height"), (4, "maximum"))],
    )
    channels = F.when(F.col("magic") == "P5", 1).otherwise(3)
    size = F.col("width").cast("long") * F.col("height") * channels
    reason = (
        F.when(F.col("at") == 0, "header")
        .when(~F.coalesce(F.col("maximum").between(1, 255), F.lit(False)), "maximum")
        .when(~F.coalesce(F.length("content") - F.col("at") >= size, F.lit(False)), "size")
    )
    rows = rows.withColumn("reason", reason)
    sound = lambda c: F.when(F.col("reason").isNull(), c)
    return rows.select(
        "path",
        sound(F.col("width")).alias("width"),
        sound(F.col("height")).alias("height"),
        sound(channels).alias("channels"),
        sound(F.substring(F.col("content"), F.col("at") + 1, size.cast("int"))).alias("data"),
        "reason",
    )


def samples(images: DataFrame) -> DataFrame:
    """(path, y, x, channel, value): one row per sample."""
    at = F.explode(F.sequence(F.lit(0), F.length("data") - 1)).alias("i")
    rows = images.where(F.length("data") > 0).select("path", "width", "channels", "data", at)
    pixel = F.expr("i div channels")
    return rows.select(
        "path",
        F.expr("(i div channels) div width").cast("int").alias("y"),
        (pixel % F.col("width")).cast("int").alias("x"),
        (F.col("i") % F.col("channels")).cast("int").alias("channel"),
        F.conv(F.hex(F.substring("data", F.col("i") + 1, F.lit(1))), 16, 10).cast("int").alias("value"),
    )


def write_images(images: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Write each row (name, width, height, channels, data) as one file; returns (name, bytes).

    `folder` must be a mount that all executors share. Files appear under their final name only when
    they are whole, so a repeated task does no harm.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for row in batch.itertuples(index=False):
                magic = "P5" if row.channels == 1 else "P6"
                body = f"{magic}\n{row.width} {row.height}\n255\n".encode() + bytes(row.data)
                final = os.path.join(folder, row.name)
                part = f"{final}.{os.getpid()}"
                with open(part, "wb") as out:
                    out.write(body)
                os.replace(part, final)
                sizes.append(len(body))
            yield pd.DataFrame({"name": batch["name"], "bytes": sizes})

    rows = images.select(F.col(name).alias("name"), "width", "height", "channels", "data")
    return rows.mapInPandas(put, "name string, bytes long")
