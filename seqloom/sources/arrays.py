"""Typed arrays in text files: numbers separated by white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.scan import dense_index
from seqloom.sources.fastq import numbered_lines

# Element types by name; unsigned ones use the next wider signed type.
TYPES = {
    "float": "float",
    "double": "double",
    "int": "int",
    "uint": "bigint",
    "char": "tinyint",
    "uchar": "smallint",
}


def read_array(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, i, x): elements in file order, i counted from 0 over all files by file name."""
    lines = numbered_lines(spark, path)
    cells = lines.select(
        "file", "line", F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "))
    ).where(F.col("col") != "")
    typed = cells.select("file", "line", F.col("pos"), F.col("col").cast(TYPES[kind]).alias("x"))
    return dense_index(typed, ["file", "line", "pos"], out="i").select("file", "i", "x")


def write_array(df: DataFrame, path: str, index: str, value: str, kind: str) -> None:
    """One element per line, in index order over the part files."""
    text = F.col(value).cast(TYPES[kind]).cast("string")
    ordered = df.repartitionByRange(index).sortWithinPartitions(index)
    ordered.select(text.alias("value")).write.mode("overwrite").text(path)
