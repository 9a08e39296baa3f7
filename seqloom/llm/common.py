"""What several operators of this package share: tables, word patterns, stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.storage import Scratch

# White space of the word definition: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back; lost executors then cost no second run."""
    return Scratch(df.sparkSession, name).write(df, keep=True)


def words(text: Column) -> Column:
    """Maximal runs of non-blank characters, in order; none for null or blank texts.

    Plain replacements and a split at one character take the fast path of the JVM; a pattern
    would cost three times as much.
    """
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.coalesce(F.array_remove(F.split(text, " "), ""), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
