"""FASTQ files as reads, by line position, from any number of split files.

A line is a sequence if its number in the file leaves 1 modulo 4. Large files are read in splits, so
the number of a line is its place inside its split plus the lines of the splits before it in the same
file; only one count per split is summed, and no split has to be read in order. Splits depend on the
cores that are there when a scan is planned, so the files are scanned once: lines are stored with
their split and place, and both the counts and the lines come from that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.storage import lookup, materialize


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line with its number, from 0, in its file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        # Ascends along a split; constant offset inside it.
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    lines = materialize(lines, "lines")
    blocks = lines.groupBy("file", "start").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n")
    )
    before = (
        Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = blocks.select(
        F.struct("file", "start").alias("block"),
        "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"),
    )
    keyed = lines.select(F.struct("file", "start").alias("_block"), "file", "at", "value")
    # One row per split.
    met = lookup(keyed, materialize(blocks, "splits"), "_block", "block", "inner")
    return met.select(
        "file", (F.col("skip") + F.col("at") - F.col("first")).alias("line"), "value"
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_no, seq): sequences in file order by read_no."""
    lines = numbered_lines(spark, path).where(F.col("line") % 4 == 1)
    return lines.select("file", F.expr("line div 4").alias("read_no"), F.col("value").alias("seq"))


def parse_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, seq, quality): one row per name, the last record of a name wins.

    Names keep their leading '@'.
    """
    rows = numbered_lines(spark, path).withColumn("record", F.expr("line div 4"))
    line = F.col("line") % 4
    records = rows.groupBy("file", "record").agg(
        F.max(F.when(line == 0, F.col("value"))).alias("name"),
        F.max(F.when(line == 1, F.col("value"))).alias("seq"),
        F.max(F.when(line == 3, F.col("value"))).alias("quality"),
    )
    return (
        records.where(F.col("seq").isNotNull())
        .groupBy("file", "name")
        .agg(F.max_by(F.struct("seq", "quality"), "record").alias("r"))
        .select("file", "name", "r.seq", "r.quality")
    )


def reads_from_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq) as the assembly takes them; read_id is a hash of file and place."""
    rows = read_fastq(spark, path)
    return rows.select(F.xxhash64("file", "read_no").alias("read_id"), "seq")


def write_fastq(df: DataFrame, path: str, name: str, seq: str, quality: str | None = None) -> None:
    """Four lines per row. Without a quality column every base gets the letter I."""
    mark = F.col(quality) if quality else F.regexp_replace(F.col(seq), "(?s).", "I")
    record = F.concat_ws(
        "\n", F.concat(F.lit("@"), F.col(name).cast("string")), F.col(seq), F.lit("+"), mark
    )
    df.select(record.alias("value")).write.mode("overwrite").text(path)
