"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; `run`
writes each result as Parquet to the shared folder and reads it back as the next stage's input. All
stages but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import lines, minhash, mixing, packing, quality
from seqloom.llm.common import stored, table


def _by_id(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is among the ids of `kept`."""
    ids = kept.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(ids, F.col("doc_id") == F.col("_kept"), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble their language; others go.

    A row without a doc_id cannot be looked up in the verdicts and goes.
    """
    return _by_id(docs, quality.quality_rules(docs).filter("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document or place has; n_chars follows the text."""
    out = lines.without_repeated_lines(docs, short=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return _by_id(docs, minhash.near_duplicates(docs).filter("kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in the target mix of sources, languages and topics."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, n_tokens, shard, bin."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Edit joins and raking have no SQL of a bearable cost; tests/llm compares the operators with
# brute-force versions, but not the stages and their order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
