"""Word counts over reads that arrive in batches.

Each micro-batch is counted on its own and stored under its batch number; a batch that is run again
after a failure replaces its own file. The running total is the sum over the stored batches, so no
state has to be held between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.words import word_counts


def start_word_counts(
    reads: DataFrame, length: int, folder: str, trigger: dict | None = None
) -> StreamingQuery:
    """Count words of a streaming DataFrame (read_id, seq) into `folder`."""

    def store(batch: DataFrame, batch_id: int) -> None:
        word_counts(batch, length).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")

    writer = reads.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def total_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(lmer, cnt) over all batches stored so far."""
    stored = spark.read.schema("lmer long, cnt long, batch long").parquet(f"{folder}/counts")
    return stored.groupBy("lmer").agg(F.sum("cnt").alias("cnt"))


def running_counts(reads: DataFrame, length: int) -> DataFrame:
    """The same as one stateful streaming aggregation, for sinks in update or complete mode."""
    return word_counts(reads, length)
