"""Registry of named run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Identifier and printed name, in the order of their numbers from 0.
# TM_ items are times in seconds, NM_ items are counts.
ITEMS = (
    ("TM_DEBRUIJN_CONSTRUCTION", "Debruijn Construction Time"),
    ("TM_EULER_TOUR_P1", "Euler Tour Phase 1 Time"),
    ("TM_EULER_TOUR_P2", "Euler Tour Phase 2 Time"),
    ("TM_EULER_TOUR", "Euler Tour Total Time"),
    ("TM_COMPONENT", "Component Label Time"),
    ("TM_SPANNING_TREE", "Spanning Tree Const. Time"),
    ("TM_SWIPE_EXECUTION", "Swipe Execution Time"),
    ("TM_CONTIG_GENERATION", "Contig Generation Time"),
    ("TM_TOTAL_TIME", "Total Time"),
    ("NM_LMER_LENGTH", "l-mer Length"),
    ("NM_BLOCK_SIZE", "Block Size"),
    ("NM_LMER_COUNT", "l-mer Count"),
    ("NM_KMER_COUNT", "k-mer Count"),
    ("NM_DEBRUIJN_VTX", "Debruijn Vertices"),
    ("NM_DEBRUIJN_EDG", "Debruijn Edges"),
    ("NM_CIRCUIT_VTX", "Circuit Vertices"),
    ("NM_CIRCUIT_EDG", "Circuit Edges"),
    ("NM_TOTAL_MEMORY_ALLOCATED", "Total Memory Allocated"),
    ("NM_PEAK_MEMORY_ALLOCATED", "Peak Memory Allocated"),
    ("TM_KMER_EXTRACTION_TIME", "k-mer Extraction Time"),
    ("TM_HASHTABLE_CONSTRUCTION", "Hash table Construction Time"),
    ("TM_KMER_GPUENC_TIME", "k-mer GPU Encoding Time"),
    ("TM_PROCESS_READ_TIME", "Input Read Processing Time"),
    ("NM_READ_COUNT", "Original Read Count"),
    ("TM_ERROR_CORRECTION_TIME", "ERROR CORRECTION TIME"),
    ("NM_CORRECTED_READ_COUNT", "Corrected Read Count"),
    ("NM_MODIFIED_READ_COUNT", "Modified Read Count"),
    ("TM_MUTATION_GPU_TIME", "Mutation GPU Time"),
    ("TM_ACCUMULATE_GPU_TIME", "Mutation Score Accumulation Time"),
    ("TM_SELECT_MUTATION_GPU_TIME", "Select Mutation Time"),
    ("TM_SELECT_POSITION_GPU_TIME", "Select Position Time"),
)
UNSET = -1.0


class Metrics:
    def __init__(self) -> None:
        self._values = {key: UNSET for key, _ in ITEMS}

    def set(self, key: str, value: float) -> None:
        if key in self._values:
            self._values[key] = float(value)

    def get(self, key: str) -> float:
        return self._values[key]

    def update(self, values: dict[str, float]) -> None:
        for key, value in values.items():
            self.set(key, value)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(id, key, name, value) of all items."""
        rows = [(i, key, name, self._values[key]) for i, (key, name) in enumerate(ITEMS)]
        return spark.createDataFrame(rows, "id int, key string, name string, value double")

    def xml(self, key: str) -> str:
        value = self._values[key]
        shown = f"{value:.0f}" if key.startswith("NM_") else f"{value:f}"
        return f"<item name='{dict(ITEMS)[key]}' value='{shown}'/>"

    def xml_all(self) -> list[str]:
        """Items that have been set to something above zero."""
        return [self.xml(key) for key, _ in ITEMS if self._values[key] > 0]


def xml_lines(metrics: DataFrame) -> DataFrame:
    """(id, line) for a metrics table, items above zero only."""
    shown = F.when(
        F.col("key").startswith("NM_"), F.format_string("%.0f", "value")
    ).otherwise(F.format_string("%f", "value"))
    return metrics.where(F.col("value") > 0).select(
        "id", F.format_string("<item name='%s' value='%s'/>", "name", shown).alias("line")
    )
