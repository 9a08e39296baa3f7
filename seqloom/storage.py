"""Written tables that cut lineage between the steps of iterative operators.

Every loop in this package (list contraction, component labels, spanning forest, prefix doubling)
stores its state as parquet in the shared folder named by `spark.checkpoint.dir`, so a lost executor
costs one step and not the whole loop. Parquet also keeps column pruning and real table sizes, which
is what the planner needs to choose joins for the next step.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Nodes up to which `retrace_chains` works through all chains again.
BROADCAST_ROWS = 1_000_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in local mode, where nothing has been configured."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="seqloom-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


class Scratch:
    """Tables written by one operator run. Intermediate ones are dropped by `close`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.base = f"{checkpoint_root(spark).rstrip('/')}/{app}/{name}-{uuid.uuid4().hex[:12]}"
        self._intermediate: list[str] = []
        self._kept: list[str] = []
        self._tables: dict[str, DataFrame] = {}
        self._named: dict[str, str] = {}  # names of tables in buckets
        self._next = 0

    def write(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """Store `df` and return a scan of it. Kept tables outlive `close`."""
        path = self._path()
        self._cleanly(lambda: df.write.mode("overwrite").parquet(path))
        (self._kept if keep else self._intermediate).append(path)
        self._tables[path] = self.spark.read.schema(df.schema).parquet(path)
        return self._tables[path]

    def write_buckets(self, df: DataFrame, key: str) -> DataFrame:
        """Store an intermediate `df` in buckets of `key`: a join by that column moves only the other side.

        Rows that come from a grouping by `key` are in their buckets already and make one file a bucket.
        """
        path = self._path()
        name = f"buckets_{uuid.uuid4().hex}"
        made = df.write.format("parquet").option("path", path).bucketBy(shuffle_width(self.spark), key)
        self._cleanly(lambda: made.saveAsTable(name))
        self._intermediate.append(path)
        self._named[path] = name
        self._tables[path] = self.spark.table(name)
        return self._tables[path]

    def _path(self) -> str:
        self._next += 1
        return f"{self.base}/{self._next - 1:03d}"

    def _cleanly(self, write: Callable[[], None]) -> None:
        # The shuffle files of a step are of no use once its table is written; without this they stay
        # until the driver collects its garbage, and a loop fills the disks.
        before = self.spark.conf.get(CLEANUP_CONF, "false")
        self.spark.conf.set(CLEANUP_CONF, "true")
        try:
            write()
        finally:
            self.spark.conf.set(CLEANUP_CONF, before)

    def write_counting(self, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        """Store `df` and count the rows that meet `condition` while they are written."""
        seen = Observation()
        stored = self.write(df.observe(seen, F.count_if(condition).alias("n")))
        return stored, seen.get.get("n", 0)

    def drop(self, table: DataFrame) -> None:
        """Delete one intermediate table, as `write` has returned it, before the others."""
        path = next(p for p, stored in self._tables.items() if stored is table)
        self._intermediate.remove(path)
        del self._tables[path]
        self._delete(path)

    def drop_all(self, kept: bool = False) -> None:
        """Delete the intermediate tables, and the kept ones too if asked."""
        if kept:
            self._intermediate, self._kept = self._intermediate + self._kept, []
        for path in self._intermediate:
            self._delete(path)
        self._intermediate = []

    def _delete(self, path: str) -> None:
        if path in self._named:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._named.pop(path)}")  # its files stay
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        self.drop_all()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once and read it back; used where several branches need the same rows."""
    return Scratch(df.sparkSession, name).write(df, keep=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt out evenly if they come from fewer files than there are cores.

    A small file, one row group or one huge row would otherwise be one task of work that grows
    manyfold; inputs of many files are not moved. A stream does not tell its files and is dealt out.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    many = not rows.isStreaming and len(rows.inputFiles()) >= cores
    return rows if many else rows.repartition(shuffle_width(rows.sparkSession))


def dealt(rows: DataFrame) -> DataFrame:
    """`rows` for a join by sorted partitions, whatever their size.

    Spark judges a table by its compressed bytes and would send one of a few MB through the driver; a
    plan of several joins then holds several hash tables there at once, which are many times larger.
    """
    return rows.hint("merge")


def lookup(big: DataFrame, small: DataFrame, key: str, small_key: str, how: str = "left") -> DataFrame:
    """Join a side with possibly hot keys to a side whose key is unique.

    Nothing is sent through the driver: adaptive execution splits the partitions of hot keys and copies
    to these splits only the rows of the small side that they need.
    """
    right = dealt(small.withColumnRenamed(small_key, "_rkey"))
    return big.join(right, F.col(key) == F.col("_rkey"), how).drop("_rkey")
