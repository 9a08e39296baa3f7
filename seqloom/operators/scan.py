"""Prefix scans that never gather the data in one task.

A scan over a total order is done in two levels. Rows get a bucket number that never decreases along
the order (boundaries come from a sample and only steer the split; every row is kept). One pass gives
the total of each bucket, a window over those few totals gives the carry into each bucket, and a
window inside each bucket gives the local scan. The rows are shuffled once. The input is read three times, so anything dearer than a table scan should be stored
first (`seqloom.storage.materialize`).

A partitioned scan uses the same buckets, so a partition that holds a third of the rows still spreads
over the buckets of the order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.storage import materialize, shuffle_width

MAX_BUCKETS = 4096
_SAMPLES_PER_BUCKET = 64

OPS = ("add", "multiply", "min", "max")


def _literal(value, dtype: T.DataType) -> str:
    """SQL text of one boundary value."""
    if value is None:
        return f"CAST(NULL AS {dtype.simpleString()})"
    if isinstance(dtype, T.StringType):
        return f"decode(unhex('{value.encode().hex()}'), 'UTF-8')"
    if isinstance(dtype, T.BinaryType):
        return f"X'{bytes(value).hex()}'"
    if isinstance(dtype, T.TimestampNTZType):
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"CAST('{value!r}' AS {dtype.simpleString()})"
    if isinstance(value, bool):
        return str(value).lower()
    return f"CAST({value} AS {dtype.simpleString()})"


def _sortable(col: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """A column of the same order whose values survive the way through literals exactly."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col), T.LongType()
    if isinstance(dtype, T.DateType):
        return F.unix_date(col), T.IntegerType()
    return col, dtype


def order_bucket(
    df: DataFrame, order_by: Sequence[str], buckets: int | None = None
) -> tuple[Column, int]:
    """Expression for a bucket number that is monotone in `order_by` (ascending, nulls first).

    Also returns how many buckets there are.

    The boundaries are a bounded number of sampled keys; the whole composite key is compared, so a
    leading value shared by many rows is split by the columns after it.
    """
    spark = df.sparkSession
    want = min(buckets or 2 * shuffle_width(spark), MAX_BUCKETS)
    if want <= 1:
        return F.lit(0), 1
    types = {f.name: f.dataType for f in df.schema.fields}
    keys, key_types = zip(*[_sortable(F.col(c), types[c]) for c in order_by])
    sample_cols = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    need = want * _SAMPLES_PER_BUCKET
    total = df.count()
    if total == 0:
        return F.lit(0), 1
    picked = sample_cols.sample(fraction=min(1.0, 1.2 * need / total), seed=7).limit(4 * need)
    rows = [tuple(r) for r in picked.collect()]
    rows.sort(key=lambda r: tuple((v is not None, v) for v in r))
    cuts = []
    for i in range(1, want):
        at = math.ceil(i * len(rows) / want)
        if at < len(rows) and (not cuts or cuts[-1] != rows[at]):
            cuts.append(rows[at])
    if not cuts:
        return F.lit(0), 1
    if len(keys) == 1 and all(c[0] is not None for c in cuts):
        # `get` past the end is NULL and fails the comparison, which is the wanted answer.
        cut_text = ", ".join(_literal(c[0], key_types[0]) for c in cuts)
        probe = keys[0]
    else:
        cut_text = ", ".join(
            "named_struct("
            + ", ".join(f"'k{i}', {_literal(v, t)}" for i, (v, t) in enumerate(zip(c, key_types)))
            + ")"
            for c in cuts
        )
        probe = F.struct(*[k.cast(t).alias(f"k{i}") for i, (k, t) in enumerate(zip(keys, key_types))])
    bounds = F.expr(f"array({cut_text})")
    steps = F.array(*[F.lit(1 << p) for p in range(len(cuts).bit_length() - 1, -1, -1)])
    number = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) <= probe, at + step).otherwise(at),
    )
    return number, len(cuts) + 1


def _running(op: str, value: Column, window) -> Column:
    fn = {"add": F.sum, "multiply": F.product, "min": F.min, "max": F.max}[op]
    return fn(value).over(window)


def _combine(op: str, left: Column, right: Column) -> Column:
    if op == "add":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    if op == "multiply":
        return F.coalesce(left, F.lit(1.0)) * F.coalesce(right, F.lit(1.0))
    return F.least(left, right) if op == "min" else F.greatest(left, right)


def scan_columns(
    df: DataFrame,
    values: dict[str, str],
    order_by: Sequence[str],
    op: str = "add",
    inclusive: bool = False,
    backward: bool = False,
    partition_by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Scan several columns in one pass; `values` maps each output name to its input column."""
    if op not in OPS:
        raise ValueError(f"op must be one of {OPS}")
    parts = list(partition_by)
    number, found = order_bucket(df, order_by, buckets)
    based = df.withColumn("_b", number)
    keys = [*parts, "_b"]
    fn = {"add": F.sum, "multiply": F.product, "min": F.min, "max": F.max}[op]
    numbered = [(f"_c{i}", out, col) for i, (out, col) in enumerate(values.items())]
    totals = based.groupBy(*keys).agg(*[fn(col).alias(c) for c, _, col in numbered])
    step = F.col("_b").desc() if backward else F.col("_b").asc()
    # Without partitions this window sees one row per bucket, at most MAX_BUCKETS rows.
    before = (
        Window.partitionBy(*(parts or [F.lit(0)]))
        .orderBy(step)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(*keys, *[_running(op, F.col(c), before).alias(c) for c, _, _ in numbered])
    if parts:
        # Same keys as the window below, so the rows are shuffled once for both.
        right = carry.select(
            *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c, _, _ in numbered]
        )
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        joined = based.join(right, same, "left")
    else:
        # One shuffle partition per bucket; hashing bucket numbers would pile some of them up.
        joined = based.join(F.broadcast(carry), "_b", "left").repartitionById(found, "_b")
    order = [F.col(c).desc() if backward else F.col(c).asc() for c in order_by]
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    types = {f.name: f.dataType for f in df.schema.fields}
    outs = []
    for c, out, col in numbered:
        made = _combine(op, F.col(c), _running(op, F.col(col), inside))
        if op == "add" and isinstance(types[col], T.IntegralType):
            made = made.cast("long")
        outs.append(made.alias(out))
    return joined.select(*df.columns, *outs)


def scan(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    op: str = "add",
    inclusive: bool = False,
    backward: bool = False,
    partition_by: Sequence[str] = (),
    out: str = "scan",
    buckets: int | None = None,
) -> DataFrame:
    """Add column `out`: the scan of `value` along `order_by`, which must be unique per partition.

    `partition_by` restarts the scan per key (the multi-row scan). The first element of an exclusive
    scan is 0 for add, 1 for multiply and NULL for min and max. Multiply works in DOUBLE.
    """
    return scan_columns(
        df, {out: value}, order_by, op, inclusive, backward, partition_by, buckets
    )


def segmented_scan(
    df: DataFrame,
    value: str,
    flag: str,
    order_by: Sequence[str],
    op: str = "add",
    inclusive: bool = False,
    backward: bool = False,
    out: str = "scan",
    buckets: int | None = None,
) -> DataFrame:
    """Scan that restarts wherever `flag` is 1 (a flag starts a segment in forward order)."""
    marked = df.withColumn("_flag", F.col(flag).cast("long"))
    with_id = scan(marked, "_flag", order_by, "add", inclusive=True, out="_segment", buckets=buckets)
    # Written once: the second scan reads its input for the boundaries, the totals and the rows.
    with_id = materialize(with_id.drop("_flag"), "segments")
    done = scan(
        with_id, value, order_by, op, inclusive, backward, ["_segment"], out, buckets
    )
    return done.drop("_segment")


def dense_index(
    df: DataFrame, order_by: Sequence[str], out: str = "idx", buckets: int | None = None
) -> DataFrame:
    """Number rows 0, 1, 2, ... along a unique order without a one-task window."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return scan(ones, "_one", order_by, "add", out=out, buckets=buckets).drop("_one")


def row_numbers(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str],
    out: str = "idx",
    buckets: int | None = None,
) -> DataFrame:
    """Number rows 0, 1, 2, ... per partition; a partition may be larger than a task should be."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return scan(ones, "_one", order_by, partition_by=partition_by, out=out, buckets=buckets).drop("_one")


def following(
    df: DataFrame, node: str, order_by: Sequence[str], partition_by: Sequence[str]
) -> DataFrame:
    """(node, following): the next row of the same partition, NULL at its end."""
    placed = row_numbers(df, order_by, partition_by, out="_at").select(*partition_by, "_at", node)
    placed = materialize(placed, "places")
    ahead = placed.select(
        *partition_by, (F.col("_at") - 1).alias("_at"), F.col(node).alias("following")
    )
    return placed.join(ahead, [*partition_by, "_at"], "left").select(node, "following")


# Copies made per row before the rows are dealt out again; see repeat_rows.
COPIES_PER_ROW = 1 << 14


def repeat_rows(
    df: DataFrame, count: str, by: Sequence[str], out: str = "copy", partitions: int | None = None
) -> DataFrame:
    """Each row `count` times, with column `out` from 0 to count - 1.

    A large count is first cut into several rows, and rows are spread by `by` (a key of `df`) before
    they multiply, so one row that stands for a third of the result is made by many tasks.
    """
    width = partitions or shuffle_width(df.sparkSession)
    starts = F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(COPIES_PER_ROW).cast("long"))
    cut = df.where(F.col(count) > 0).withColumn("_from", F.explode(starts))
    cut = cut.repartition(width, *by, "_from")
    last = F.least(F.col("_from") + COPIES_PER_ROW, F.col(count)) - 1
    return cut.withColumn(out, F.explode(F.sequence(F.col("_from"), last))).drop("_from")
