"""Products and float sums that are exact in their terms, so results do not depend on partitions or buckets.

Products of LONGs wrap modulo 2^64. A number is turned into logarithms: modulo 2^64 every odd number is
plus or minus a power of 5, so u = (-1)^s * 2^t * 5^k. The scan then adds s, t and k (and counts zeros) as
whole numbers, with the same machinery as any other sum, and the product is put together from the sums.

Sums of floats are done on whole numbers too: a value is cut into pieces of 40 bits on a fixed grid of
powers of two, which is exact, the pieces are added as decimals, and only the finished sums are rounded,
in a fixed order. Adding in another order or over other buckets gives the same bits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.scan import scan_columns

_MASK = (1 << 64) - 1
# 5 to the power 2^i modulo 2^64, and the inverses, for i from 0 to 61.
POWERS = [pow(5, 1 << i, 1 << 64) for i in range(62)]
INVERSES = [pow(p, -1, 1 << 64) for p in POWERS]
ORDER_OF_5 = 1 << 62
PIECE_BITS = 40
LOWEST = -1074  # every double is a multiple of this power of two

LOGS = "zero long, minus long, twos long, fives long"
EXACT = "decimal(38,0)"


def logarithms(values: np.ndarray) -> pd.DataFrame:
    """Columns zero, minus, twos, fives of signed 64-bit numbers."""
    u = values.astype(np.int64).view(np.uint64).copy()
    zero = u == 0
    u[zero] = 1
    lowest_bit = u & (~u + np.uint64(1))
    twos = np.log2(lowest_bit.astype(np.float64)).astype(np.uint64)
    u >>= twos
    # The bits shifted in from above are free to choose: u is known modulo 2^(64 - twos) only, and a
    # product with 2^twos does not look further.
    minus = (u & np.uint64(3)) == 3
    u[minus] = ~u[minus] + np.uint64(1)
    fives = np.zeros(len(u), np.uint64)
    for i in range(62):
        bit = (u >> np.uint64(i + 2) & np.uint64(1)).astype(bool)
        fives[bit] |= np.uint64(1 << i)
        u[bit] *= np.uint64(INVERSES[i])
    return pd.DataFrame(
        {"zero": zero.astype(np.int64), "minus": minus.astype(np.int64), "twos": twos.astype(np.int64), "fives": fives.astype(np.int64)}
    )


def product_of(zero: pd.Series, minus: pd.Series, twos: pd.Series, fives: pd.Series) -> pd.Series:
    """The signed 64-bit product of summed logarithms."""
    k = fives.to_numpy(np.int64).view(np.uint64)
    made = np.ones(len(k), np.uint64)
    for i in range(62):
        bit = (k >> np.uint64(i) & np.uint64(1)).astype(bool)
        made[bit] *= np.uint64(POWERS[i])
    odd = minus.to_numpy(np.int64) % 2 == 1
    made[odd] = ~made[odd] + np.uint64(1)
    t = twos.to_numpy(np.int64)
    made = made << np.minimum(t, 63).astype(np.uint64)
    made[(t > 63) | (zero.to_numpy(np.int64) > 0)] = 0
    return pd.Series(made.view(np.int64))


def _logs(value: Column) -> Column:
    @F.pandas_udf(LOGS)
    def logs(v: pd.Series) -> pd.DataFrame:
        return logarithms(v.to_numpy(np.int64))

    # Null is no factor; 1 has no logarithms.
    return logs(F.coalesce(value.cast("long"), F.lit(1).cast("long")))


def _product(zero: Column, minus: Column, twos: Column, fives: Column) -> Column:
    made = F.pandas_udf(product_of, "long")
    few = lambda c, most: F.least(c.cast(EXACT), F.lit(most).cast(EXACT)).cast("long")
    return made(
        few(zero, 1),
        F.pmod(minus.cast(EXACT), F.lit(2).cast(EXACT)).cast("long"),
        few(twos, 64),
        F.pmod(fives.cast(EXACT), F.lit(ORDER_OF_5).cast(EXACT)).cast("long"),
    )


def scan_products(df: DataFrame, value: str, order_by: Sequence[str], inclusive: bool = False, backward: bool = False,
                  partition_by: Sequence[str] = (), out: str = "scan", buckets: int | None = None) -> DataFrame:
    """Add column `out`: the product, modulo 2^64 as a signed LONG, of the whole numbers along `order_by`.

    Nulls are no factors; the first element of an exclusive scan is 1.
    """
    names = [part.split()[0] for part in LOGS.split(", ")]
    logs = df.withColumn("_logs", _logs(F.col(value)))
    parts = logs.withColumns({f"_{n}": F.col(f"_logs.{n}").cast(EXACT) for n in names}).drop("_logs")
    sums = scan_columns(
        parts, {f"_sum_{n}": f"_{n}" for n in names}, order_by, "add", inclusive, backward, partition_by, buckets
    )
    return sums.select(*df.columns, _product(*[F.col(f"_sum_{n}") for n in names]).alias(out))


def reduce_product(df: DataFrame, value: str) -> DataFrame:
    """One row `product`: of all values modulo 2^64 as a signed LONG; 1 without any."""
    logs = df.select(_logs(F.col(value)).alias("l"))
    names = [part.split()[0] for part in LOGS.split(", ")]
    sums = logs.agg(*[F.coalesce(F.sum(F.col(f"l.{n}").cast(EXACT)), F.lit(0).cast(EXACT)).alias(n) for n in names])
    return sums.select(_product(*[F.col(n) for n in names]).alias("product"))


def grid(df: DataFrame, value: str) -> list[int]:
    """Exponents of the pieces that the finite values of a column need, the highest first."""
    size = F.abs(F.col(value).cast("double"))
    finite = F.when(~F.isnan(size) & (size < float("inf")) & (size > 0), size)
    high, low = df.agg(F.max(finite), F.min(finite)).first()
    if high is None:
        return [0]
    last = max(LOWEST, math.frexp(low)[1] - 53)
    first = math.frexp(high)[1] - PIECE_BITS
    count = max(0, -(-(first - last) // PIECE_BITS)) + 1
    return [max(LOWEST, first - PIECE_BITS * i) for i in range(count)]


def cut(values: np.ndarray, exponents: Sequence[int]) -> np.ndarray:
    """Pieces of finite doubles on the grid: their sum times the powers of two is the value, exactly."""
    rest = values.astype(np.float64).copy()
    made = np.empty((len(rest), len(exponents)), np.int64)
    for i, e in enumerate(exponents):
        whole = np.trunc(np.ldexp(rest, -e))  # towards zero, so that the rest is exact
        made[:, i] = whole.astype(np.int64)
        rest = rest - np.ldexp(whole, e)
    return made


def _pieces(value: Column, exponents: Sequence[int]) -> Column:
    @F.pandas_udf("array<long>")
    def pieces(v: pd.Series) -> pd.Series:
        return pd.Series(list(cut(v.to_numpy(np.float64), exponents)))

    return pieces(value)


def _finite(value: Column) -> Column:
    """The value as a double where it is finite, else 0."""
    v = value.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.lit(0.0))


def _put_together(sums: Sequence[Column], exponents: Sequence[int], other: Column) -> Column:
    """Rounded sum of the pieces, the smallest first; `other` is what is not finite, or 0."""
    total = F.lit(0.0)
    for piece, e in reversed(list(zip(sums, exponents))):
        total = total + piece.cast("double") * F.lit(math.ldexp(1.0, e))
    return total + other


def scan_floats(df: DataFrame, value: str, order_by: Sequence[str], inclusive: bool = False, backward: bool = False,
                partition_by: Sequence[str] = (), out: str = "scan", buckets: int | None = None) -> DataFrame:
    """Add column `out`: the sum of the floats along `order_by`, the same bits whatever the buckets.

    Nulls add nothing; not-a-number and infinities take over from where they stand.
    """
    exponents = grid(df, value)
    v = F.col(value).cast("double")
    cuts = df.withColumn("_pieces", _pieces(_finite(F.col(value)), exponents))
    names = [f"_p{i}" for i in range(len(exponents))]
    parts = cuts.withColumns({n: F.get("_pieces", F.lit(i)).cast(EXACT) for i, n in enumerate(names)}).drop("_pieces")
    odd = {"_nan": F.isnan(v), "_up": v == float("inf"), "_down": v == float("-inf")}
    parts = parts.withColumns({n: F.coalesce(c, F.lit(False)).cast("long") for n, c in odd.items()})
    sums = scan_columns(
        parts, {f"_s{n}": n for n in [*names, *odd]}, order_by, "add", inclusive, backward, partition_by, buckets
    )
    nan, up, down = (F.col(f"_s{n}") > 0 for n in odd)
    other = (
        F.when(nan | (up & down), float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(0.0)
    )
    return sums.select(*df.columns, _put_together([F.col(f"_s{n}") for n in names], exponents, other).alias(out))
