"""Exact products and float sums against Python's whole numbers and fsum."""

import math
import random

import numpy as np
import pytest

from seqloom.operators import exact


def wrapped(n):
    n &= (1 << 64) - 1
    return n - ((n >> 63) << 64)


def test_logarithms():
    rng = random.Random(1)
    values = [0, 1, -1, 2, -2, 5, 3, 2**62, -(2**63), 2**63 - 1, 4096, -4097] + [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    logs = exact.logarithms(np.array(values, np.int64))
    assert exact.product_of(*[logs[c] for c in logs]).tolist() == values


@pytest.mark.parametrize("buckets", [1, 7, 64])
@pytest.mark.parametrize("inclusive,backward", [(True, False), (False, False), (False, True)])
def test_products_wrap(spark, buckets, inclusive, backward):
    rng = random.Random(2)
    rows = [(i, i % 3, rng.choice([2, 3, 4, 5, -7, 10**12 + 39, 1])) for i in range(300)]
    rows += [(300 + i, 1, v) for i, v in enumerate([None, 0, 9])]
    df = spark.createDataFrame(rows, "k long, part int, v long")
    got = {r.k: r.scan for r in exact.scan_products(df, "v", ["k"], inclusive, backward, ["part"], buckets=buckets).collect()}
    want = {}
    for part in range(3):
        running = 1
        for k, _, v in sorted((r for r in rows if r[1] == part), reverse=backward):
            before, running = running, wrapped(running * (1 if v is None else v))
            want[k] = running if inclusive else before
    assert got == want


def test_product_of_a_column(spark):
    values = [3, -5, 2**40 + 1, 6, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert exact.reduce_product(df, "v").first()[0] == wrapped(3 * -5 * (2**40 + 1) * 6)
    assert exact.reduce_product(df.limit(0), "v").first()[0] == 1


def test_cut_is_exact():
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 30) for _ in range(500)] + [0.0, 5e-324, -1e-310]
    low = min(abs(v) for v in values if v)
    last, first = max(exact.LOWEST, math.frexp(low)[1] - 53), math.frexp(max(map(abs, values)))[1] - exact.PIECE_BITS
    exponents = [max(exact.LOWEST, first - exact.PIECE_BITS * i) for i in range(-(-(first - last) // exact.PIECE_BITS) + 1)]
    from fractions import Fraction

    for v, row in zip(values, exact.cut(np.array(values), exponents)):
        assert sum(Fraction(int(p)) * Fraction(2) ** e for p, e in zip(row, exponents)) == Fraction(v)


def test_float_sums_are_the_same_bits_for_any_buckets(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-1, 1) * 10.0 ** rng.randint(-6, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v double")
    made = []
    for buckets in (1, 7, 64):
        got = exact.scan_floats(df.repartition(buckets % 5 + 1), "v", ["k"], inclusive=True, buckets=buckets).collect()
        made.append({r.k: r.scan.hex() for r in got})
    assert made[0] == made[1] == made[2]
    for k, text in made[0].items():
        want = math.fsum(v for i, v in rows if i <= k)
        assert abs(float.fromhex(text) - want) <= 2 * math.ulp(want) + 1e-18


def test_float_sums_of_odd_values(spark):
    rows = [(0, None), (1, 1.5), (2, float("inf")), (3, 2.0), (4, float("-inf")), (5, 1.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = [r.scan for r in sorted(exact.scan_floats(df, "v", ["k"], inclusive=True).collect())]
    assert got[:4] == [0.0, 1.5, math.inf, math.inf] and math.isnan(got[4]) and math.isnan(got[5])
    assert exact.scan_floats(df.limit(0), "v", ["k"]).count() == 0
    same = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k long, v float")
    assert abs(max(r.scan for r in exact.scan_floats(same, "v", ["k"], inclusive=True).collect()) - 0.3) < 1e-7
