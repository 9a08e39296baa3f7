import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators.scan import dense_index, following, order_bucket, scan, segmented_scan


def rows(n=300, hot=0.4, seed=3):
    """Rows (t, i, p, x, flag) where one partition and one time value hold many rows."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        p = 0 if rng.random() < hot else rng.randrange(1, 6)
        t = 5 if rng.random() < hot else rng.randrange(50)
        made.append((t, i, p, rng.randrange(-9, 10), int(rng.random() < 0.1)))
    return made


SCHEMA = "t int, i long, p int, x int, flag int"
OPS = {"add": (lambda a, b: a + b, 0), "min": (min, None), "max": (max, None), "multiply": (lambda a, b: a * b, 1.0)}


def model(items, op, inclusive, backward):
    fn, empty = OPS[op]
    seq = list(reversed(items)) if backward else list(items)
    sums = list(itertools.accumulate(seq, fn))
    out = sums if inclusive else [empty, *sums[:-1]]
    return list(reversed(out)) if backward else out


@pytest.mark.parametrize("op", ["add", "min", "max"])
@pytest.mark.parametrize("inclusive,backward", [(False, False), (True, True)])
def test_scan(spark, op, inclusive, backward):
    data = sorted(rows())
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.i: r.scan for r in scan(df, "x", ["t", "i"], op, inclusive, backward, buckets=7).collect()}
    want = model([r[3] for r in data], op, inclusive, backward)
    assert [got[r[1]] for r in data] == want


def test_multiply(spark):
    data = sorted((t, i, p, 1 if x % 2 else -2, f) for t, i, p, x, f in rows(60))
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.i: r.scan for r in scan(df, "x", ["t", "i"], "multiply", buckets=5).collect()}
    assert [got[r[1]] for r in data] == model([r[3] for r in data], "multiply", False, False)


@pytest.mark.parametrize("op,backward", [("add", False), ("max", True)])
def test_partitioned_scan(spark, op, backward):
    data = sorted(rows())
    df = spark.createDataFrame(data, SCHEMA)
    out = scan(df, "x", ["t", "i"], op, True, backward, ["p"], buckets=6)
    got = {r.i: r.scan for r in out.collect()}
    for p in {r[2] for r in data}:
        mine = [r for r in data if r[2] == p]
        assert [got[r[1]] for r in mine] == model([r[3] for r in mine], op, True, backward)


def test_null_partition_key(spark):
    df = spark.createDataFrame([(1, None, 2), (2, None, 3), (3, 1, 4)], "i long, p int, x int")
    got = {r.i: r.scan for r in scan(df, "x", ["i"], inclusive=True, partition_by=["p"], buckets=2).collect()}
    assert got == {1: 2, 2: 5, 3: 4}


@pytest.mark.parametrize("backward", [False, True])
def test_segmented_scan(spark, backward):
    data = sorted(rows())
    df = spark.createDataFrame(data, SCHEMA)
    got = {
        r.i: r.scan
        for r in segmented_scan(df, "x", "flag", ["t", "i"], "add", False, backward, buckets=6).collect()
    }
    segments, part = [], []
    for r in data:
        if r[4] and part:
            segments.append(part)
            part = []
        part.append(r)
    segments.append(part)
    for seg in segments:
        assert [got[r[1]] for r in seg] == model([r[3] for r in seg], "add", False, backward)


def test_dense_index_over_strings_and_nulls(spark):
    words = ["b", "a", None, "ba", "", "é", "zz'\\"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in dense_index(df, ["w"], buckets=4).orderBy("idx").collect()]
    assert got == [None, "", "a", "b", "ba", "zz'\\", "é"]


def test_hot_leading_key_is_split(spark):
    """All rows share the first key; the buckets must follow the second one."""
    df = spark.range(4000).select(F.lit(1).alias("t"), "id")
    number, found = order_bucket(df, ["t", "id"], 8)
    sizes = [r["count"] for r in df.groupBy(number.alias("b")).count().collect()]
    assert found == len(sizes) == 8 and max(sizes) < 1000


def test_following(spark):
    data = sorted(rows(80))
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.i: r.following for r in following(df, "i", ["t", "i"], ["p"]).collect()}
    for p in {r[2] for r in data}:
        mine = [r[1] for r in data if r[2] == p]
        assert [got[i] for i in mine] == [*mine[1:], None]
