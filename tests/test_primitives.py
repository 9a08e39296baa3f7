import random

import numpy as np
import pytest

from seqloom.functions import hashing as h
from seqloom.operators import hashindex as hx
from seqloom.operators import matrix as mx
from seqloom.operators import primitives as pr
from seqloom.operators.suffixes import suffix_array
from seqloom.storage import Scratch

M64 = (1 << 64) - 1


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_hashes_wrap_like_64_bit_integers(spark):
    rng = random.Random(1)
    keys = [0, 1, M64, 1 << 63, (1 << 32) - 1] + [rng.getrandbits(64) for _ in range(200)]
    df = spark.createDataFrame([(signed(k),) for k in keys], "key long")
    for seed in (0, 1, 4000000007, 0xFFFFFFFF):
        rows = {r.key: r for r in hx.slot_candidates(df, "key", seed, keys=10_000).collect()}
        for k in keys:
            r = rows[signed(k)]
            assert r.bucket == ((h.ADD_H + h.MUL_H * k) & M64) % h.LARGE_PRIME % 25
            for slot, base, xor, mul in (
                (r.slot1, 0, h.XOR_G1, h.MUL_G1), (r.slot2, 192, h.XOR_G2, h.MUL_G2), (r.slot3, 384, h.XOR_G3, h.MUL_G3)
            ):
                assert slot == base + (xor ^ ((seed + (mul ^ seed) * k) & M64)) % h.LARGE_PRIME % 192


def test_probe(spark):
    keys = random.Random(2).sample(range(1 << 40), 900)
    index = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, value long")
    asked = spark.createDataFrame([(keys[5],), (-1,), (keys[7],)], "q long")
    got = {r.q: r.value for r in hx.probe(asked, "q", index, h.MISS).collect()}
    assert got == {keys[5]: 5, keys[7]: 7, -1: 4294967295}
    assert {r.q: r.value for r in hx.probe(asked, "q", index).collect()}[-1] is None


def test_multi_value(spark):
    data = [(k, v) for k in (3, 1, 1, 2) for v in (k * 10, k * 10 + 1)]
    data = sorted({(k, v + i) for i, (k, v) in enumerate(data)})
    df = spark.createDataFrame(data, "k long, v long")
    values = [(r.key, r.value) for r in hx.multi_value_values(df, "k", "v").orderBy("idx").collect()]
    assert values == data
    for r in hx.multi_value_keys(df, "k").collect():
        assert {k for k, _ in data[r["offset"] : r["offset"] + r["count"]]} == {r["key"]}


def test_compact(spark):
    data = [(i, int(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(data, "i long, ok int")
    kept = [i for i, ok in data if ok]
    assert [r.i for r in pr.compact(df, "ok", ["i"]).orderBy("idx").collect()] == kept
    assert [r.i for r in pr.compact(df, "ok", ["i"], backward=True).orderBy("idx").collect()] == kept[::-1]


def test_reduce_and_sort(spark):
    df = spark.createDataFrame([(2, "b"), (3, "a"), (-4, "c")], "x long, s string")
    assert tuple(pr.reduce_column(df, "x").first()) == (1, -24.0, -4, 3)
    assert [r.s for r in pr.sort(df, ["s"], descending=True).collect()] == ["c", "b", "a"]


def test_random_words_depend_on_seed_and_index_only(spark):
    one = sorted(map(tuple, pr.random_words(spark.range(50), "id", 1).collect()))
    again = sorted(map(tuple, pr.random_words(spark.range(50).repartition(7), "id", 1).collect()))
    assert one == again != sorted(map(tuple, pr.random_words(spark.range(50), "id", 2).collect()))
    assert all(0 <= v < 1 << 32 for row in one for v in row[1:])


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_spmv(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr("seqloom.storage.BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(3)
    entries = [(rng.randrange(20), rng.choice([0, 0, rng.randrange(15)]), rng.randrange(9)) for _ in range(200)]
    dense = np.zeros((20, 15), dtype=int)
    for r, c, a in entries:
        dense[r, c] += a
    x = [rng.randrange(9) for _ in range(15)]
    m = spark.createDataFrame(entries, "r long, c long, a long")
    v = spark.createDataFrame(list(enumerate(x)), "c long, x long")
    got = {r.row: r.y for r in mx.spmv(m, v, "r", "c", "a", "c", "x").collect()}
    want = dense @ np.array(x)
    assert all(got.get(i, 0) == want[i] for i in range(20))


def test_tridiagonal(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for system, n in enumerate([1, 2, 3, 17, 40]):
        a, c, d = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n), rng.uniform(-9, 9, n)
        b = 3 + rng.uniform(0, 1, n)
        full = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
        for i, x in enumerate(np.linalg.solve(full, d)):
            want[system, i] = x
        a[0] = c[-1] = 0.0
        rows += [(system, i, float(a[i]), float(b[i]), float(c[i]), float(d[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "system long, i long, a double, b double, c double, d double")
    with Scratch(spark, "t") as scratch:
        got = {(r.system, r.i): r.x for r in mx.solve_tridiagonal(df, scratch).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_suffix_array(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr("seqloom.storage.BROADCAST_ROWS", broadcast_rows)
    texts = ["banana" * 5, "ana", "", "banana" * 5, "aaaaaaaaaaaaaaaaaaaaaaaa", "été", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, t string")
    with Scratch(spark, "t") as scratch:
        got = [(r.id, r.pos) for r in suffix_array(df, "n", "t", scratch).orderBy("idx").collect()]
    want = sorted(
        ((t.encode()[p:], n, p) for n, t in enumerate(texts) for p in range(len(t.encode())))
    )
    assert got == [(n, p) for _, n, p in want]
