import random

import pytest

from seqloom.operators.forest import spanning_forest
from seqloom.operators.swipe import swipe
from seqloom.storage import Scratch


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_spanning_forest(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr("seqloom.storage.BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(7)
    edges = []
    for _ in range(150):
        a, b = rng.sample(range(50), 2)
        edges.append((min(a, b), max(a, b)))
    edges += [(100, 101 + i) for i in range(30)]
    rng.shuffle(edges)
    top = list(range(200))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    want = []
    for i, (a, b) in enumerate(edges):
        x, y = find(a), find(b)
        if x != y:
            top[x] = y
            want.append(i)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "ceid long, c1 long, c2 long")
    with Scratch(spark, "t") as scratch:
        got = sorted(r.ceid for r in spanning_forest(df, scratch).collect())
    assert got == want


def test_swipe_runs(spark):
    """Random marks on long entering lists, several runs per list, some successors missing."""
    rng = random.Random(11)
    edges, marks, want, eid = [], [], {}, 0
    for v in range(6):
        n = rng.randrange(1, 40)
        ids = list(range(eid, eid + n))
        eid += n
        s = {e: None if rng.random() < 0.2 else 1000 + e for e in ids}
        marked = {e for e in ids[:-1] if rng.random() < 0.5}
        edges += [(e, v, s[e]) for e in ids]
        marks += [(e, e + 1) for e in marked]
        i = 0
        while i < n:
            t = i
            while i < n and ids[i] in marked:
                want[ids[i]] = s[ids[i + 1]]
                i += 1
            want[ids[i]] = s[ids[t]]
            i += 1
    e = spark.createDataFrame(edges, "eid long, v2 long, s long")
    m = spark.createDataFrame(marks, "eid long, nx long")
    with Scratch(spark, "t") as scratch:
        got = {r.eid: r.s for r in swipe(e, m, scratch).collect()}
    assert got == want
