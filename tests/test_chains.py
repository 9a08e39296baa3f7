import random

import pytest

from seqloom.operators import chains as ch
from seqloom.operators.components import connected_components, degree_two_components
from seqloom.operators.primitives import list_rank
from seqloom.storage import Scratch


def links_of(paths, cycles):
    out = []
    for p in paths:
        out += [(v, p[i - 1] if i else None, p[i + 1] if i + 1 < len(p) else None) for i, v in enumerate(p)]
    for c in cycles:
        out += [(v, c[i - 1], c[(i + 1) % len(c)]) for i, v in enumerate(c)]
    return out


@pytest.mark.parametrize("at_once", [1, 3, None])
def test_trace_chains(spark, monkeypatch, at_once):
    if at_once:
        monkeypatch.setattr(ch, "_rounds_at_once", lambda n: at_once)
    rng = random.Random(at_once or 0)
    ids = list(range(400))
    rng.shuffle(ids)
    paths, cycles = [ids[:150], ids[150:152], [ids[152]]], [ids[153:300], ids[300:302], [ids[302]]]
    links = spark.createDataFrame(links_of(paths, cycles), "id long, prv long, nxt long")
    with Scratch(spark, "t") as scratch:
        got = {r.id: r for r in ch.trace_chains(links, scratch).collect()}
    names = {low: i for i, low in enumerate(sorted(min(c) for c in paths + cycles))}
    for chain in paths + cycles:
        for v in chain:
            assert got[v].label == min(chain) and got[v].circuit == names[min(chain)]
    for p in paths:
        assert [(got[v].head, got[v].rank, got[v].is_cycle) for v in p] == [
            (p[0], i, False) for i in range(len(p))
        ]
    assert all(got[v].is_cycle for c in cycles for v in c)


def test_list_rank(spark):
    rng = random.Random(2)
    ids = list(range(60))
    rng.shuffle(ids)
    paths = [ids[:40], ids[40:59], ids[59:]]
    rows = [(v, n) for v, _, n in links_of(paths, [])]
    df = spark.createDataFrame(rows, "id long, nxt long")
    with Scratch(spark, "t") as scratch:
        got = {(r.id, r.head, r.rank) for r in list_rank(df, "id", "nxt", scratch).collect()}
    assert got == {(v, p[0], i) for p in paths for i, v in enumerate(p)}


def union_find(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(top)}


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_connected_components(spark, monkeypatch, broadcast_rows):
    """Random graph, a star with the largest id in the middle, and a loop; both kinds of lookup."""
    monkeypatch.setattr("seqloom.storage.BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(999, 200 + i) for i in range(40)] + [(500, 500)] + [(600 + i, 601 + i) for i in range(20)]
    df = spark.createDataFrame(edges, "a long, b long")
    with Scratch(spark, "t") as scratch:
        got = {r.id: r.label for r in connected_components(df, scratch).collect()}
    assert got == union_find(edges)


def test_degree_two_components(spark):
    rows = links_of([[5, 3, 9], [7]], [[1, 8, 2]])
    df = spark.createDataFrame([(v, n, p) for v, p, n in rows], "vid long, n1 long, n2 long")
    with Scratch(spark, "t") as scratch:
        got = {r.id: r.label for r in degree_two_components(df, scratch).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 7, 1: 1, 8: 1, 2: 1}


def test_list_rank_over_negative_ids(spark):
    """No id of a list stands for "no neighbour"."""
    from seqloom.operators.primitives import list_rank
    from seqloom.storage import Scratch

    rows = spark.createDataFrame([(-3, -2), (-2, -1), (-1, 0), (0, 1), (1, None)], "node long, next long")
    with Scratch(spark, "ranks") as scratch:
        got = sorted(map(tuple, list_rank(rows, "node", "next", scratch).collect()))
    assert got == [(i, -3, i + 3) for i in range(-3, 2)]
