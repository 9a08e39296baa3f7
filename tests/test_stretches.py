"""Stretches followed inside tasks against chains followed edge by edge."""

import random

import numpy as np
import pytest

from seqloom.operators import graph as g
from seqloom.operators import stretches as st
from seqloom.operators.chains import trace_chains
from seqloom.operators.words import word_counts
from seqloom.storage import Scratch


def test_followed():
    rng = random.Random(5)
    ids = rng.sample(range(1000), 120)
    lists = [ids[:40], ids[40:41], ids[41:70]]
    cycles = [ids[70:78], ids[78:80], ids[80:81], ids[81:88]]  # also of 1, 2 and 8 edges
    onward = {a: b for p in lists for a, b in zip(p, p[1:])} | {p[-1]: -1 for p in lists}
    onward |= {a: c[(i + 1) % len(c)] for c in cycles for i, a in enumerate(c)}
    onward |= {ids[88]: 5000, **{a: -1 for a in ids[89:]}}  # one goes on elsewhere
    some = list(onward)
    rng.shuffle(some)
    order, start = st.followed(np.array(some), np.array([onward[a] for a in some]))
    got = [[some[j] for j in order[a:b]] for a, b in zip(start, [*start[1:], len(order)])]
    turned = [c[c.index(min(c)) :] + c[: c.index(min(c))] for c in cycles]
    assert sorted(got) == sorted([*lists, *turned, [ids[88]], *[[a] for a in ids[89:]]])


@pytest.mark.parametrize("at_once,longest", [(1 << 21, 1 << 12), (50, 3)])
def test_chains_of_stretches(spark, monkeypatch, at_once, longest):
    monkeypatch.setattr(st, "COPIES_PER_ROW", 7)
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(300))
    reads = [text[i : i + 60] for i in range(0, 240, 9)] + ["A" * 30] * 3 + ["ACG" * 12, "GATTACA" * 6, "", "AC"]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    with Scratch(spark, "t") as scratch:
        graph = g.build_graph(word_counts(df, 7), 7, scratch)
        want = {r.id: r for r in trace_chains(g.successor_links(graph), scratch).collect()}
        stretches = st.stretches(g.successor_ranges(graph), 6, at_once, longest).collect()
        got = {r.id: r for r in st.trace_stretches(g.successor_ranges(graph), 6, scratch, at_once, longest).collect()}
    assert got.keys() == want.keys() and sorted(v for s in stretches for v in s.nodes) == sorted(want)
    assert len(stretches) < len(want)
    for s in stretches:
        assert (s.id, s.low, s.size) == (s.nodes[0], min(s.nodes), len(s.nodes)) and s.size <= longest
    for v, r in want.items():
        assert (got[v].label, got[v].circuit, got[v].is_cycle) == (r.label, r.circuit, r.is_cycle)
        if not r.is_cycle:
            assert (got[v].head, got[v].rank) == (r.head, r.rank)
    for label in {r.label for r in want.values() if r.is_cycle}:
        ring = {r.rank: v for v, r in got.items() if r.label == label}
        assert sorted(ring) == list(range(len(ring))) and got[ring[0]].head == ring[0]


def test_place_key_of_neighbours(spark):
    """Most vertices that follow each other have the same key."""
    rng = random.Random(1)
    words = [rng.getrandbits(32) for _ in range(500)]
    df = spark.createDataFrame([(w, (w << 2 | 1) & (1 << 32) - 1) for w in words], "a long, b long")
    a, b = (st.place_key(df[c], 16) for c in "ab")
    assert df.where(a == b).count() > 350
