"""Neighbours in entering lists by blocks of ids against the lists themselves."""

import random

from seqloom.operators import circuits as cg
from seqloom.operators import graph as g
from seqloom.operators.words import word_counts
from seqloom.plans.assembly import Assembly


def test_touching_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(cg, "BLOCK", 8)  # words and lists cross many blocks
    rng = random.Random(8)
    text = "".join(rng.choice("ACGT") for _ in range(120))
    reads = [text[i : i + 40] for i in range(0, 80, 11)] + ["A" * 25, "ACG" * 9]
    asm = Assembly(spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"), 6)
    circuit = {r.id: r.circuit for r in asm.chains.collect()}
    lists = {}
    for r in g.entering_list(asm.graph).collect():
        lists.setdefault(r.vidx, []).append((r.pos, r.eid))
    want = set()
    for edges in lists.values():
        ids = [e for _, e in sorted(edges)]
        want |= {(*sorted((circuit[a], circuit[b])), a, b) for a, b in zip(ids, ids[1:]) if circuit[a] != circuit[b]}
    got = [tuple(r) for r in asm.touching.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_entering_ranges(spark):
    counts = word_counts(spark.createDataFrame([(1, "ACGTACGGT")], "read_id long, seq string"), 4)
    asm = Assembly(spark.createDataFrame([(1, "ACGTACGGT")], "read_id long, seq string"), 4)
    got = g.entering_ranges(asm.graph).collect()
    assert sum(r.cnt for r in got) == counts.groupBy().sum("cnt").first()[0]
    after = {r.nx for r in got if r.nx is not None}
    assert after == {r.e for r in got if r.later}
