import random

import pytest
from pyspark.sql import functions as F

import brute
from seqloom.operators import circuits as cg
from seqloom.operators import graph as g
from seqloom.plans.assembly import Assembly
from seqloom.storage import Scratch

A = (["ACGTC", "TACGT"], 3)
B = (["AACCA", "ACCAA"], 3)
C = (["AAAAN", "acgtW"], 4)


def reads_df(spark, reads):
    return spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")


def contig_texts(asm):
    parts = sorted(map(tuple, asm.contigs().collect()))
    out = {}
    for contig, _, seq in parts:
        out[contig] = out.get(contig, "") + seq
    return out


def random_reads(seed, alphabet, n, size):
    rng = random.Random(seed)
    base = "".join(rng.choice(alphabet) for _ in range(size))
    return [
        "".join(
            base[(at + i) % size] if rng.random() < 0.98 else rng.choice(alphabet)
            for i in range(rng.randint(3, 40))
        )
        for at in (rng.randrange(size) for _ in range(n))
    ]


def check(spark, reads, length):
    want = brute.assemble(reads, length)
    asm = Assembly(reads_df(spark, reads), length)
    rows = {r.eid: r for r in asm.edges().collect()}
    assert [rows[e].lmer for e in range(len(rows))] == want["edges"]
    assert [rows[e].s for e in range(len(rows))] == want["succ"]
    mask = (1 << (2 * (length - 1))) - 1
    assert all(r.v1 == want["idx"][r.lmer >> 2] and r.v2 == want["idx"][r.lmer & mask] for r in rows.values())
    for name, fn in (("leaving", g.leaving_list), ("entering", g.entering_list)):
        got = sorted((r.vidx, r.pos, r.eid) for r in fn(asm.graph).collect())
        assert got == [(v, p, e) for v, lst in enumerate(want[name]) for p, e in enumerate(lst)]
    offsets = 0, 0
    for v in sorted(g.euler_vertices(asm.graph).collect()):
        assert (v.vid, v.ep, v.lp) == (want["kmers"][v.vidx], *offsets)
        offsets = offsets[0] + v.ecount, offsets[1] + v.lcount
    prv = {r.id: r.prv for r in asm.links.collect()}
    assert {s: e for e, s in enumerate(want["succ"]) if s is not None} == {
        k: p for k, p in prv.items() if p is not None
    }
    assert [r.label for r in asm.chains.orderBy("id").collect()] == want["lab"]
    assert [r.label for r in cg.circuit_vertices(asm.chains).orderBy("circuit").collect()] == sorted(set(want["lab"]))
    got = [tuple(r)[1:] for r in asm.circuit_edges.orderBy("ceid").collect()]
    assert got == want["cedges"]
    assert sorted(r.ceid for r in asm.forest.collect()) == want["forest"]
    assert [r.s for r in asm.swiped_edges().orderBy("eid").collect()] == want["swiped"]
    assert {r.eid for r in asm.starts().collect()} == set(want["contigs"])
    assert contig_texts(asm) == want["contigs"]
    assert {r.contig: r.bases for r in asm.contig_lengths().collect()} == {
        k: len(v) for k, v in want["contigs"].items()
    }
    return asm, want


def test_example_a(spark):
    asm, want = check(spark, *A)
    assert want["succ"] == [4, 5, 6, 7, 9, 10, None, None, 0, 11, None, 1]
    assert want["swiped"] == [4, 6, 7, 5, 9, 10, None, None, 0, 11, None, 1]
    assert want["cedges"] == [(0, 1, 1, 2), (0, 1, 5, 6), (1, 2, 2, 3), (1, 2, 6, 7)]
    assert want["forest"] == [0, 2]
    assert want["contigs"] == {2: "ACGT", 3: "ACGTC", 8: "GACGTACGT"}


def test_example_b(spark):
    _, want = check(spark, *B)
    assert want["swiped"] == [1, 5, 4, 0, 3, None, None, 8, 11, 6, 7, 9]
    assert want["contigs"] == {2: "ACCAACCA", 10: "TGGTTGGT"}


def test_example_c(spark):
    _, want = check(spark, *C)
    assert want["swiped"] == [1, 0, None, 6, 7, 2, None, None]
    assert want["contigs"] == {3: "ACGTG", 4: "ATTTT", 5: "CACGT"}


@pytest.mark.parametrize("seed,alphabet,length", [(1, "ACGT", 5), (2, "ACGTN", 4), (3, "the café", 6)])
def test_random_reads(spark, seed, alphabet, length):
    check(spark, random_reads(seed, alphabet, 60, 80), length)


def test_one_hot_word(spark):
    """A single letter makes one word hold almost every edge."""
    check(spark, ["A" * 300, "ACGTTGCAAC", "AAAACAAAAG"], 4)


def test_full_width_words(spark):
    """32 bases use the sign bit; order must stay unsigned."""
    rng = random.Random(5)
    reads = ["".join(rng.choice("ACGT") for _ in range(45)) for _ in range(6)]
    want = brute.assemble(reads, 32)
    asm = Assembly(reads_df(spark, reads), 32)
    rows = asm.edges().orderBy("eid").collect()
    assert [r.lmer % (1 << 64) for r in rows] == want["edges"]
    assert [r.s for r in rows] == want["succ"]
    assert contig_texts(asm) == want["contigs"]


def test_invariants(spark):
    asm = Assembly(reads_df(spark, random_reads(9, "ACGT", 50, 60)), 5)
    total = asm.graph.words.agg(F.sum("cnt")).first()[0]
    v = asm.graph.vertices.agg(F.sum("ecount"), F.sum("lcount")).first()
    assert total == v[0] == v[1] == asm.edges().count()
    before = sorted(str(r.s) for r in asm.edges().collect())
    after = sorted(str(r.s) for r in asm.swiped_edges().collect())
    assert before == after


def test_no_reads_long_enough(spark):
    asm = Assembly(reads_df(spark, ["AC", ""]), 5)
    assert asm.edges().count() == 0
    assert asm.contigs().count() == 0


def test_sums_per_block_are_those_of_single_links(spark):
    asm = Assembly(reads_df(spark, random_reads(5, "ACG", 40, 30) + ["AAAAAAAA"] * 30), 4)
    rows = asm.links.groupBy(F.expr("id div 8").alias("block")).agg(
        F.sum("nxt").alias("sum_s"), F.sum("prv").alias("sum_p"), F.count("nxt").alias("paired")
    )
    want = sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    assert sorted(map(tuple, g.link_blocks(asm.graph, 8).collect()), key=lambda r: r[0]) == want
    starts = sorted(r.id for r in asm.links.filter("prv is null").collect())
    assert sorted(r.eid for r in g.unpaired_starts(asm.graph).collect()) == starts


def test_sums_per_block_do_not_make_copies(spark):
    """Two words of thousands of millions of copies: the work is in their blocks."""
    n = 3 * 10**9
    graph = g.build_graph(spark.createDataFrame([(0, n), (1, 5)], "lmer long, cnt long"), 3, Scratch(spark, "graph"))
    rows = sorted(map(tuple, g.link_blocks(graph, 1 << 30).collect()))
    # AAA enters and leaves AA with AAC behind it: each copy follows itself.
    cuts = [(i << 30, min((i + 1) << 30, n)) for i in range(3)]
    assert rows == [(i, *[sum_to(b) - sum_to(a)] * 2, b - a) for i, (a, b) in enumerate(cuts)]


def sum_to(n):
    return n * (n - 1) // 2
