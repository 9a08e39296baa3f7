"""Read correction, consistency checks and circular contigs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import checks
from seqloom.operators import contigs as ct
from seqloom.operators import graph as g
from seqloom.operators.checks import graph_checks
from seqloom.operators.correction import correct_reads, valley
from seqloom.plans.assembly import Assembly
from seqloom.storage import Scratch

READS = "read_id long, seq string"


def sampled(seed, wrong):
    """Reads of 80 bases over a random sequence; every fourth has `wrong` wrong bases."""
    rng = random.Random(seed)
    whole = "".join(rng.choice("ACGT") for _ in range(1500))
    truth, made = [], []
    for i in range(500):
        at = rng.randrange(len(whole) - 80)
        read = list(whole[at : at + 80])
        truth.append("".join(read))
        if i % 4 == 0 and 150 < at < len(whole) - 230:
            first = rng.randrange(18, 38)
            for place in (first, first + 24)[:wrong]:
                read[place] = rng.choice([c for c in "ACGT" if c != read[place]])
        made.append("".join(read))
    return truth, made


@pytest.mark.parametrize("wrong", [1, 2])
def test_planted_errors_are_repaired(spark, wrong):
    truth, made = sampled(wrong, wrong)
    odd = [(9000, None), (9001, "ACG"), (9002, ""), (None, "ACGT" * 20)]
    reads = spark.createDataFrame([*enumerate(made), *odd], READS).withColumn("extra", F.lit("kept")).repartition(3)
    got = correct_reads(reads, 17)
    assert got.columns == reads.columns and got.count() == reads.count()
    found = {r.read_id: r.seq for r in got.collect()}
    assert [found[i] for i in range(len(truth))] == truth and made != truth
    assert all(found[i] == seq for i, seq in odd)


def test_reads_without_a_valley_stay(spark):
    reads = spark.createDataFrame([(i, "ACGTTGCA" * 4) for i in range(5)], READS)
    assert {r.seq for r in correct_reads(reads, 17).collect()} == {"ACGTTGCA" * 4}
    assert correct_reads(reads.limit(0), 17).count() == 0


def test_words_that_also_occur_elsewhere(spark):
    """Reads at every 6th base, 9-mers of which one in fifty random ones occurs: right reads stay right."""
    rng = random.Random(3)
    truth, made = [], []
    for _ in range(10):
        whole = "".join(rng.choice("ACGT") for _ in range(500))
        for i in range((500 - 60) // 6 + 1):
            read = whole[6 * i : 6 * i + 60]
            truth.append(read)
            if i % 7 == 3 and 60 <= 6 * i <= 380:
                at = rng.randrange(12, 48)
                read = read[:at] + rng.choice([c for c in "ACGT" if c != read[at]]) + read[at + 1 :]
            made.append(read)
    reads = spark.createDataFrame([*enumerate(made)], READS)
    found = {r.read_id: r.seq for r in correct_reads(reads, 9).collect()}
    assert made != truth and [i for i in found if found[i] != truth[i]] == []


def test_too_many_repairs_leave_a_read(spark):
    truth, made = sampled(5, 2)
    got = correct_reads(spark.createDataFrame([*enumerate(made)], READS), 17, max_positions=1, rounds=1)
    found = {r.read_id: r.seq for r in got.collect()}
    assert [found[i] for i in range(len(made))] == made


def test_valley(spark):
    counts = lambda *pairs: spark.createDataFrame(
        [(i, c) for i, c in enumerate(c for c, n in pairs for _ in range(n))], "lmer long, cnt long"
    )
    assert valley(counts((1, 9), (2, 3), (3, 1), (4, 5), (5, 2))) == 3
    assert valley(counts((1, 9), (5, 2))) == 2  # nothing between them
    assert valley(counts((1, 9), (2, 4))) == 1 and valley(counts()) == 1


def test_correction_in_an_assembly(spark):
    truth, made = sampled(7, 1)
    lengths = lambda rows, **more: sorted(
        r.bases for r in Assembly(spark.createDataFrame([*enumerate(rows)], READS), 17, **more).contig_lengths().collect()
    )
    assert lengths(made, ec_tuple_size=17) == lengths(truth)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    reads = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(30))) for i in range(20)], READS)
    asm = Assembly(reads, 5)
    return asm.graph.words, asm.graph.vertices, asm.edges(), asm


def broken(spark, tables, vertices=None, edges=None):
    words, v, e, _ = tables
    rows = graph_checks(words, v if vertices is None else vertices, e if edges is None else edges, Scratch(spark, "checks"))
    return {r.check: (r.bad, r.first) for r in rows.collect() if r.bad}


def test_sound_tables(spark, tables):
    rows = {r.check: r for r in tables[3].checks().collect()}
    total = tables[2].count()
    assert all(r.bad == 0 for r in rows.values()) and len(rows) == 17
    assert {rows[c].value for c in ("words", "edges", "entering", "leaving")} == {total}
    assert rows["successor_unset"].value == tables[2].filter("s is null").count()


def test_broken_tables_are_found(spark, tables):
    _, v, e, _ = tables
    total = e.count()
    moved = v.withColumn("ep", F.when(F.col("vidx") == 7, F.col("ep") + 1).otherwise(F.col("ep")))
    assert broken(spark, tables, vertices=moved) == {"entering_step": (2, 7)}
    more = v.withColumn("lcount", F.when(F.col("vidx") == 3, F.col("lcount") + 1).otherwise(F.col("lcount")))
    found = broken(spark, tables, vertices=more)
    assert found["leaving_count"] == (1, 3) and found["leaving_step"] == (1, 4) and found["leaving"][0] == 1
    far = v.withColumn("lp", F.when(F.col("vidx") == 5, F.lit(total)).otherwise(F.col("lp")))
    assert broken(spark, tables, vertices=far)["leaving_offset"] == (1, 5)
    assert broken(spark, tables, vertices=v.filter("vidx <> 4"))["vertex_missing"] == (1, 4)
    paired = e.filter("s is not null").orderBy("eid").limit(2).collect()
    a, b = paired[0], paired[1]
    twice = e.withColumn("s", F.when(F.col("eid") == a.eid, F.lit(b.s)).otherwise(F.col("s")))
    assert broken(spark, tables, edges=twice)["successor_shared"] == (1, b.s)
    gone = e.withColumn("s", F.when(F.col("eid") == a.eid, F.lit(total + 5)).otherwise(F.col("s")))
    found = broken(spark, tables, edges=gone)
    assert found["successor_range"] == (1, a.eid) and found["successor_missing"] == (1, total + 5)
    other = e.filter(F.col("v1") != a.v2).orderBy("eid").first().eid
    astray = e.withColumn("s", F.when(F.col("eid") == a.eid, F.lit(other)).otherwise(F.col("s")))
    assert broken(spark, tables, edges=astray)["successor_elsewhere"][0] >= 1
    assert broken(spark, tables, edges=e.filter(F.col("eid") != a.eid))["edges"][0] == 1


def test_copies_are_checked_as_ranges(spark):
    """Words of a thousand million copies: their edges are never made one by one."""
    counts = spark.createDataFrame([(w, 10**9 + 7 * w) for w in range(0, 64, 3)], "lmer long, cnt long")
    graph = g.build_graph(counts, 3, Scratch(spark, "graph"))
    total = sum(10**9 + 7 * w for w in range(0, 64, 3))
    ranges = g.edge_ranges(graph)
    rows = {r.check: r for r in graph_checks(graph.words, graph.vertices, ranges, Scratch(spark, "checks")).collect()}
    assert all(r.bad == 0 for r in rows.values()) and rows["edges"].value == rows["entering"].value == total
    hit = ranges.filter("slen > 0").orderBy("eid0").first()
    far = ranges.withColumn("s0", F.when(F.col("eid0") == hit.eid0, F.lit(total - 5)).otherwise(F.col("s0")))
    bad = {r.check: (r.bad, r.first) for r in graph_checks(graph.words, graph.vertices, far, Scratch(spark, "checks")).collect() if r.bad}
    assert bad["successor_range"] == (hit.slen - 5, hit.eid0 + 5) and bad["successor_missing"] == (hit.slen - 5, total)


def test_met_pieces_as_single_ids():
    rng = np.random.default_rng(3)
    for n, span in ((1, 9), (40, 60), (400, 30), (300, 4000)):
        start = rng.integers(0, span, n)
        stop = start + rng.integers(1, span, n)
        values = [rng.integers(0, 9, n) for _ in range(4)]
        want = {}
        for a, b, *v in zip(start, stop, *values):
            for i in range(a, b):
                t = want.get(i)
                want[i] = [max(t[0], v[0]), min(t[1], v[1]), max(t[2], v[2]), t[3] + v[3]] if t else v
        got = {}
        for a, b, *v in zip(*checks.met_pieces((start, stop, *values))):
            got.update({i: v for i in range(a, b)})
        assert got == want


def cycles(spark, rings, **options):
    """Rings of base texts as chains and edges, numbered in a shuffled order."""
    rng = random.Random(4)
    ids = list(range(sum(map(len, rings))))
    rng.shuffle(ids)
    chains, edges, at = [], [], 0
    for ring in rings:
        own = ids[at : at + len(ring)]
        at += len(ring)
        for rank, (i, base) in enumerate(zip(own, ring)):
            chains.append((i, own[0], rank, True))
            edges.append((i, "ACGT".index(base)))
    chains += [(10_000, 10_000, 0, False)]
    c = spark.createDataFrame(chains, "id long, head long, rank long, is_cycle boolean")
    e = spark.createDataFrame(edges + [(10_000, 1)], "eid long, lmer long")
    found = {}
    for r in ct.cycle_parts(c, e, Scratch(spark, "cycles"), **options).collect():
        found.setdefault(r.contig, {})[r.part] = (r.seq, r.bases)
    return sorted("".join(parts[p][0] for p in sorted(parts)) for parts in found.values()), found


def least(ring):
    return min(ring[i:] + ring[:i] for i in range(len(ring)))


def test_cycles_begin_at_their_least_rotation(spark):
    rng = random.Random(6)
    rings = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (1, 2, 3, 7, 16, 33)] + ["AAAA", "ACAC", "GTGTGT", "T"]
    seqs, found = cycles(spark, rings)
    assert seqs == sorted(map(least, rings))
    turned = [r[3 % len(r) :] + r[: 3 % len(r)] for r in rings]
    assert cycles(spark, turned)[0] == seqs
    parted, found = cycles(spark, rings, part_edges=5)
    assert parted == seqs and all(len(s) <= 5 and n >= len(s) for parts in found.values() for s, n in parts.values())
    assert cycles(spark, [])[0] == []


def test_a_repeated_base_gives_one_circular_contig(spark):
    asm = Assembly(spark.createDataFrame([(1, "AAAAAAA")], READS), 4)
    assert {(r.seq, r.bases) for r in asm.cycle_contigs().collect()} == {("AAAA", 4), ("TTTT", 4)}
    assert asm.contigs().count() == 0
