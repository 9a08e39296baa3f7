import pytest
from pyspark.sql import functions as F

import brute
from seqloom.functions import encoding as enc
from seqloom.operators import words as wd

READS = ["ACGTNNacgt", "the café \x01\x07", "AAAAAAA", "GT", "", "TTGACCA" * 5]


def df(spark, reads=READS):
    return spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")


@pytest.mark.parametrize("length", [2, 5, 7])
def test_windows_and_positions(spark, length):
    got = {
        (r.read_id, r.strand, r.pos): r.lmer for r in wd.windows(df(spark), length).collect()
    }
    want = {}
    for i, s in enumerate(READS):
        pairs = list(brute.windows(s, length))
        for p, (f, r) in enumerate(pairs):
            want[i, "f", p] = f
            want[i, "r", len(pairs) - 1 - p] = r
    assert got == want


def test_long_read_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(wd, "PIECE", 8)
    seq = "ACGTTGCANNACCGTAACGTTTGACA" * 3
    rows = wd.windows(df(spark, [seq]), 5).collect()
    pairs = list(brute.windows(seq, 5))
    assert len(rows) == 2 * len(pairs)
    at = {(r.strand, r.pos): r.lmer for r in rows}
    assert [at["f", p] for p in range(len(pairs))] == [f for f, _ in pairs]
    assert [at["r", p] for p in range(len(pairs))] == [r for _, r in reversed(pairs)]


def test_counts_one_strand_and_both(spark):
    both = {r.lmer: r.cnt for r in wd.word_counts(df(spark), 5).collect()}
    assert both == brute.counts(READS, 5)
    one = wd.word_counts(df(spark), 5, "forward").agg(F.sum("cnt")).first()[0]
    assert 2 * one == sum(both.values())


def test_strands_count_alike_for_plain_bases(spark):
    counts = {r.lmer: r.cnt for r in wd.word_counts(df(spark, ["ACGTTGCA", "TTGACCA"]), 4).collect()}

    def turned(w):
        return brute.pack(3 - ((w >> (2 * i)) & 3) for i in range(4))

    assert all(counts[turned(w)] == n for w, n in counts.items())


def test_decode_and_codes(spark):
    row = spark.range(1).select(
        enc.decode_word(F.lit(27).cast("long"), 4).alias("w"),
        enc.base_code(F.lit("g")).alias("g"),
        enc.complement_code(F.lit("N")).alias("n"),
    ).first()
    assert tuple(row) == ("ACGT", 2, 0)


def test_word_length_is_checked(spark):
    with pytest.raises(ValueError):
        wd.windows(df(spark), 33)
