"""Windows that hold given words, found by runs and minimizers, against all windows."""

import random

import pytest

from seqloom.operators import superwords as sp
from seqloom.operators.words import windows


@pytest.mark.parametrize("length", [5, 9, 17, 32])
def test_places_of_words(spark, monkeypatch, length):
    monkeypatch.setattr(sp, "shuffle_width", lambda spark: 2)
    rng = random.Random(length)
    text = "".join(rng.choice("ACGT") for _ in range(900))
    reads = [text[i : i + 70] for i in range(0, 800, 7)] + ["A" * 200, text * 3, "ACG", "", None, "xyz é " * 9]
    df = spark.createDataFrame([(f"r:{i}", s) for i, s in enumerate(reads)], "read_id string, seq string")
    cut = windows(df, length, "forward").select("read_id", "pos", "lmer").collect()
    kinds = sorted({r.lmer for r in cut})
    some = set(rng.sample(kinds, len(kinds) // 5)) | {0}
    words = spark.createDataFrame([(w,) for w in some], "lmer long")
    found = sp.places_of_words(df, words, length)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted((r.read_id, r.pos) for r in cut if r.lmer in some) and got
    assert sp.places_of_words(df, words.limit(0), length).count() == 0


def test_gathered_reads(spark, monkeypatch):
    """All rows stay, and reads that overlap by more than half lie beside each other."""
    monkeypatch.setattr(sp, "shuffle_width", lambda spark: 5)
    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(3000))
    reads = [(f"r{i}", text[i : i + 100]) for i in range(0, 2900, 10)] + [(f"x{i}", s) for i, s in enumerate([None, "", "AC", "ACGTACGTA"])]
    rng.shuffle(reads)
    df = spark.createDataFrame(reads, "read_id string, seq string").repartition(5)
    near = list(map(tuple, sp.gathered(df, 17).collect()))
    assert sorted(near, key=str) == sorted(reads, key=str)
    at = [int(i[1:]) for i, _ in near if i[0] == "r"]
    assert sum(abs(a - b) < 50 for a, b in zip(at, at[1:])) > 0.6 * len(at)
