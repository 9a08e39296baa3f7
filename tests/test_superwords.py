"""Word counts by minimizers against plain windows."""

import random

import numpy as np
import pytest

from seqloom.functions.encoding import COMPLEMENT_CODES, FORWARD_CODES
from seqloom.operators import superwords
from seqloom.operators.words import word_counts


def brute(texts, length, strand):
    found = {}
    for text in texts:
        data = (text or "").encode()
        sides = {"forward": "f", "revcomp": "r", "both": "fr"}[strand]
        for side in sides:
            codes = [FORWARD_CODES[b & 7] for b in data] if side == "f" else [COMPLEMENT_CODES[b & 7] for b in data][::-1]
            for i in range(len(codes) - length + 1):
                word = 0
                for c in codes[i : i + length]:
                    word = word * 4 + c
                word -= (word >> 63) << 64
                found[word] = found.get(word, 0) + 1
    return found


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("ACGTacgtNé xyz") for _ in range(rng.choice([0, 1, 6, 16, 17, 31, 32, 33, 200]))) for _ in range(80)]
    return made + [None, "A" * 400, "ACGT" * 90, "ACGT" * 90, "A" * 400]


@pytest.mark.parametrize("length", [2, 3, 11, 17, 31, 32])
@pytest.mark.parametrize("strand", ["both", "forward", "revcomp"])
def test_counts_by_minimizer(spark, texts, length, strand, monkeypatch):
    monkeypatch.setattr(superwords, "CHUNK", 100)  # pieces of long reads too
    reads = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "read_id long, seq string").repartition(3)
    rows = superwords.counted(superwords.super_words(reads, length, strand), length).collect()
    assert len({r.lmer for r in rows}) == len(rows)
    assert {r.lmer: r.cnt for r in rows} == brute(texts, length, strand)


@pytest.mark.parametrize("length", [7, 10, 17, 32])
def test_word_counts_choose_their_way(spark, texts, length):
    reads = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "read_id long, seq string")
    assert {r.lmer: r.cnt for r in word_counts(reads, length).collect()} == brute(texts, length, "both")


def test_runs_are_few_and_repeats_one_row(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("ACGT") for _ in range(3000))
    reads = spark.createDataFrame([(i, text) for i in range(50)], "read_id long, seq string").coalesce(1)
    rows = superwords.super_words(reads, 17).collect()
    assert sum(r.windows * r.cnt for r in rows) == 50 * 2 * (3000 - 16)
    # Four tasks; each sends a run once, and a run has five windows on average.
    assert len(rows) < 4 * 2 * 3000 / 4


def test_mixed_is_one_to_one():
    for size in (1, 2, 4):
        words = np.arange(4**size, dtype=np.uint64)
        made = superwords.mixed(words, size)
        assert len(set(made.tolist())) == 4**size and made.max() < 4**size


def test_no_reads(spark):
    assert word_counts(spark.createDataFrame([], "read_id long, seq string"), 17).count() == 0


def test_few_words_send_one_row_per_kind(spark):
    """What a task sends is bounded by the kinds of words, however long its texts are."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 2, 3, 4, 5000])))) for i in range(60)]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    made = superwords.few_words(reads, 3)
    assert {r.lmer: r.cnt for r in made.collect()} == brute([t for _, t in rows], 3, "both")
    assert "MapInPandas" in made._jdf.queryExecution().toString() and "Generate" not in made._jdf.queryExecution().toString()
