"""Bounds of the last comparison of lines never part linked ones."""

import random

from pyspark.sql import functions as F

from seqloom.llm import lines
from seqloom.llm.segments import word_codes


def varied(rng, n):
    """Lines of words of which many differ in a word, a character or a blank, over several bands of lengths."""
    made = {"z" * 60}
    while len(made) < n:
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 12, 30, 60, 120, 210]))]
        for _ in range(rng.randint(1, 6)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(["new", "x y", "ä", f"w{rng.randrange(300)}"])
            made.add(" ".join(x))
    return sorted(made)


def test_signs_and_bounds_never_part_linked_lines(spark):
    rng = random.Random(8)
    texts = varied(rng, 150)
    for x in list(texts)[:60]:  # characters put in, taken out or changed, blanks among them
        y = list(x)
        for _ in range(2):
            i = rng.randrange(len(y))
            y[i : i + rng.randint(0, 1)] = rng.choice([" ", "q", ""])
        texts.append(" ".join("".join(y).split()))
    texts = sorted(set(texts))
    for a, b in zip(texts, texts[1:]):
        x, y = word_codes([a, b])
        assert len(x) == len(a.split()) and len(y) == len(b.split())
    docs = spark.createDataFrame(list(enumerate(texts)), "k1 long, line string")
    far = lines.wide(docs)
    pairs = far.select(F.col("k1").alias("a"), F.col("wide").alias("x")).join(
        far.select(F.col("k1").alias("b"), F.col("wide").alias("y")), F.col("a") < F.col("b")
    )
    met = {(r.a, r.b) for r in pairs.filter(lines.may_link("x", "y", 2)).select("a", "b").collect()}
    linked = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if lines.near_lines(texts[i], texts[j], 2)}
    assert linked <= met and len(met) <= 1.2 * len(linked) and len(linked) > 100
