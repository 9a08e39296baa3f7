"""Near-duplicates of one text by few kinds of changes, so that relatives share what is new in them."""

import random

from seqloom.llm import minhash
from test_operators import components


def test_relatives_that_share_their_changes(spark):
    rng = random.Random(17)
    base = [f"b{i}" for i in range(110)]
    places = rng.sample(range(len(base)), 14)
    rows = {}
    for i in range(150):
        w = list(base)
        for place in sorted(rng.sample(places, rng.choice([0, 1, 3, 5, 6, 7])), reverse=True):
            kind = place % 3
            if kind == 0:
                del w[place]
            elif kind == 1:
                w[place] = f"n{place}"
            else:
                w.insert(place, rng.choice(["x", "y"]))
        if rng.random() < 0.3:
            w = w[: rng.randint(70, 110)]
        rows[rng.randrange(10**6)] = " ".join(w)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for d, t in rows.items()}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 4).collect()}
    assert got == components(sets, 80)
    assert len(set(got.values())) > 3
