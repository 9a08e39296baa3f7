"""Keys that several lines share, told by packed numbers, against all keys."""

import random
from collections import defaultdict

import numpy as np
from test_line_bounds import varied

from seqloom.llm import lines, shared_keys
from seqloom.llm.segments import PARITIES, line_probes
from seqloom.storage import Scratch


def all_probes(ids, texts, edits):
    rows = []
    for row, key, own, room, odd in line_probes(texts, edits, True):
        sig = (odd | room << np.uint64(PARITIES)).view(np.int64) | np.where(own, shared_keys.STORED, 0)
        rows += zip(key.tolist(), np.array(ids)[row].tolist(), sig.tolist())
    return rows


def test_shared_probes_are_those_of_all_keys(spark):
    """Signatures that meet under a key, in one block and in several."""
    texts = varied(random.Random(5), 600)
    ids = list(range(1000, 1000 + len(texts)))
    by_key = defaultdict(set)
    for key, i, sig in all_probes(ids, texts, 2):
        by_key[key].add((i, sig))
    want = sorted(
        sorted(v) for v in by_key.values() if len({i for i, _ in v}) > 1 and any(sig & shared_keys.STORED for _, sig in v)
    )
    docs = spark.createDataFrame(list(zip(ids, texts)), "k1 long, line string")
    for parts in (1, 7):
        with Scratch(spark, "t") as scratch:
            firsts = scratch.write(docs.repartition(parts))
            got = defaultdict(set)
            for r in lines.shared_probes(scratch, firsts, 2).collect():
                got[r.key].add((r.k1, r.sig))
        assert sorted(map(sorted, got.values())) == want and len(want) > 300


def test_pieces_of_several_blocks_give_every_shared_row():
    texts = varied(random.Random(6), 300)
    pieces = []
    for block, at in enumerate(range(0, len(texts), 60)):
        ids = np.arange(at, min(at + 60, len(texts)))
        pieces += [(b, block, p) for b, p in shared_keys.block_pieces(ids, texts[at : at + 60], 2, 5)]
    assert {b for b, _, _ in pieces} == {shared_keys.SIGNATURES, shared_keys.SETTLED, shared_keys.ASKED, *range(5)}
    told = [x for x in pieces if x[0] < 0]
    for bucket in range(5):
        own = [(k, p) for b, k, p in pieces if b == bucket]
        met = shared_keys.met_pieces(bucket, np.array([k for k, _ in own]), [p for _, p in own])
        told += [(bucket, k, p) for k, p in met]
    got = defaultdict(list)
    for block in {k for _, k, _ in told}:
        mine = [(b, p) for b, k, p in told if k == block]
        for key, i, sig in zip(*shared_keys.block_rows(np.array([b for b, _ in mine]), [p for _, p in mine])):
            got[key].append((i, sig))
    by_key = defaultdict(list)
    for key, i, sig in all_probes(range(len(texts)), texts, 2):
        by_key[key].append((i, sig))
    want = [sorted(v) for v in by_key.values() if len({i for i, _ in v}) > 1 and any(s & shared_keys.STORED for _, s in v)]
    assert sorted(map(sorted, got.values())) == sorted(want)


def test_one_hot_key_goes_out_once_a_block():
    """A passage that stands in all lines of a block: six bytes for it, whatever the number of lines."""
    rng = random.Random(7)
    tails = {"".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(400)}
    made = list(shared_keys.block_pieces(np.arange(len(tails)), ["p" * 30 + t for t in sorted(tails)], 2, 1))
    low, _ = next(shared_keys._unpacked(p, np.uint32) for b, p in made if b == 0)
    assert len(low) == len(np.unique(low))
