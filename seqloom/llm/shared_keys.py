"""Which keys of an edit join several lines have, found without a shuffled row per key.

Most keys of a line are its own alone. So every block of some thousand lines sends its keys as packed
numbers (six bytes each), dealt out by the key; where they meet, keys that one line stores and another
one has too are told to the blocks of these lines, and only there they become rows. A key that several
lines of a block have goes out once for all of them, so that a key in every line is one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.segments import PARITIES, Probes, char_probes, chunks, word_probes
from seqloom.storage import Scratch, shuffle_width

# A signature is one number: the parities, above them how many of a partner's may differ, and whether the
# key is one that the line is stored under.
STORED = 1 << 62
LINES = 1 << 13  # in a block; a reference is the place in the block, below three marks
OWN, BY_WORDS, KNOWN = LINES, LINES << 1, LINES << 2
CHARACTERS = 1 << 23  # in a block, but for its last line
LINES_A_BUCKET = 1 << 16
# In place of a bucket: signatures, and keys that several lines of the block have, one of which stores it or none.
SIGNATURES, SETTLED, ASKED = -1, -2, -3

PIECE = "bucket int, block long, packed binary"
LOW = np.uint64(0xFFFFFFFF)


def _packed(keys: np.ndarray, refs: np.ndarray) -> bytes:
    return keys.tobytes() + refs.astype(np.uint16).tobytes()


def _unpacked(packed: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // (np.dtype(kind).itemsize + 2)
    return np.frombuffer(packed, kind, n), np.frombuffer(packed, np.uint16, n, n * np.dtype(kind).itemsize)


def _groups(ordered: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each group begins, its size, and whether several have the key and one stores it."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, len(ordered)))
    return first, size, (size > 1) & np.logical_or.reduceat(own, first)


def block_pieces(ids: np.ndarray, texts: list[str], edits: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed) of at most LINES non-empty lines: keys by bucket, settled keys, and signatures."""
    signatures = np.zeros((3, len(ids)), np.int64)
    signatures[0] = ids
    keys, refs, words, counts = [], [], [], []

    def add(probes: Probes, by_words: bool, start: int) -> None:
        row, key, own, room, odd = probes
        row = row + start
        signatures[1 + by_words, row] = (odd | room << np.uint64(PARITIES)).view(np.int64)
        keys.append((key >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | key & LOW)
        refs.append((row | own * OWN | by_words * BY_WORDS).astype(np.uint16))

    for part in chunks(np.array([len(x) for x in texts], np.int64)):
        by_chars, held, n = char_probes(texts[part], edits, True)
        add(by_chars, False, part.start)
        words.append(held)
        counts.append(n)
    by_words = word_probes(np.concatenate(words), np.concatenate(counts), True)
    if by_words:
        add(by_words, True, 0)
    yield SIGNATURES, signatures.tobytes()
    key, ref = np.concatenate(keys), np.concatenate(refs)
    if not len(key):
        return
    order = np.argsort(key)
    key, ref = key[order], ref[order]
    first, size, settled = _groups(key, ref & OWN != 0)
    stay = np.ones(len(key), bool)
    for kind, groups in ((SETTLED, settled), (ASKED, (size > 1) & ~settled)):
        rows = np.repeat(groups, size)
        if groups.any():
            yield kind, _packed(key[rows], ref[rows])
        stay[rows] = False
    stay[first] = True  # for the lines of other blocks
    ref[first[settled]] |= OWN | KNOWN
    key, ref = key[stay], ref[stay]
    bucket = (key >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    low = (key & LOW).astype(np.uint32)
    for a, b in zip(edges, edges[1:]):
        yield int(bucket[a]), _packed(low[a:b], ref[a:b])


def met_pieces(bucket: int, blocks: np.ndarray, packed: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(block, packed) of the keys of one bucket that a block has and others too, as far as it does not know them."""
    parts = [_unpacked(p, np.uint32) for p in packed]
    low, ref = (np.concatenate(x) for x in zip(*parts))
    whose = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(low, kind="stable")
    ref, whose = ref[order], whose[order]
    first, size, shared = _groups(low[order], ref & OWN != 0)
    told = np.flatnonzero(np.repeat(shared, size) & (ref & KNOWN == 0))
    told = told[np.argsort(whose[told], kind="stable")]
    keys = low[order][told] | np.uint64(bucket) << np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], np.diff(whose[told]) != 0, [True]])) if len(told) else []
    for a, b in zip(edges, edges[1:]):
        yield int(blocks[whose[told[a]]]), _packed(keys[a:b], ref[told[a:b]])


def block_rows(kinds: np.ndarray, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, k1, sig) of a block from its own pieces and those of `met_pieces`."""
    parts = {kind: [p for k, p in zip(kinds, packed) if min(k, 0) == kind] for kind in (0, SIGNATURES, SETTLED, ASKED)}
    signatures = np.frombuffer(parts[SIGNATURES][0], np.int64).reshape(3, -1)
    nothing = (np.empty(0, np.uint64), np.empty(0, np.uint16))
    told, settled, asked = (
        [np.concatenate(x) for x in zip(nothing, *(_unpacked(p, np.uint64) for p in parts[kind]))] for kind in (0, SETTLED, ASKED)
    )
    met, one = np.isin(asked[0], told[0]), ~np.isin(told[0], asked[0])
    key, ref = (np.concatenate([t[one], s, a[met]]) for t, s, a in zip(told, settled, asked))
    row = ref & np.uint16(LINES - 1)
    sig = signatures[1 + (ref & BY_WORDS != 0), row] | np.where(ref & OWN != 0, STORED, 0)
    return key.view(np.int64), signatures[0, row], sig


def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows again, LINES at a time, or fewer if these are long."""
    held: list[pd.DataFrame] = []
    lines = size = 0
    for batch in batches:
        ends = np.cumsum(batch["line"].str.len().to_numpy(np.int64)) if len(batch) else np.empty(0, np.int64)
        at = 0
        while at < len(batch):
            done = ends[at - 1] if at else 0
            to = min(len(batch), at + LINES - lines, int(np.searchsorted(ends, done + CHARACTERS - size)) + 1)
            held.append(batch.iloc[at:to])
            lines, size, at = lines + to - at, size + int(ends[to - 1] - done), to
            if lines == LINES or size >= CHARACTERS:
                yield pd.concat(held)
                held, lines, size = [], 0, 0
    if held:
        yield pd.concat(held)


def shared_probes(scratch: Scratch, firsts: DataFrame, edits: int) -> DataFrame:
    """(key, k1, sig): the keys of lines, those a line asks with too, that one line stores and another has."""
    buckets = max(2 * shuffle_width(firsts.sparkSession), firsts.count() // LINES_A_BUCKET)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32
        for rows in blocks_of(batches):
            made = block_pieces(rows["k1"].to_numpy(np.int64), rows["line"].tolist(), edits, buckets)
            made = pd.DataFrame(made, columns=["bucket", "packed"])
            made.insert(1, "block", block)
            yield made
            block += 1

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame(met_pieces(key[0], rows["block"].to_numpy(), rows["packed"].tolist()), columns=["block", "packed"])
        made.insert(0, "bucket", key[0])
        return made

    def unpack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("key", "k1", "sig"), block_rows(rows["bucket"].to_numpy(), rows["packed"].tolist()))))

    pieces = scratch.write(firsts.select("k1", "line").mapInPandas(make, PIECE))
    met = pieces.filter(F.col("bucket") >= 0).groupBy("bucket").applyInPandas(meet, PIECE)
    found = scratch.write(met.unionByName(pieces.filter(F.col("bucket") < 0)))
    scratch.drop(pieces)
    rows = scratch.write(found.groupBy("block").applyInPandas(unpack, "key long, k1 long, sig long"))
    scratch.drop(found)
    return rows
