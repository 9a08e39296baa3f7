"""Counting words by minimizers.

The minimizer of a window is the smallest of its m-mers in a hashed order. Neighbouring windows mostly
share it, so a run of them (a super-word) is sent as one row: the minimizer, up to 64 packed bases and
the number of windows, about a fifth of the rows the windows would be. A word has one minimizer wherever
it stands, so after dealing rows out by minimizer every copy of a word is in one partition: the runs are
cut there and counted without a further shuffle. Words of few kinds are counted by every task instead.

Equal runs of a batch are sent once with their number, so a read that is repeated over and over is no hot
partition. The hashed order keeps the m-mers that a text is full of (all one base) from being chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import encoding as enc
from seqloom.storage import shuffle_width, spread

# Windows in one run at most: the 32 bases of the last one then end within two packed words.
MAX_RUN = 32
# Bytes handled at once by a task; bounds its arrays.
CHUNK = 1 << 20

# Places of a run in one row at most.
PLACES = 256

RUNS = "mini long, hi long, lo long, windows int, cnt long"


def minimizer_size(length: int) -> int:
    """Half the word and one base: long enough to be rare, short enough for runs of windows."""
    return max(1, min(length // 2 + 1, 15))


def _table(codes: tuple[int, ...]) -> np.ndarray:
    return np.array([codes[b & 7] for b in range(256)], np.uint64)


FORWARD, COMPLEMENT = _table(enc.FORWARD_CODES), _table(enc.COMPLEMENT_CODES)


def packed(codes: np.ndarray, size: int) -> np.ndarray:
    """At every place the next `size` bases in one word, by doubling; zeros follow the end."""
    word, have = codes.copy(), 1
    for bit in bin(size)[3:]:
        shifted = np.zeros_like(word)
        shifted[: len(word) - have] = word[have:] if have < len(word) else 0
        word, have = word << np.uint64(2 * have) | shifted, 2 * have
        if bit == "1":
            following = np.zeros_like(word)
            if have < len(codes):
                following[: len(codes) - have] = codes[have:]
            word, have = word << np.uint64(2) | following, have + 1
    return word


def mixed(word: np.ndarray, size: int) -> np.ndarray:
    """A hashed order of the m-mers: one to one on 2 * size bits."""
    bits = np.uint64(2 * size)
    mask = np.uint64((1 << 2 * size) - 1)
    half = np.uint64(max(1, size))
    h = word ^ np.uint64(0x1B873593CC9E2D51) & mask
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        h = h * np.uint64(factor) & mask
        h ^= h >> half
    return h & mask if bits else h


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of the `size` values from every place on (the last places look less far)."""
    have, low = 1, values
    while have < size:
        step = min(have, size - have)
        low = np.minimum(low, np.concatenate([low[step:], low[len(low) - step :]]) if step < len(low) else low)
        have += step
    return low


def runs_of(codes: np.ndarray, ends: np.ndarray, length: int, m: int) -> tuple[np.ndarray, ...]:
    """(start, mini, hi, lo, windows) of the runs in the reads that lie side by side in `codes`."""
    n = len(codes)
    sizes = np.diff(np.concatenate([[0], ends]))
    left = np.repeat(ends, sizes) - np.arange(n)  # bases up to the end of the own read
    whole = left >= length
    mini = sliding_min(mixed(packed(codes, m), m), length - m + 1)
    new = np.ones(n, bool)
    new[1:] = (mini[1:] != mini[:-1]) | (left[1:] != left[:-1] - 1) | ~whole[:-1]
    at = np.flatnonzero(new & whole)
    if not len(at):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    # A run ends before the next one, or where its read has no whole window left.
    after = np.minimum(np.append(at[1:], n), at + left[at] - length + 1)
    size = after - at
    if (size > MAX_RUN).any():
        times = -(-size // MAX_RUN)
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(at, times) + MAX_RUN * part
        size = np.minimum(np.repeat(size, times) - MAX_RUN * part, MAX_RUN)
    word = packed(codes, 32)
    bases = size + length - 1
    gone = np.uint64(2) * np.clip(32 - bases, 0, 31).astype(np.uint64)
    hi = word[at] >> gone << gone
    beyond = at + 32
    lo = np.where(beyond < n, word[np.minimum(beyond, n - 1)], np.uint64(0))
    gone = np.uint64(2) * np.clip(64 - bases, 0, 31).astype(np.uint64)
    lo = np.where(bases > 32, lo >> gone << gone, np.uint64(0))
    return at, mini[at].astype(np.int64), hi.view(np.int64), lo.view(np.int64), size


def chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(read number, offset in the read, end) of reads and pieces of reads put side by side, and their bytes.

    A piece overlaps the next one by length - 1 bytes, so each window is in one piece.
    """
    rows: list[tuple[int, int]] = []
    held: list[bytes] = []
    size = 0
    for number, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        for start in range(0, len(text) - length + 1, CHUNK):
            piece = text[start : start + CHUNK + length - 1]
            rows.append((number, start))
            held.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield _side_by_side(rows, held)
                rows, held, size = [], [], 0
    if rows:
        yield _side_by_side(rows, held)


def _side_by_side(rows: list[tuple[int, int]], held: list[bytes]):
    number, start = np.array(rows, np.int64).T
    return number, start, np.cumsum([len(p) for p in held]), b"".join(held)


def strands_of(ends: np.ndarray, data: bytes, strand: str) -> Iterator[tuple[str, np.ndarray]]:
    """Codes of the wanted strands; the complement of each read is turned round in its place."""
    raw = np.frombuffer(data, np.uint8)
    if strand in ("forward", "both"):
        yield "f", FORWARD[raw]
    if strand in ("revcomp", "both"):
        sizes = np.diff(np.concatenate([[0], ends]))
        first = np.repeat(ends - sizes, sizes)
        last = np.repeat(ends - 1, sizes)
        yield "r", COMPLEMENT[raw[first + last - np.arange(len(raw))]]


def super_words(reads: DataFrame, length: int, strand: str = "both", seq_col: str = "seq") -> DataFrame:
    """(mini, hi, lo, windows, cnt): runs of windows of one minimizer, equal ones of a batch together."""
    enc.check_word_length(length)
    m = minimizer_size(length)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, _, ends, data in chunks(batch["seq"].tolist(), length):
                for _, codes in strands_of(ends, data, strand):
                    _, mini, hi, lo, size = runs_of(codes, ends, length, m)
                    yield combined(mini, hi, lo, size)

    rows = spread(reads.select(F.col(seq_col).cast("binary").alias("seq")))
    return rows.mapInPandas(cut, RUNS)


def combined(mini: np.ndarray, hi: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    """Equal runs once, with their number."""
    order = np.lexsort((size, lo, hi))
    mini, hi, lo, size = mini[order], hi[order], lo[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (size[1:] != size[:-1])
    first = np.flatnonzero(new)
    cnt = np.diff(np.append(first, len(order)))
    return pd.DataFrame(
        {"mini": mini[first], "hi": hi[first], "lo": lo[first], "windows": size[first].astype(np.int32), "cnt": cnt}
    )


def gathered(reads: DataFrame, length: int) -> DataFrame:
    """`reads` sorted by the smallest hash of their m-mers, in ranges of equal size.

    Reads that overlap by most of their bases mostly share it and then lie in one batch, where equal runs of
    windows are found. Ranges go on within a key, so reads that are all alike are no hot partition.
    """
    m = minimizer_size(length)

    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        low = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
        for number, _, ends, data in chunks(texts.tolist(), m):
            begin = np.concatenate([[0], ends[:-1]])
            value = mixed(packed(FORWARD[np.frombuffer(data, np.uint8)], m), m)
            for back in range(1, m):
                value[ends - back] = np.iinfo(np.uint64).max  # these would reach into the next read
            np.minimum.at(low, number, np.minimum.reduceat(value, begin))
        return pd.Series(low.view(np.int64))

    keyed = reads.withColumn("_key", key(F.col("seq").cast("binary")))
    dealt_out = keyed.repartitionByRange(shuffle_width(reads.sparkSession), "_key", "read_id")
    return dealt_out.sortWithinPartitions("_key", "read_id").drop("_key")


def minimizers(words: np.ndarray, length: int, m: int) -> np.ndarray:
    """The minimizer of every word, as `runs_of` gives it to the run of a window."""
    mask = np.uint64((1 << 2 * m) - 1)
    low = mixed(words & mask, m)
    for back in range(1, length - m + 1):
        low = np.minimum(low, mixed(words >> np.uint64(2 * back) & mask, m))
    return low


def words_of(hi: np.ndarray, lo: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, offset, word) of every window of the runs."""
    run = np.repeat(np.arange(len(windows)), windows)
    off = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    step = (2 * off).astype(np.uint64)
    both = hi[run] << step | lo[run] >> np.uint64(1) >> np.uint64(63) - step
    return run, off, both >> np.uint64(64 - 2 * length)


def places_of_words(reads: DataFrame, words: DataFrame, length: int) -> DataFrame:
    """(read_id, pos): windows of the forward strand whose word is in `words` (lmer, without repeats).

    Runs of windows are sent, equal ones of a batch once with the places where they begin, and meet the words by
    minimizer. Partitions are sorted by it, the words before the runs, and read in that order, so that a task
    holds the words of a batch and of one minimizer.
    """
    enc.check_word_length(length)
    m = minimizer_size(length)
    id_type = reads.schema["read_id"].dataType.simpleString()
    sent = f"mini long, hi long, lo long, windows int, ids array<{id_type}>, places array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for number, start, ends, data in chunks(texts, length):
                at, mini, hi, lo, size = runs_of(FORWARD[np.frombuffer(data, np.uint8)], ends, length, m)
                if not len(at):
                    continue
                piece = np.searchsorted(ends, at, "right")
                pos = start[piece] + at - np.concatenate([[0], ends])[piece]
                order = np.lexsort((size, lo, hi))
                a, b, c = hi[order], lo[order], size[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
                begin = np.flatnonzero(new)
                first = np.flatnonzero((np.arange(len(new)) - begin[np.cumsum(new) - 1]) % PLACES == 0)
                held = pa.array(np.append(first, len(order)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mini[order][first]), pa.array(a[first]), pa.array(b[first]), pa.array(c[first].astype(np.int32)),
                        pa.ListArray.from_arrays(held, ids.take(pa.array(number[piece[order]]))),
                        pa.ListArray.from_arrays(held, pa.array(pos[order])),
                    ],
                    names=["mini", "hi", "lo", "windows", "ids", "places"],
                )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column(0).to_numpy(zero_copy_only=False)
            mini = minimizers(word.view(np.uint64), length, m).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mini), pa.array(word)], names=["mini", "hi"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key = np.empty(0, np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            mini, hi, lo, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            hi, lo = hi.view(np.uint64), lo.view(np.uint64)
            named = size == 0
            kept = known if key == mini[0] else known[:0]
            known = np.sort(np.concatenate([kept, hi[named]]))
            if len(known):
                run, off, word = words_of(hi, lo, size, length)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, word), len(known) - 1)] == word)
                run, off = run[hit], off[hit]
                ids, places = batch.column(4), batch.column(5)
                begin = ids.offsets.to_numpy()
                n = (begin[1:] - begin[:-1])[run]
                at = np.repeat(begin[run], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = places.values.to_numpy()[at - begin[0] + places.offsets[0].as_py()] + np.repeat(off, n)
                yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(at)), pa.array(pos)], names=["read_id", "pos"])
            key = mini[-1]
            same = minimizers(known, length, m).view(np.int64) == key if len(known) else slice(0)
            known = known[same]

    rows = spread(reads.select("read_id", F.col("seq").cast("binary").alias("seq")))
    runs = rows.mapInArrow(cut, sent)
    asked = words.select("lmer").mapInArrow(keyed, "mini long, hi long").select(
        "mini", "hi", F.lit(0).cast("long").alias("lo"), F.lit(0).alias("windows"),
        F.array().cast(f"array<{id_type}>").alias("ids"), F.array().cast("array<long>").alias("places"),
    )
    met = runs.unionByName(asked).repartition(shuffle_width(reads.sparkSession), "mini").sortWithinPartitions("mini", "windows")
    return met.mapInArrow(meet, f"read_id {id_type}, pos long")


def counted(runs: DataFrame, length: int) -> DataFrame:
    """(lmer, cnt) of the words in super-words, which are dealt out by minimizer once."""
    words = runs.repartition("mini").select(
        "mini", "hi", "lo", "cnt", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("_at")
    )
    return words.select("mini", enc.word_in(F.col("hi"), F.col("lo"), F.col("_at"), length).alias("lmer"), "cnt").groupBy("mini", "lmer").agg(
        F.sum("cnt").alias("cnt")
    ).select("lmer", "cnt")


def few_words(reads: DataFrame, length: int, strand: str = "both", seq_col: str = "seq") -> DataFrame:
    """(lmer, cnt) of words so short that a task holds a count for each of all kinds (4 ** length)."""
    enc.check_word_length(length)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 2 * length, np.int64)
        for batch in batches:
            for _, _, ends, data in chunks(batch["seq"].tolist(), length):
                whole = np.ones(len(data), bool)  # places where a window of the own read begins
                for back in range(1, length):
                    whole[ends - back] = False
                for _, codes in strands_of(ends, data, strand):
                    total += np.bincount(packed(codes, length)[whole].view(np.int64), minlength=len(total))
        held = np.flatnonzero(total)
        yield pd.DataFrame({"lmer": held, "cnt": total[held]})

    rows = spread(reads.select(F.col(seq_col).cast("binary").alias("seq")))
    return rows.mapInPandas(count, "lmer long, cnt long").groupBy("lmer").agg(F.sum("cnt").alias("cnt"))
