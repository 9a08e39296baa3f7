"""Windows of reads, word counts and distinct sub-words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import encoding as enc
from seqloom.operators.superwords import counted, few_words, super_words
from seqloom.storage import spread

# Bytes of one read handled per row before windows are cut; bounds the size of any array.
PIECE = 1 << 16

# Words up to this length (a million kinds) are counted by every task before they are sent.
COMBINED = 10


def windows(
    reads: DataFrame, length: int, strand: str = "both", id_col: str = "read_id", seq_col: str = "seq"
) -> DataFrame:
    """All windows of `length` bases: (read_id, strand, pos, lmer), pos counted from 0 on its strand.

    Reads shorter than a window give nothing. Long reads are cut into overlapping pieces first, and
    windows are cut from bytes, so the cost per window does not grow with the read.
    """
    enc.check_word_length(length)
    rows = reads.select(F.col(id_col), F.col(seq_col).cast("binary").alias("_bytes")).where(
        F.length("_bytes") >= length
    )
    starts = F.sequence(F.lit(0), F.length("_bytes") - length, F.lit(PIECE))
    pieces = rows.select(id_col, "_bytes", F.explode(starts).alias("_start")).select(
        id_col,
        "_start",
        F.length("_bytes").alias("_size"),
        F.substring("_bytes", F.col("_start") + 1, F.lit(PIECE + length - 1)).alias("_piece"),
    )
    pieces = spread(pieces)  # a piece grows about sixteenfold below
    piece = F.col("_piece")
    sides = {
        "f": (enc.forward_digits(piece), F.col("_start")),
        "r": (enc.complement_digits(piece), F.col("_size") - F.col("_start") - F.length(piece)),
    }
    wanted = {"forward": "f", "revcomp": "r", "both": "fr"}[strand]
    side = F.array(
        *[
            F.struct(
                F.lit(s).alias("strand"),
                enc.pack_blocks(sides[s][0]).alias("_blocks"),
                sides[s][1].alias("_base"),
            )
            for s in wanted
        ]
    )
    lines = pieces.select(id_col, F.length("_piece").alias("_bases"), F.explode(side).alias("_s"))
    lines = lines.select(id_col, "_bases", "_s.*")
    offsets = F.sequence(F.lit(0), F.col("_bases") - length)
    cut = lines.select(id_col, "strand", "_base", "_blocks", F.explode(offsets).alias("_off"))
    # Each window is two shifts of the packed blocks it touches.
    block = F.shiftright("_off", 5)
    word = enc.word_in(
        F.get("_blocks", block),
        F.coalesce(F.get("_blocks", block + 1), F.lit(0).cast("long")),
        F.col("_off").bitwiseAND(F.lit(31)),
        length,
    )
    return cut.select(
        F.col(id_col), "strand", (F.col("_base") + F.col("_off")).cast("long").alias("pos"), word.alias("lmer")
    )


def word_counts(
    reads: DataFrame, length: int, strand: str = "both", id_col: str = "read_id", seq_col: str = "seq"
) -> DataFrame:
    """(lmer, cnt) over all windows.

    Short words are few, so every task counts all kinds and leaves hardly anything to send. Longer ones are mostly
    different, and are sent in runs by minimizer (`superwords`).
    """
    if length > COMBINED:
        return counted(super_words(reads, length, strand, seq_col), length)
    return few_words(reads, length, strand, seq_col)


def sub_words(counts: DataFrame, length: int) -> DataFrame:
    """Distinct prefixes and suffixes, taken from the counted words instead of the raw windows."""
    both = F.array(enc.prefix_word(F.col("lmer"), length), enc.suffix_word(F.col("lmer"), length))
    return counts.select(F.explode(both).alias("kmer")).distinct()


def split_words(counts: DataFrame, length: int) -> DataFrame:
    """Each word with its prefix, suffix and outer bases."""
    lmer: Column = F.col("lmer")
    return counts.select(
        "*",
        enc.prefix_word(lmer, length).alias("prefix"),
        enc.suffix_word(lmer, length).alias("suffix"),
        enc.first_base(lmer, length).alias("first_base"),
        enc.last_base(lmer).alias("last_base"),
    )


def neighbour_bitmap(counts: DataFrame, length: int) -> DataFrame:
    """(kmer, cnt, neighbours): incoming bases in the high four bits, outgoing in the low four.

    Within each half the bit order from the highest bit is T, G, C, A, so base code b is bit b.
    `cnt` is the number of occurrences of the k-mer as a prefix or a suffix of a window.
    """
    split = split_words(counts, length)
    sides = F.array(
        F.struct(
            F.col("prefix").alias("kmer"),
            F.expr("shiftleft(1, last_base)").alias("bit"),
        ),
        F.struct(
            F.col("suffix").alias("kmer"),
            F.expr("shiftleft(16, first_base)").alias("bit"),
        ),
    )
    return (
        split.select("cnt", F.explode(sides).alias("side"))
        .groupBy(F.col("side.kmer").alias("kmer"))
        .agg(F.sum("cnt").alias("cnt"), F.bit_or("side.bit").alias("neighbours"))
    )
