"""Base codes, fixed-length windows and packed words as column expressions.

A read is a byte buffer. Every byte has a two-bit code that depends on its low three bits only, so
any text is a valid read. Packed words hold two bits per base in a LONG; a 32-base word uses the
sign bit, and `unsigned_order` gives the key that sorts words as unsigned numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-bit code by the low three bits of a byte, forward and complement strand.
FORWARD_CODES = (0, 0, 0, 1, 3, 0, 0, 2)
COMPLEMENT_CODES = (0, 3, 0, 2, 0, 0, 0, 1)
BASES = "ACGT"
MAX_WORD = 32

_BYTES = "".join(map(chr, range(256)))
_SIGN = -(1 << 63)


def check_word_length(length: int) -> int:
    if not 2 <= length <= MAX_WORD:
        raise ValueError(f"word length must be between 2 and {MAX_WORD}, got {length}")
    return length


def signed(value: int) -> int:
    """The LONG with the same 64 bits as an unsigned value."""
    return value - (1 << 64) if value >= 1 << 63 else value


def word_mask(bases: int) -> int:
    return signed((1 << (2 * bases)) - 1)


def _code_digits(text: Column, codes: tuple[int, ...]) -> Column:
    """One base-4 digit per byte of a string or binary; Latin-1 makes one character of every byte."""
    chars = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.translate(chars, _BYTES, "".join(str(codes[i & 7]) for i in range(256)))


def forward_digits(text: Column) -> Column:
    return _code_digits(text, FORWARD_CODES)


def complement_digits(text: Column) -> Column:
    """Digits of the complement strand, read backwards."""
    return F.reverse(_code_digits(text, COMPLEMENT_CODES))


def pack_digits(digits: Column) -> Column:
    """Base-4 digit string (at most 32 digits) to the LONG with the same bits."""
    return F.conv(digits, 4, -10).cast("long")


def pack_blocks(digits: Column) -> Column:
    """Array of LONGs with 32 digits each, zeros after the last one.

    The digits are bound to a variable of their own, or each block would make them again; as bytes,
    they are cut without counting characters.
    """

    def blocks(bytes_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(bytes_), F.lit(1)), F.lit(MAX_WORD))
        part = lambda at: F.substring(bytes_, at, F.lit(MAX_WORD)).cast("string")
        return F.transform(starts, lambda at: pack_digits(F.rpad(part(at), MAX_WORD, "0")))

    return F.get(F.transform(F.array(digits.cast("binary")), blocks), F.lit(0))


def word_in(block: Column, following: Column, offset: Column, length: int) -> Column:
    """The word of `length` bases that begins `offset` (0 to 31) bases into two packed blocks."""
    left = (2 * offset).cast("int")
    begun = F.call_function("shiftleft", block, left)
    more = F.call_function("shiftrightunsigned", following, F.lit(2 * MAX_WORD) - left)
    both = F.when(offset > 0, begun.bitwiseOR(more)).otherwise(block)
    return F.shiftrightunsigned(both, 2 * (MAX_WORD - length))


def unsigned_order(word: Column, bases: int) -> Column:
    """Key whose signed order is the unsigned order of the word."""
    return word.bitwiseXOR(F.lit(_SIGN)) if bases == MAX_WORD else word


def prefix_word(lmer: Column, length: int) -> Column:
    return F.shiftrightunsigned(lmer, 2).bitwiseAND(F.lit(word_mask(length - 1)))


def suffix_word(lmer: Column, length: int) -> Column:
    return lmer.bitwiseAND(F.lit(word_mask(length - 1)))


def first_base(lmer: Column, length: int) -> Column:
    return F.shiftrightunsigned(lmer, 2 * (length - 1)).bitwiseAND(F.lit(3)).cast("int")


def last_base(lmer: Column) -> Column:
    return lmer.bitwiseAND(F.lit(3)).cast("int")


def decode_base(code: Column) -> Column:
    return F.substring(F.lit(BASES), code.cast("int") + 1, F.lit(1))


def decode_word(word: Column, bases: int) -> Column:
    """Packed word to its base string."""
    return F.concat(
        *[
            decode_base(F.shiftrightunsigned(word, 2 * i).bitwiseAND(F.lit(3)))
            for i in range(bases - 1, -1, -1)
        ]
    )


def base_code(char: Column) -> Column:
    return _single(char, FORWARD_CODES)


def complement_code(char: Column) -> Column:
    return _single(char, COMPLEMENT_CODES)


def _single(char: Column, codes: tuple[int, ...]) -> Column:
    low = F.ascii(char).bitwiseAND(F.lit(7))
    expr = F.lit(0)
    for bits, code in enumerate(codes):
        if code:
            expr = F.when(low == bits, F.lit(code)).otherwise(expr)
    return expr.cast("int")
