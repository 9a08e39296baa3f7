"""Hash functions of the bucketed and the three-way index, in 64-bit wrapping arithmetic.

Spark's LONG product raises on overflow, so a product of a 64-bit key and a 32-bit factor is put
together from 16-bit pieces, as an upper and a lower half of 32 bits each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash functions.
LARGE_PRIME = 1900813
SLOTS = 192
ADD_H, MUL_H = 0x01010101, 0x12345678
XOR_G1, MUL_G1 = 0xABCDEFAB, 0xCDEFABCD
XOR_G2, MUL_G2 = 0xEFABCDEF, 0xBAFEDCBA
XOR_G3, MUL_G3 = 0xFEDCBAFE, 0xDCBAFEDC
KEYS_PER_BUCKET = 409
MISS = 0xFFFFFFFF

_LOW32 = 0xFFFFFFFF
_LOW16 = 0xFFFF


def _both_halves(key: Column, factor: int, add: int) -> tuple[Column, Column]:
    """Upper and lower 32 bits of `add + factor * key` modulo 2^64."""
    piece = [
        F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(_LOW16)).cast("long") for i in range(4)
    ]
    product = [p * F.lit(factor).cast("long") for p in piece]
    low = (
        product[0] + F.lit(add) + F.shiftleft(product[1].bitwiseAND(F.lit(_LOW16)), 16)
    )
    high = (
        F.shiftright(low, 32)
        + F.shiftright(product[1], 16)
        + product[2].bitwiseAND(F.lit(_LOW32))
        + F.shiftleft(product[3].bitwiseAND(F.lit(_LOW16)), 16)
    )
    return high.bitwiseAND(F.lit(_LOW32)), low.bitwiseAND(F.lit(_LOW32))


def _modulo_prime(high: Column, low: Column) -> Column:
    return ((high % LARGE_PRIME) * ((1 << 32) % LARGE_PRIME) + low) % LARGE_PRIME


def bucket_hash(key: Column, buckets: int) -> Column:
    return _modulo_prime(*_both_halves(key.cast("long"), MUL_H, ADD_H)) % buckets


def slot_hash(key: Column, seed: int, which: int) -> Column:
    """Slot in sub-table 1, 2 or 3 for a seed (an unsigned 32-bit number)."""
    xor, mul = {1: (XOR_G1, MUL_G1), 2: (XOR_G2, MUL_G2), 3: (XOR_G3, MUL_G3)}[which]
    high, low = _both_halves(key.cast("long"), mul ^ seed, seed)
    return _modulo_prime(high, low.bitwiseXOR(F.lit(xor).cast("long"))) % SLOTS


def bucket_count(keys: int) -> int:
    return keys // KEYS_PER_BUCKET + 1
