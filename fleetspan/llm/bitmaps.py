"""A bitmap of hashed keys, built by Spark and of bounded size, that tells Python tasks which keys cannot matter.

A key that was put in always passes. Others pass now and then, which costs work and
never changes a result: above the size bound the bitmap only lets more through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 16
LEAST_BITS, MOST_BITS = 16, 28  # powers of two: 8 KB and 32 MB, the proven bound of what is collected and broadcast
BUCKET_BITS = 1 << 15  # fixed value: bits in one bucket of bitmap_construct_agg


def bitmap_of(keys: DataFrame, key: str, n_keys: int) -> bytes:
    """Bits at two positions per 64-bit key, as bytes with the lowest bit first."""
    power = min(max(int(n_keys * BITS_A_KEY).bit_length(), LEAST_BITS), MOST_BITS)
    mask = (1 << power) - 1
    low: Column = F.col(key).bitwiseAND(F.lit(mask))
    high: Column = F.shiftrightunsigned(F.col(key), 32).bitwiseAND(F.lit(mask))
    places = keys.select(F.explode(F.array(low, high)).alias("at")).withColumn("at", F.col("at") + 1)
    buckets = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray((1 << power) // 8)
    for row in buckets.collect():  # at most 2 ** MOST_BITS bits
        start = (row["bucket"] - 1) * BUCKET_BITS // 8
        out[start : start + BUCKET_BITS // 8] = row["bits"]
    return bytes(out)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys may have been put in; ``bits`` are the bitmap's bytes."""
    mask = np.uint64(bits.size * 8 - 1)
    out = np.ones(keys.size, dtype=bool)
    for place in (keys & mask, (keys >> np.uint64(32)) & mask):
        out &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return out
