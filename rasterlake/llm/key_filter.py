"""A bitmap of keys, made by Spark and tested in tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MB. With more keys than bits a bitmap passes more rows than needed, which later joins drop;
#: results do not depend on it.
BITS = 25
#: Of bitmaps sized by a count of keys: some 32 bits a key, 128 kB at least and 32 MB at most.
LEAST_BITS, MOST_BITS = 20, 28


def bits_for(n: int) -> int:
    return int(np.clip(int(n).bit_length() + 5, LEAST_BITS, MOST_BITS))


def place(*keys: str, bits: int = BITS) -> Column:
    """The bit of a key, in a column that tasks can read."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits)).cast("int")


def collect(places: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of a table with one integer column `at`; rows of 4 kB reach the driver, which together are the bitmap."""
    at = F.col("at").cast("long") + 1  # Spark's bitmaps count from 1
    marks = places.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    found = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    for row in marks.collect():
        start = (row["bucket"] - 1) * 4096
        found[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return found


def passes(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
