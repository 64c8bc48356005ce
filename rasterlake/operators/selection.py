"""Exact selection over whole tables without a sort: the k-th value by its bits, and the rows up to it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bits of a value that a round looks at: at most 65,536 counts reach the driver in each of four rounds.
DIGIT = 16


def bits_of(values: np.ndarray) -> np.ndarray:
    """Numbers in the order of doubles: -0.0 as 0.0, NaN last."""
    size = np.abs(values).view(np.int64)
    return np.where(np.isnan(values), np.iinfo(np.int64).max, np.where(values < 0, -size, size))


def double_of(bits: int) -> float:
    """The double of a number of `bits_of`."""
    if bits == 2**63 - 1:
        return float("nan")
    return float(np.copysign(np.array([abs(bits)], np.int64).view(np.float64)[0], 1.0 if bits >= 0 else -1.0))


def _bits(values: pa.Array) -> pa.Array:
    found = bits_of(values.fill_null(0.0).to_numpy(zero_copy_only=False))
    return pa.array(np.where(values.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, found))


def ordered_bits(value: Column) -> Column:
    """A long in the order of a double, that of its bits: null first, -0.0 as 0.0, NaN last."""
    return F.arrow_udf(_bits, LongType())(value.cast("double"))


def kth_smallest(df: DataFrame, key: str, k: int) -> tuple[int, int] | None:
    """The k-th smallest value of a long column, from 1, and how many rows are smaller; None if there are fewer than k rows.

    Four rounds, each a count by the next 16 bits of the rows that agree with the k-th so far: exact
    for any values, ties and number of rows. `df` is read four times, so stage what is dear to make.
    """
    if k < 1:
        return None
    found, below = 0, 0
    rows = df.select(F.col(key).cast("long").bitwiseXOR(F.lit(-(2**63))).alias("u"))  # in the order of unsigned bits
    for shift in range(64 - DIGIT, -1, -DIGIT):
        part = rows if shift == 64 - DIGIT else rows.where(F.shiftrightunsigned("u", shift + DIGIT) == F.lit(found))
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = sorted((r["d"], r["n"]) for r in part.groupBy(digit.cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        for d, n in counts:
            if below + n >= k:
                found = (found << DIGIT) | d
                break
            below += n
        else:
            return None
    return found - (1 << 63), below


def smallest(keys: DataFrame, k: int) -> Column:
    """A condition that is true for the k smallest rows (all, if fewer) by the long columns of `keys`, in order, and false for others.

    Each column is selected by bits among the rows that tie in all columns before it, so that nothing
    is sorted, whatever k is. Rows equal in all columns count alike: where the k-th is one of several,
    all of them are chosen, so the last column should tell rows apart. The counts are jobs of their own.
    """
    if k < 1:
        return F.lit(False)
    chosen, tied, need = F.lit(False), F.lit(True), k
    for key in keys.columns:
        found = kth_smallest(keys.where(tied), key, need)
        if found is None:  # all that tie are needed
            break
        value, below = found
        chosen = chosen | (tied & (F.col(key) < F.lit(value)))
        tied = tied & (F.col(key) == F.lit(value))
        need -= below
    return chosen | tied
