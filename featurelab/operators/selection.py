"""Exact order statistics of a column by radix selection.

The ordered bits of a double are settled ``DIGIT`` bits at a time: each pass
counts the next digit of the values that share the digits known so far, and the
wanted rank falls in one of them.  ``64 / DIGIT`` passes give the value itself;
no task holds more than the counts of one digit, however many values there are.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 16
_TOP = np.uint64(1 << 63)


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 as 0.0; NaN last, as Spark orders it)."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def _value(bits: int) -> float:
    bits = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digit_counts(values: DataFrame, shift: int, known: list[int]) -> dict[tuple[int, int], int]:
    """Values per (known leading bits, next digit)."""

    def count(batches):
        total = np.zeros((len(known), 1 << DIGIT), np.int64)
        for rb in batches:
            bits = _ordered_bits(rb.column(0).to_numpy(zero_copy_only=False).astype(np.float64))
            for i, k in enumerate(known):
                mine = bits if shift + DIGIT == 64 else bits[bits >> np.uint64(shift + DIGIT) == np.uint64(k)]
                total[i] += np.bincount(((mine >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=1 << DIGIT)
        which, digit = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(digit), pa.array(total[which, digit])], names=["which", "digit", "n"])

    rows = values.mapInArrow(count, "which long, digit long, n long").groupBy("which", "digit").agg(F.sum("n").alias("n")).collect()
    return {(known[r["which"]], r["digit"]): r["n"] for r in rows}


def exact_ranks(df: DataFrame, col: str, ranks: list[int]) -> list[float]:
    """The values of the given 0-based ranks among the non-null values of ``col``; ranks must exist."""
    values = df.select(F.col(col).cast("double").alias("v")).where("v is not null")
    prefix, left = [0] * len(ranks), list(ranks)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        counts = _digit_counts(values, shift, sorted(set(prefix)))
        for i, k in enumerate(prefix):
            for digit in sorted(d for p, d in counts if p == k):
                if left[i] < counts[k, digit]:
                    prefix[i] = k << DIGIT | digit
                    break
                left[i] -= counts[k, digit]
            else:
                raise IndexError(f"rank {ranks[i]} is beyond the values")
    return [_value(k) for k in prefix]


def exact_percentile(df: DataFrame, col: str, fraction: float) -> float | None:
    """The linearly interpolated percentile of the non-null values; None if there are none."""
    n = df.where(F.col(col).isNotNull()).count()
    if n == 0:
        return None
    place = fraction * (n - 1)
    lo, hi = math.floor(place), math.ceil(place)
    if lo == hi:
        return exact_ranks(df, col, [lo])[0]
    a, b = exact_ranks(df, col, [lo, hi])
    return a if a == b else (hi - place) * a + (place - lo) * b
