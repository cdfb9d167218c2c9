"""Filters of fixed size over 64-bit hashes: what may meet is let through to a join, all else stays where it is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: one megabyte, whatever the number of values. More values let more others through, which the join
#: behind the filter sorts out; they lose none.
FILTER_BITS = 23
_SHIFTS = (0, 20, 40)


def value_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter over a column of 64-bit hashes: 2^bits bits in 64-bit words, the only thing that comes to the driver."""
    places = F.explode(F.array(*(F.shiftrightunsigned(column, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in _SHIFTS))).alias("p")
    one = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    words = hashes.select(places).groupBy(F.expr("CAST(p DIV 64 AS INT)").alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out.view(np.uint64)


def may_hold(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in the filter; every one that is passes."""
    mask = np.uint64(len(held) * 64 - 1)
    ok = np.ones(len(hashes), bool)
    for s in _SHIFTS:
        p = (hashes >> np.uint64(s)) & mask
        ok &= (held[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def passes(held: np.ndarray, hashed: Column) -> Column:
    """Whether a column of 64-bit hashes may be in the filter."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(may_hold(held, values.to_numpy(np.int64).view(np.uint64)))

    return run(hashed)


def may_hold_one(held: np.ndarray, h: int) -> bool:
    mask = len(held) * 64 - 1
    return all(int(held[(p := (h >> s) & mask) >> 6]) >> (p & 63) & 1 for s in _SHIFTS)
