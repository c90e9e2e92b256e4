"""Bloom filters of bounded size, to leave rows at the scan that a join would drop later."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spotcheck.llm.textbytes import mix

#: Largest filter in bits (16 MB).  Beyond it more rows pass, and the exact join drops them.
MAX_BITS = 27
SLICE_BITS = 16
PROBES = 4


def positions(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (mix(keys + np.uint64(probe * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def size_for(n: int) -> int:
    """Bits (as a power of two) for about sixteen a key, within bounds."""
    return int(min(MAX_BITS, max(SLICE_BITS, int(16 * max(n, 1)).bit_length())))


def contains(flags: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter (false for most that are not)."""
    out = np.ones(len(keys), bool)
    for probe in range(PROBES):
        p = positions(keys, bits, probe)
        out &= (flags[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def bloom(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A filter of the distinct values of a long column, built in slices by the executors."""
    distinct = keys.select(F.col(column).cast("long").alias("k")).filter("k is not null").distinct()
    bits = size_for(distinct.count())

    def places(batches):
        for pdf in batches:
            k = pdf["k"].to_numpy(np.int64).view(np.uint64)
            p = np.unique(np.concatenate([positions(k, bits, probe) for probe in range(PROBES)]))
            yield pd.DataFrame({"slice": (p >> SLICE_BITS).astype(np.int64), "at": (p & ((1 << SLICE_BITS) - 1)).astype(np.int32)})

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << SLICE_BITS, bool)
        flags[group["at"].to_numpy()] = True
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    slices = distinct.mapInPandas(places, "slice long, at int").groupBy("slice").applyInPandas(fill, "slice long, flags binary")
    flags = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (SLICE_BITS - 3)
    for row in slices.collect():  # 2**bits bits together
        flags[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(row["flags"], np.uint8)
    return flags, bits


def maybe_in(keys: DataFrame, column: str) -> callable:
    """A condition on a long column that holds for all values of ``keys`` and few others."""
    flags, bits = bloom(keys, column)
    shared = keys.sparkSession.sparkContext.broadcast(flags)

    @F.pandas_udf("boolean")
    def there(k: pd.Series) -> pd.Series:
        return pd.Series(contains(shared.value, bits, k.fillna(0).to_numpy(np.int64).view(np.uint64)))

    def condition(c: Column) -> Column:
        return there(c)

    return condition
