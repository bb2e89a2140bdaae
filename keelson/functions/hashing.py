"""Hashes that place keys and sample traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slot_of(key: str | Column, slots: int) -> Column:
    """CRC-32 of a key's UTF-8 bytes, modulo the number of slots."""
    c = F.col(key) if isinstance(key, str) else key
    return (F.crc32(c.cast("binary")) % slots).cast("int")


def shard_of(slot: str | Column, shards: int) -> Column:
    c = F.col(slot) if isinstance(slot, str) else slot
    return F.abs(c) % shards


def fnv1a64(*parts: np.ndarray) -> np.ndarray:
    """FNV-1a (64 bits) over the little-endian bytes of unsigned 64-bit columns, one after the other."""
    h = np.full(len(parts[0]), np.uint64(14695981039346656037))
    for p in parts:
        for shift in range(0, 64, 8):
            h = (h ^ ((p >> np.uint64(shift)) & np.uint64(255))) * np.uint64(1099511628211)
    return h


def sampled(slot: Column, sequence: Column, chain_version: Column, rate: int) -> Column:
    """Keeps one trace in ``rate`` by its hash; a rate of one or less keeps all. Null ids are 0."""

    @F.pandas_udf(T.BooleanType())
    def keep(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        h = fnv1a64(*[x.fillna(0).to_numpy(np.int64).view(np.uint64) for x in (a, b, c)])
        return pd.Series(h % np.uint64(max(rate, 1)) == 0)

    return keep(slot.cast("bigint"), sequence.cast("bigint"), chain_version.cast("bigint"))
