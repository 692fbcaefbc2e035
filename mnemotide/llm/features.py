"""Byte n-gram counts and bounded samples, shared by the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trigram_counts(data: bytes, bits: int) -> np.ndarray:
    """Counts of all runs of three bytes, hashed to 2**bits buckets; zeros for fewer than three bytes."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(1 << bits, np.int64)
    x = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return np.bincount(x >> np.uint32(32 - bits), minlength=1 << bits)


def bounded_sample(ids: DataFrame, rows: int, id_col: str) -> DataFrame:
    """At most `rows` rows, those whose ids have the lowest hashes; behaves alike at every size."""
    return ids.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(rows)
