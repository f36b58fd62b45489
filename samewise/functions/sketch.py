"""A bounded frequency sketch: how many of many hashes fall in each of a fixed number of buckets."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a sketch. This, not the data, bounds what is sent to the driver and broadcast: 4 bytes a bucket.
BUCKETS = 1 << 18


def frequency_sketch(df: DataFrame, hash_col: Column) -> np.ndarray:
    """Counts of ``hash_col`` (long) by bucket, saturated at 2^31 - 1; pre-aggregated before the shuffle.

    The counts only order things by cost; no result depends on them.
    """
    return summed(df.select(F.pmod(hash_col, F.lit(BUCKETS)).cast("int").alias("b"), F.lit(1).cast("long").alias("n")))


def counts_batch(keys: Iterable[np.ndarray]) -> pa.RecordBatch:
    """(b, n): how many of the keys (hashes, in pieces) fall in each bucket; what ``summed`` adds up."""
    n = np.zeros(BUCKETS, np.int64)
    for k in keys:
        n += np.bincount(bucket(k), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["b", "n"])


def summed(rows: DataFrame) -> np.ndarray:
    """The sketch of rows (b int, n long), at most one a bucket coming to the driver."""
    rows = rows.groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int32)
    out[rows["b"].to_numpy(np.int64)] = np.minimum(rows["n"].to_numpy(np.int64), 2**31 - 1)
    return out


def as_classes(sketch: np.ndarray) -> Column:
    """The sketch as one binary literal: a byte a bucket that rises with the logarithm of its count."""
    steps = np.floor(8 * np.log2(sketch.astype(np.float64) + 1)).clip(0, 255).astype(np.uint8)
    return F.lit(steps.tobytes())


def class_of(classes: Column, item: Column) -> Column:
    """The byte of the bucket of a text, as a binary that orders like the count."""
    return F.substring(classes, (F.pmod(F.xxhash64(item), F.lit(BUCKETS)) + 1).cast("int"), F.lit(1))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bucket(h: np.ndarray) -> np.ndarray:
    """The bucket of each hash, as frequency_sketch counts it (the low bits, as BUCKETS is a power of two)."""
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)
