"""A sieve (blocked Bloom filter) of a table's keys: rows that surely have no partner in a join need not be moved for it.

A sieve never loses a key; of others it lets about 1 in 150 through, more once MOST slices are full. So the join that
follows decides, and a sieve only decides what stays where it is. Each slice of bits is made by one task and sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.common import released, written

#: Bits of a slice, bits for a key, slices at most (32 MB).
SLICE, PER, MOST = 1 << 16, 12, 4096
_PROBES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def _slices(x: np.ndarray, slices: int) -> np.ndarray:
    return (x % np.uint64(slices)).astype(np.int64)


def _places(x: np.ndarray, probe: int) -> np.ndarray:
    """Where in its slice a key has its bit."""
    return ((x * _PROBES[probe]) >> np.uint64(64 - SLICE.bit_length() + 1)).astype(np.int64)


def sieve(keys: DataFrame) -> Broadcast:
    """The sieve of ``keys``, one column of whole numbers without nulls."""
    spark = keys.sparkSession
    own = written(keys.select(F.col(keys.columns[0]).cast("long").alias("key")), "keys")
    slices = min(max(-(-own.count() * PER // SLICE), 1), MOST)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slices(_mixed(batch.column(0).to_numpy()), slices)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(0)], names=["slice", "key"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            at, x = batch.column(0).to_numpy(), _mixed(batch.column(1).to_numpy())
            for k in np.unique(at):
                held = bits.setdefault(int(k), np.zeros(SLICE, bool))
                for probe in range(len(_PROBES)):
                    held[_places(x[at == k], probe)] = True
        packed = [np.packbits(b, bitorder="little").tobytes() for b in bits.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "bits"])

    out = np.zeros((slices, SLICE // 8), np.uint8)
    found = own.mapInArrow(dealt, "slice int, key bigint").repartition("slice").mapInArrow(made, "slice int, bits binary").toArrow()
    for k, b in zip(found["slice"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[k] = np.frombuffer(b, np.uint8)
    released(own)
    return spark.sparkContext.broadcast(out)


def passing(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` may be in the sieve: true for all that are."""
    x = _mixed(keys)
    at = _slices(x, len(held))
    left = np.arange(len(x))
    for probe in range(len(_PROBES)):
        place = _places(x[left], probe)
        left = left[(held[at[left], place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(x), bool)
    out[left] = True
    return out


def maybe(held: Broadcast, key: Column) -> Column:
    """Whether ``key`` may be in the sieve."""

    @F.arrow_udf("boolean")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(passing(held.value, keys.to_numpy(zero_copy_only=False)))

    return run(key)
