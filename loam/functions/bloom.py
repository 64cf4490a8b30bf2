"""Bloom filters: sizes, and a filter that aggregates and probes in Arrow batches.

Anti joins here are exact; a filter only saves work before one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizing(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for n members at false-positive rate p."""
    m = math.floor(-n * math.log(p) / math.log(2) ** 2)
    return m, round(m / n * math.log(2))


def _spots(values: list[str], m: int, k: int) -> np.ndarray:
    digests = [xxhash.xxh3_128_intdigest(v) for v in values]
    low, high = np.array([d & (2**64 - 1) for d in digests], np.uint64), np.array([d >> 64 for d in digests], np.uint64)
    return (low[:, None] + np.arange(k, dtype=np.uint64)[None, :] * high[:, None]) % np.uint64(m)


def build(df: DataFrame, column: str, n: int, p: float = 0.01) -> tuple[bytes, int, int]:
    """The filter's bits over a column: partial filters of the partitions are or-ed on the executors, then on the driver."""
    m, k = sizing(n, p)

    def part(batches):
        bits = np.zeros(m, bool)
        for b in batches:
            bits[_spots([v for v in b[0].to_pylist() if v is not None], m, k).ravel().astype(np.int64)] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    rows = df.select(column).mapInArrow(part, "bits binary").toLocalIterator()
    out = np.zeros(-(-m // 8), np.uint8)
    for r in rows:
        out |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes(), m, k


def maybe_contains(filter_: tuple[bytes, int, int], value: Column) -> Column:
    raw, m, k = filter_

    def probe(values: pa.Array) -> pa.Array:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))[:m].astype(bool)
        vs = values.to_pylist()
        hit = bits[_spots([v or "" for v in vs], m, k).astype(np.int64)].all(axis=1) if vs else np.zeros(0, bool)
        return pa.array([None if v is None else bool(h) for v, h in zip(vs, hit)], pa.bool_())

    return F.arrow_udf(probe, "boolean")(value)
