"""64-bit SimHash of text over shingles of 8 words, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 8
_REVERSED = np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None, int8_wrap: bool = False) -> int:
    """Bit j of the fingerprint, from the top, is set if more shingle hashes have bit j, from the bottom, than not.

    Parts are split at single spaces, so a final space gives an empty last part; fewer than 8 parts give 0.
    int8_wrap sums in 8 bits that wrap, as the data this replaces were made.
    """
    parts = (text or "").split(" ")
    if len(parts) < WORDS:
        return 0
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(parts[i : i + WORDS]).lower().strip()) for i in range(len(parts) - WORDS + 1)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    sums = 2 * ones - len(hashes)
    if int8_wrap:
        sums = sums.astype(np.int8)
    return int(((sums > 0).astype(np.uint64) << _REVERSED).sum())


def simhash(text: Column, int8_wrap: bool = False) -> Column:
    """The fingerprint as a signed long."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, int8_wrap) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return F.arrow_udf(run, "long")(text)
