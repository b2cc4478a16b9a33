"""A table of bits that prunes rows by a 64-bit hash before they are shuffled.

Its size is bounded whatever it is made of. Where it fills up it lets more rows through, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a table, at least and at most (as powers of two).
MIN_BITS, MAX_BITS = 16, 27
TURN = np.uint64(0x9E3779B97F4A7C15)


class Bits:
    """A bounded table of 64-bit hashes; it may say yes to others, never no to its own."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    def has(self, found: np.ndarray) -> np.ndarray:
        slot = (found * TURN) >> np.uint64(64 - self.bits)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits_of(rows: DataFrame, column: str, n: int, spread: int = 64) -> Bits:
    """Of a column of longs in ``n`` rows, with ``spread`` bits for each or more while the bound allows.

    One row per 512 slots comes to the driver, 2 ** (MAX_BITS - 9) at most.
    """
    bits = min(MAX_BITS, max(MIN_BITS, (spread * n).bit_length()))
    words = [f"_w{i}" for i in range(8)]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits - 6, np.uint64)
        for batch in source:
            slot = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) * TURN) >> np.uint64(64 - bits)
            np.bitwise_or.at(table, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        table = table.view(np.int64).reshape(-1, 8)
        at = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(table[at, i]) for i in range(8))], ["_at", *words])

    parts = rows.select(column).mapInArrow(run, ", ".join(f"{name} long" for name in ["_at", *words]))
    found = parts.groupBy("_at").agg(*[F.bit_or(w).alias(w) for w in words]).toPandas()
    table = np.zeros((1 << bits - 9, 8), np.int64)
    table[found["_at"].to_numpy(np.int64)] = found[words].to_numpy(np.int64)
    return Bits(table.reshape(-1).view(np.uint64), bits)
