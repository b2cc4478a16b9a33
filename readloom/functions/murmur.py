"""32-bit Murmur3 of whole sequences, as an Arrow-batched UDF.

Spark's own ``hash`` has another seed and treats trailing bytes differently, so
it cannot give these values. Rows of one batch are hashed side by side: step i
mixes the i-th word of every sequence still long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published algorithm's constants, and the seed of sequence hashes.
C1 = np.uint32(0xCC9E2D51)
C2 = np.uint32(0x1B873593)
ADD = np.uint32(0xE6546B64)
FINAL_1 = np.uint32(0x85EBCA6B)
FINAL_2 = np.uint32(0xC2B2AE35)
SEQUENCE_SEED = 314159265

SLAB_BYTES = 1 << 24


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))


def _scramble(word: np.ndarray) -> np.ndarray:
    return _rotate(word * C1, 15) * C2


def _hash_slab(raws: list[bytes], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Hash byte strings given in ascending order of size."""
    words = (int(sizes[-1]) + 3) // 4
    padded = b"".join(raw.ljust(words * 4, b"\0") for raw in raws)
    # One row per word position, so each step reads one contiguous row.
    grid = np.frombuffer(padded, dtype="<u4").reshape(len(raws), words).T.copy()
    full = sizes // 4
    state = np.full(len(raws), seed, dtype=np.uint32)
    first = np.searchsorted(full, np.arange(words), side="right")
    for i in range(int(full[-1])):
        live = slice(first[i], None)
        state[live] = _rotate(state[live] ^ _scramble(grid[i, live]), 13) * np.uint32(5) + ADD
    ragged = np.flatnonzero(sizes % 4)
    state[ragged] ^= _scramble(grid[full[ragged], ragged])
    state ^= sizes.astype(np.uint32)
    for shift, factor in ((16, FINAL_1), (13, FINAL_2)):
        state = (state ^ (state >> np.uint32(shift))) * factor
    return state ^ (state >> np.uint32(16))


def murmur3_32(values: list[bytes], seed: int = SEQUENCE_SEED) -> np.ndarray:
    """Hashes of the byte strings, as unsigned values in int64."""
    out = np.zeros(len(values), dtype=np.int64)
    sizes = np.fromiter((len(v) for v in values), dtype=np.int64, count=len(values))
    ascending = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(values):
        # A slab is padded to its longest row, so it ends before it outgrows the budget.
        ends = sizes[ascending[start:]] * np.arange(1, len(values) - start + 1)
        stop = start + max(1, int(np.searchsorted(ends, SLAB_BYTES, side="right")))
        rows = ascending[start:stop]
        out[rows] = _hash_slab([values[r] for r in rows], sizes[rows], seed)
        start = stop
    return out


@F.pandas_udf(T.LongType())
def _seq_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for seqs in batches:
        hashed = pd.Series(murmur3_32([s.encode() if s is not None else b"" for s in seqs]))
        yield hashed.astype("Int64").mask(seqs.isna())


def seq_hash(seq: Column) -> Column:
    """Unsigned 32-bit hash of all bytes of the sequence, as BIGINT."""
    return _seq_hash(seq)
