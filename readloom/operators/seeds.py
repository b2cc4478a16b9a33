"""Candidate read pairs from shared k-mers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.operators import sketch
from readloom.operators.intervals import merge_intervals
from readloom.operators.ordered import choose_width
from readloom.session import cut_lineage

HOT_KMER = 100_000
MAX_HOT = 1_000_000
#: Letters of k-mers that are kept as numbers, and how many of them make a number of 63 bits at most.
LETTERS = "ACGTN"
MOST_CODED = 27
KMER = ["code", "text"]
BATCH_ROWS = 1 << 16

Batches = Iterator[pa.RecordBatch]


def seed_positions(reads: DataFrame, k: int, masks: DataFrame | None = None) -> DataFrame:
    """(read_id, pos, code, text): every k-mer with its 0-based place.

    A k-mer of the letters ACGTN is a number to the base 5 and an empty text; others, and all that are too long for
    that, are the code -1 and their text, so different k-mers always differ. Those that touch an interval of the track
    ``masks`` are left out. A read meets its masks before it is taken apart. It is taken apart a piece at a
    time, so the k-mers of a long read never lie in one batch.
    """
    rows = reads.select("read_id", "seq")
    if masks is not None:
        per_read = merge_intervals(masks, ["read_id"]).groupBy("read_id")
        rows = rows.join(per_read.agg(F.collect_list(F.struct("b", "e")).alias("_masks")), "read_id", "left")
    fields = [rows.schema["read_id"], T.StructField("pos", T.LongType()), T.StructField("code", T.LongType()), T.StructField("text", T.StringType())]
    return rows.mapInArrow(_apart(k), T.StructType(fields))


def _apart(k: int) -> Callable[[Batches], Batches]:
    values = np.full(128, -1, np.int64)
    values[[ord(x) for x in LETTERS]] = range(len(LETTERS))
    piece = sketch.PIECE

    def coded(text: str) -> tuple[np.ndarray, pa.Array]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        value = np.where(points < 128, values[np.minimum(points, 127)], -1)
        m = len(points) - k + 1
        code = np.zeros(m, np.int64)
        if k > MOST_CODED:
            code -= 1
        else:
            for j in range(k):
                code = code * len(LETTERS) + np.maximum(value[j : j + m], 0)
            foreign = np.concatenate([[0], np.cumsum(value < 0)])
            code[foreign[k:] > foreign[:m]] = -1
        if code.min() >= 0:
            return code, pa.repeat("", m)
        return code, pa.array([text[i : i + k] if c < 0 else "" for i, c in enumerate(code.tolist())], pa.string())

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ready, held = [], 0
            masked = batch.column("_masks") if "_masks" in batch.schema.names else None
            for row in range(batch.num_rows):
                seq = batch.column("seq")[row].as_py() or ""
                spans = (masked[row].as_py() if masked is not None else None) or []
                for at in range(0, len(seq) - k + 1, piece):
                    code, text = coded(seq[at : at + piece + k - 1])
                    pos = np.arange(at, at + len(code))
                    if spans:
                        free = np.ones(len(code), bool)
                        for span in spans:
                            if span["b"] is not None and span["e"] is not None and span["e"] > span["b"]:
                                free[max(0, span["b"] - k + 1 - at) : max(0, span["e"] - at)] = False
                        code, pos, text = code[free], pos[free], text.filter(pa.array(free))
                    ready.append((np.full(len(code), row), pos, code, text))
                    held += len(code)
                    if held >= BATCH_ROWS:
                        yield packed(batch, ready)
                        ready, held = [], 0
            if held:
                yield packed(batch, ready)

    def packed(batch: pa.RecordBatch, ready: list) -> pa.RecordBatch:
        row, pos, code = (np.concatenate(x) for x in list(zip(*ready, strict=True))[:3])
        ids = batch.column("read_id").take(pa.array(row))
        return pa.RecordBatch.from_arrays([ids, pa.array(pos), pa.array(code), pa.concat_arrays([x[3] for x in ready])], ["read_id", "pos", "code", "text"])

    return run


def without_hot_kmers(seeds: DataFrame, max_freq: int) -> DataFrame:
    """Seeds without the k-mers that are too frequent to be used and would burden a task.

    Mostly there is none, and the seeds come back as they are. Else those found more
    than HOT_KMER and ``max_freq`` times are listed. A list of up to MAX_HOT is sent to the
    seeds, so that their rows go before any shuffle; a longer one is joined.
    """
    if choose_width(seeds, KMER) is None:
        return seeds
    counts = seeds.groupBy(*KMER).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(counts.filter(F.col("_n") > max(HOT_KMER, max_freq)).select(*KMER))
    if hot.count() <= MAX_HOT:
        hot = F.broadcast(hot)
    return seeds.join(hot, KMER, "left_anti")


def _paired(max_freq: int) -> Callable[[Batches], Batches]:
    """(a, b, _shift) of every two places of a k-mer that has 2 to ``max_freq`` of them, in rows sorted by k-mer and place."""

    def pairs(rows: pa.RecordBatch) -> Batches:
        code = rows.column("code").to_numpy()
        new = np.ones(rows.num_rows, bool)
        new[1:] = code[1:] != code[:-1]
        if code.min(initial=0) < 0:
            text = np.array(rows.column("text").to_pylist(), object)
            new[1:] |= text[1:] != text[:-1]
        group = np.cumsum(new) - 1
        n = np.bincount(group)[group]
        usable = np.flatnonzero((n >= 2) & (n <= max_freq))
        ids, pos, group = rows.column("read_id"), rows.column("pos").to_numpy(), group[usable]
        for apart in range(1, min(max_freq, len(usable))):
            first = np.flatnonzero(group[:-apart] == group[apart:])
            if not len(first):
                break
            x, y = usable[first], usable[first + apart]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(pos[x] - pos[y])], ["a", "b", "_shift"])

    def run(batches: Batches) -> Batches:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            last = rows.num_rows - 1
            code = rows.column("code").to_numpy()
            same = code == code[last]
            if code[last] < 0:
                same &= np.array(rows.column("text").to_pylist(), object) == rows.column("text")[last].as_py()
            begin = int(np.flatnonzero(same)[0])
            yield from pairs(rows.slice(0, begin))
            # of a k-mer that is too frequent, one place more than may be is all that has to be known
            held = rows.slice(begin, max_freq + 1)
        if held is not None:
            yield from pairs(held)

    return run


def candidate_pairs(
    reads: DataFrame,
    k: int = 14,
    max_freq: int = 20,
    min_shared: int = 2,
    band: int = 64,
    identity: bool = False,
    masks: DataFrame | None = None,
) -> DataFrame:
    """(a, b, diagonal, shared): read pairs with at least ``min_shared`` seeds on one diagonal band.

    k-mers found more than ``max_freq`` times are no seeds, which is part of the
    definition and bounds the pairs made per place. a < b, or a <= b with
    ``identity``; a seed never pairs with itself.
    """
    seeds = seed_positions(reads, k, masks)
    # A task has all places of its k-mers, in order, and holds those of one k-mer at a time.
    placed = without_hot_kmers(seeds, max_freq).repartition(*KMER).sortWithinPartitions(*KMER, "read_id", "pos")
    name = seeds.schema["read_id"].dataType
    fields = [T.StructField("a", name), T.StructField("b", name), T.StructField("_shift", T.LongType())]
    pairs = placed.mapInArrow(_paired(max_freq), T.StructType(fields))
    if not identity:
        pairs = pairs.filter(F.col("a") < F.col("b"))
    diagonal = F.expr(f"cast((_shift - pmod(_shift, {int(band)})) div {int(band)} as bigint)")
    return (
        pairs.groupBy("a", "b", diagonal.alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") >= min_shared)
    )
