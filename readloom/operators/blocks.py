"""Blocks of reads and the pairwise comparison plan over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom import schemas
from readloom.operators.ordered import AUTO, CHUNK, DEFAULT_WIDTH, Width, choose_width, with_rank, with_running_sum
from readloom.operators.select import with_status
from readloom.session import cut_lineage

BLOCK_BASES = 200_000_000


def assign_blocks(
    reads: DataFrame,
    block_bases: int = BLOCK_BASES,
    order: str = "id",
    width: int | None = DEFAULT_WIDTH,
) -> DataFrame:
    """Add the 1-based ``block`` of each read: about ``block_bases`` bases per block.

    A read belongs to the block its first base falls in, counting in ``order``, a
    unique column. Whole numbers are cut into chunks of ``width``; a column of
    another type, such as text ids, is dealt out by range, and the ranges are the chunks.
    """
    if not isinstance(reads.schema[order].dataType, T.IntegralType):
        reads = cut_lineage(reads.repartitionByRange(order).withColumn(CHUNK, F.spark_partition_id()))
    summed = with_running_sum(reads, "_cum", F.col("len"), [], [order], width)
    block = F.expr(f"(_cum - len) div {int(block_bases)} + 1")
    return summed.withColumn("block", block).drop("_cum", CHUNK)


def block_pairs(blocks: DataFrame, use_masking: bool = True) -> DataFrame:
    """(rowid, block_id1, block_id2, priority, use_masking) for blocks 1..n, n = rows of ``blocks``.

    Each block against itself first, then each against the later ones. Row i
    makes its own n - i + 1 rows, and row numbers are in closed form: no join,
    no sort. The size of the plan, n (n + 1) / 2, is what is asked for.
    """
    n = blocks.select(F.count(F.lit(1))).scalar()
    numbered = with_rank(blocks.select("block_id"), "block_id1", [], ["block_id"])
    # Few rows go in and many come out, so they are spread over a fixed number of tasks first.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = numbered.repartition(tasks, "block_id1")
    paired = spread.select("block_id1", n.alias("_n")).select(
        "block_id1", "_n", F.explode(F.sequence(F.col("block_id1"), F.col("_n"))).alias("block_id2")
    )
    b1, b2 = F.col("block_id1"), F.col("block_id2")
    above = F.expr("(block_id1 - 1) * _n - block_id1 * (block_id1 - 1) div 2")
    diagonal = b1 == b2
    return paired.select(
        F.when(diagonal, b1).otherwise(F.col("_n") + above + (b2 - b1)).alias("rowid"),
        b1,
        b2,
        F.when(diagonal, F.lit(1)).otherwise(b1 + 1).cast("bigint").alias("priority"),
        F.lit(use_masking).alias("use_masking"),
    )


def completed_keys(work: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id): blocks whose comparisons, in either role, are all completed."""
    n = blocks.select(F.count(F.lit(1))).scalar()
    done = work.filter(F.col("status") == schemas.COMPLETED)
    roles = done.select(
        F.explode(F.array_distinct(F.array("block_id1", "block_id2"))).alias("block_id")
    )
    return (
        roles.groupBy("block_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == n)
        .select("block_id")
    )


def select_work(
    work: DataFrame, statuses: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Work items in a status set, most urgent first; no statuses means all."""
    ordered = with_status(work, statuses).orderBy("priority", "rowid")
    return ordered if limit is None else ordered.limit(limit)


def chunk_within_key(
    work: DataFrame, size: int, key: str = "block_id1", width: Width = AUTO
) -> DataFrame:
    """Add ``batch``, counting from 0: at most ``size`` rows of one key and priority each."""
    keys = [key, "priority"]
    ranked = with_rank(work, "_rank", keys, ["rowid"], choose_width(work, keys, width))
    return ranked.withColumn("batch", F.expr(f"(_rank - 1) div {int(size)}")).drop("_rank")


def fixed_batches(
    rows: DataFrame,
    size: int,
    order: str,
    cap: int | None = None,
    width: int | None = DEFAULT_WIDTH,
) -> DataFrame:
    """Rows in batches of ``size`` in order; ``cap`` takes only the first rows, as asked by the user."""
    ranked = with_rank(rows, "_rank", [], [order], width)
    taken = ranked if cap is None else ranked.filter(F.col("_rank") <= cap)
    return taken.withColumn("batch", F.expr(f"(_rank - 1) div {int(size)}")).drop("_rank")
