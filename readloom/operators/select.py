"""Longest-read selection and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.ordered import with_running_sum
from readloom.session import cut_lineage

TOP_ROWS = 10_000
LENGTH_STEP = 1 << 10
WIDE = "decimal(38,0)"


def longest_n(reads: DataFrame, n: int, length: str = "len", tie: str = "id") -> DataFrame:
    """The n longest reads in ascending order of length; earliest ``tie`` wins.

    ``tie`` is a unique column of any type that can be ordered, at every n. A small
    n is a per-partition top-n. A large one, which a single task should not hold, is
    cut at the length where the count is reached; the rows are the same.
    """
    if n <= TOP_ROWS:
        chosen = reads.orderBy(F.desc(length), F.asc(tie)).limit(n)
    else:
        chosen = _longest_until(reads, F.lit(n), length, tie, by_bases=False)
    return chosen.orderBy(F.asc(length), F.desc(tie))


def longest_to_coverage(
    reads: DataFrame,
    genome_size: int,
    coverage: int,
    length: str = "len",
    tie: str = "id",
) -> DataFrame:
    """Longest reads first until they add up to genome_size x coverage.

    The read that reaches the target is included, and there is always one read.
    ``tie`` is a unique column, text or number, giving the order among equal lengths.
    """
    target = F.lit(str(genome_size * coverage)).cast(WIDE)
    return _longest_until(reads, target, length, tie, by_bases=True)


def _longest_until(
    reads: DataFrame, target: Column, length: str, tie: str, by_bases: bool
) -> DataFrame:
    """Reads, longest first, up to and with the one whose weight reaches the target.

    A read weighs its length, or 1. The cut is found on a histogram of lengths:
    longer reads pass a plain filter, and so do those of the length at the cut up
    to the last ``tie`` that is taken.
    """
    weight = F.col("_len") if by_bases else F.lit(1)
    histogram = (
        reads.groupBy(F.col(length).alias("_len"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_len", (-F.col("_len")).alias("_down"), "_n", weight.cast(WIDE).alias("_w"))
    )
    summed = with_running_sum(
        histogram, "_cum", (F.col("_n") * F.col("_w")).cast(WIDE), [], ["_down"], LENGTH_STEP
    )
    before = F.col("_cum") - F.col("_n") * F.col("_w")
    counted = summed.select(
        "_len",
        "_n",
        "_w",
        (target - before).cast(WIDE).alias("_missing"),
        F.least(target - before, F.col("_n") * F.col("_w")).cast(WIDE).alias("_bounded"),
        (before == 0).alias("_first"),
    )
    take = (
        F.when((F.col("_missing") > 0) & (F.col("_w") == 0), F.col("_n"))
        .when(F.col("_missing") > 0, F.expr("(_bounded + _w - 1) div greatest(_w, 1)"))
        .when(F.col("_first") & F.lit(by_bases), F.lit(1))
        .otherwise(F.lit(0))
    )
    reached = counted.select("_len", take.alias("_take")).filter(F.col("_take") > 0)
    cut = reached.select(F.min(F.struct("_len", "_take")).alias("_cut")).first()._cut
    if cut is None:
        return reads.limit(0)
    at_cut = reads.filter(F.col(length) == cut._len)
    last = _nth(at_cut.select(F.col(tie).alias("_tie")), cut._take)
    return reads.filter((F.col(length) > cut._len) | ((F.col(length) == cut._len) & (F.col(tie) <= F.lit(last))))


def _nth(values: DataFrame, n: int) -> object:
    """The n-th smallest of a column _tie of unique values, or the largest if there are fewer.

    The values are dealt out by range; counts per partition tell where the n-th lies,
    and only that partition is sorted.
    """
    dealt = cut_lineage(values.repartitionByRange("_tie").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # one row per partition
    passed = 0
    for size in sizes:
        if passed + size.n >= n or size is sizes[-1]:
            own = dealt.filter(F.col("_part") == size._part)
            nth = min(n - passed, size.n)
            ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_tie")))
            return ranked.filter(F.col("_rank") == nth).first()._tie
        passed += size.n


def with_status(work: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Rows in one of the statuses; no statuses means all rows."""
    return work.filter(F.col("status").isin(*statuses)) if statuses else work
