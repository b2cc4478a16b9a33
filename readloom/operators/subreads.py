"""Neighbouring reads of one well: gaps, overlaps, and their statistics.

Input columns: cell, hole, qs, qe. Wells are grouped by key and read in order
of (qs, qe), so unsorted input gives the same answer as sorted input.

Copies of an interval are folded into one row with a count first. The copies
are each other's neighbours, so they are n - 1 further pairs of that interval
with itself, and no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.operators.ordered import AUTO, Running, Width, choose_width, with_preceding

WELL = ["cell", "hole"]


def interval_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Gap between two intervals, 0 if there is none."""
    ahead = F.greatest(F.lit(0), b_start - a_end)
    behind = F.greatest(F.lit(0), a_start - b_end)
    return F.when(a_start < b_start, ahead).otherwise(behind)


def interval_overlaps(
    a_start: Column, a_end: Column, b_start: Column, b_end: Column, mode: str = "reference"
) -> Column:
    """Whether two intervals share or touch a place.

    mode="reference" also calls b-before-a an overlap; it never shows on sorted
    input. mode="strict" is the symmetric rule.
    """
    if mode == "strict":
        return (a_start <= b_end) & (b_start <= a_end)
    return (a_end >= b_start) | (b_end <= a_start)


def adjacent_pairs(
    subreads: DataFrame, mode: str = "reference", width: Width = AUTO
) -> DataFrame:
    """(cell, hole, a_start, a_end, b_start, b_end, distance, overlaps, pairs).

    One row per distinct neighbouring pair of a well, with how often it occurs.
    """
    distinct = subreads.groupBy(*WELL, "qs", "qe").agg(F.count(F.lit(1)).alias("_n"))
    previous = Running("_prev", "last", F.struct("qs", "qe"))
    ordered = with_preceding(distinct, [previous], WELL, ["qs", "qe"], choose_width(subreads, WELL, width))
    to_previous = F.struct(
        F.col("_prev.qs").alias("a_start"), F.col("_prev.qe").alias("a_end"), F.lit(1).cast("bigint").alias("pairs")
    )
    to_copies = F.struct(
        F.col("qs").alias("a_start"), F.col("qe").alias("a_end"), (F.col("_n") - 1).alias("pairs")
    )
    sides = ordered.select(
        *WELL, F.explode(F.array(to_previous, to_copies)).alias("_a"), F.col("qs").alias("b_start"), F.col("qe").alias("b_end")
    ).select(*WELL, "_a.a_start", "_a.a_end", "b_start", "b_end", "_a.pairs")
    places = [F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]
    return sides.filter(F.col("a_start").isNotNull() & (F.col("pairs") > 0)).select(
        *WELL,
        *places,
        interval_distance(*places).alias("distance"),
        interval_overlaps(*places, mode=mode).alias("overlaps"),
        "pairs",
    )


def reads_per_well_histogram(subreads: DataFrame) -> DataFrame:
    """(n_reads, n_wells), ascending."""
    wells = subreads.groupBy(*WELL).agg(F.count(F.lit(1)).alias("n_reads"))
    return wells.groupBy("n_reads").agg(F.count(F.lit(1)).alias("n_wells")).orderBy("n_reads")


def well_summary(
    subreads: DataFrame, mode: str = "reference", width: Width = AUTO
) -> DataFrame:
    """One row: wells with several reads, and wells with an overlapping pair."""
    wells = adjacent_pairs(subreads, mode, width).groupBy(*WELL).agg(F.max("overlaps").alias("_any"))
    return wells.agg(
        F.count(F.lit(1)).alias("n_multiple"),
        F.count_if(F.col("_any")).alias("n_overlapping"),
    )


def gap_histogram(
    subreads: DataFrame,
    bin_width: int = 100,
    mode: str = "all",
    width: Width = AUTO,
) -> DataFrame:
    """(bin_start, n_pairs): gap sizes between neighbours; overlaps fall in bin 0.

    mode="reference" leaves the last well out.
    """
    pairs = adjacent_pairs(subreads, width=width)
    if mode == "reference":
        last = subreads.select(F.max(F.struct(*WELL))).scalar()
        pairs = pairs.filter(F.struct(*WELL) != last)
    bin_start = F.expr(f"distance div {int(bin_width)} * {int(bin_width)}")
    return (
        pairs.groupBy(bin_start.alias("bin_start"))
        .agg(F.sum("pairs").alias("n_pairs"))
        .orderBy("bin_start")
    )
