"""Interval algebra on half-open ``[b, e)`` ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_length(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Bases shared by two intervals."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(b1, b2))


def covered_by(b: Column, e: Column, intervals: Column) -> Column:
    """Bases of ``[b, e)`` covered by an array of disjoint ``(b, e)`` structs."""
    return F.aggregate(
        intervals,
        F.lit(0).cast("bigint"),
        lambda total, one: total + overlap_length(b, e, one["b"], one["e"]).cast("bigint"),
    )


def merge_intervals(df: DataFrame, keys: Sequence[str], bridge: int = 0) -> DataFrame:
    """Union of intervals per key; gaps up to ``bridge`` are closed.

    Input columns: keys, b, e. The keys are things with an extent, like reads:
    rows are first reduced to one per (key, b), so a key has at most one row per
    place on it, however many intervals it came with.
    """
    by_start = df.groupBy(*keys, "b").agg(F.max("e").alias("e"))
    by_place = Window.partitionBy(*keys).orderBy("b")
    reach = F.max("e").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("_reach").isNull() | (F.col("b") > F.col("_reach") + F.lit(bridge))
    marked = by_start.withColumn("_reach", reach).withColumn("_open", F.when(opens, F.col("b")))
    so_far = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.last("_open", ignorenulls=True).over(so_far)
    return (
        marked.select(*keys, island.alias("_start"), "e")
        .groupBy(*keys, F.col("_start").alias("b"))
        .agg(F.max("e").alias("e"))
    )


def longest_interval(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest interval per key, the earliest on ties."""
    best = F.max(F.struct((F.col("e") - F.col("b")).alias("n"), (-F.col("b")).alias("nb"), "e"))
    return (
        df.groupBy(*keys)
        .agg(best.alias("_best"))
        .select(*keys, (-F.col("_best.nb")).alias("b"), F.col("_best.e").alias("e"))
    )


def step_function(
    df: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Sums of ``values`` over the intervals covering each place.

    Input: keys, b, e, values. Every interval becomes a rise at b and a fall at
    e, added up per (key, place) before the shuffle: two rows per interval at
    most, and never one per base. Output: keys, b, e, values, one row per
    stretch over which the sums are constant, gaps between intervals included.
    """
    changes = df.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("b").alias("b"), *[F.col(v).alias(v) for v in values]),
                F.struct(F.col("e").alias("b"), *[(-F.col(v)).alias(v) for v in values]),
            )
        ).alias("_c"),
    )
    at_place = changes.groupBy(*keys, F.col("_c.b").alias("b")).agg(
        *[F.sum(f"_c.{v}").alias(v) for v in values]
    )
    by_place = Window.partitionBy(*keys).orderBy("b")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = at_place.select(
        *keys,
        "b",
        F.lead("b").over(by_place).alias("e"),
        *[F.sum(v).over(so_far).alias(v) for v in values],
    )
    return stepped.filter(F.col("e").isNotNull())


def hysteresis(
    steps: DataFrame, keys: Sequence[str], value: str, high: float, low: float
) -> DataFrame:
    """Regions that open at ``value >= high`` and close at ``value < low``.

    ``steps`` is a step function (keys, b, e, value) without holes.
    """
    by_place = Window.partitionBy(*keys).orderBy("b")
    seen = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    switch = F.when(F.col(value) >= F.lit(high), F.lit(1)).when(F.col(value) < F.lit(low), F.lit(0))
    held = steps.withColumn("_on", F.coalesce(F.last(switch, ignorenulls=True).over(seen), F.lit(0)))
    turned = held.withColumn("_was", F.lag("_on", 1, 0).over(by_place))
    open_at = F.when((F.col("_on") == 1) & (F.col("_was") == 0), F.col("b"))
    placed = turned.withColumn("_start", F.last(open_at, ignorenulls=True).over(seen))
    return (
        placed.filter(F.col("_on") == 1)
        .groupBy(*keys, F.col("_start").alias("b"))
        .agg(F.max("e").alias("e"))
    )
