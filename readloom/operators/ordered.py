"""Running values over ordered rows, without a task per hot key.

A window partitioned by a key puts every row of that key into one task, and a
window without a key puts everything there. Where that could be too much, the
functions below cut each key's rows into chunks by position, run the window
inside (key, chunk), and add what earlier chunks contribute from a table with
one row per (key, chunk).

Callers bring rows that are unique, or nearly so, per (key, position) — most
aggregate duplicates first — so a chunk of ``width`` positions holds about
``width`` rows however many rows the key has. The chunk is plain arithmetic on
the row, so a recomputed partition always lands in the same chunk.

``choose_width`` measures whether any key is that large; if none is, a plain
window is the shorter plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
DEFAULT_WIDTH = 1 << 16
AUTO = "auto"
Width = int | None | str

KEY_BUCKETS = 1 << 16
TASK_ROWS = 1_000_000


def choose_width(df: DataFrame, keys: Sequence[str], width: Width = AUTO) -> int | None:
    """None if no key is too large for one task, else a chunk width.

    Rows are counted per hash bucket of the key, which sums up almost wholly
    before the shuffle. A bucket bounds each of its keys. The bar is absolute: it
    does not rise with the input, so no key above it ever gets into one task, and an
    input whose buckets are all that large is cut as well.
    """
    if width != AUTO:
        return width
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0]
    return None if (largest or 0) <= TASK_ROWS else DEFAULT_WIDTH


def chunk_of(position: str, width: int) -> Column:
    """Number of the chunk of ``width`` positions, also below zero."""
    return F.expr(f"({position} - pmod({position}, {int(width)})) div {int(width)}")


@dataclass(frozen=True)
class Running:
    """One value folded over the rows that strictly precede the current one.

    kind: ``sum`` (0 when nothing precedes), ``max``, or ``last`` (the latest
    non-null value); the latter two are null when nothing precedes.
    """

    name: str
    kind: str
    value: Column

    def over(self, window) -> Column:
        if self.kind == "sum":
            return F.sum(self.value).over(window)
        if self.kind == "max":
            return F.max(self.value).over(window)
        return F.last(self.value, ignorenulls=True).over(window)

    def total(self, order: Sequence[str]) -> Column:
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        keyed = F.struct(*order, self.value.alias("_value"))
        return F.max(F.when(self.value.isNotNull(), keyed))["_value"]

    def finish(self, near: Column, far: Column | None = None) -> Column:
        if self.kind == "sum":
            base = F.coalesce(near, F.lit(0))
            return base if far is None else base + F.coalesce(far, F.lit(0))
        if far is None:
            return near
        if self.kind == "max":
            return F.greatest(near, far)
        return F.coalesce(near, far)


def with_preceding(
    df: DataFrame,
    running: Sequence[Running],
    keys: Sequence[str],
    order: Sequence[str],
    width: int | None = DEFAULT_WIDTH,
) -> DataFrame:
    """Add each ``Running`` value as a column.

    order[0] is the integer position that chunks are cut on, unless ``df`` comes
    with a column named CHUNK that grows with ``order``; such a column is kept,
    so that a second call finds its rows where the first one left them. Keys and
    position must not be null. width=None runs one plain window per key.
    """
    before_row = (Window.unboundedPreceding, -1)
    kept = df.columns
    given = CHUNK in kept
    if width is None and not given:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before_row)
        return df.select(*kept, *[r.finish(r.over(window)).alias(r.name) for r in running])

    chunked = df if given else df.withColumn(CHUNK, chunk_of(order[0], width))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(*before_row)
    rows = chunked.select(
        *chunked.columns, *[r.over(inside).alias(f"_near_{r.name}") for r in running]
    )
    totals = chunked.groupBy(*keys, CHUNK).agg(
        *[r.total(order).alias(f"_total_{r.name}") for r in running]
    )
    across = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*before_row)
    carried = totals.select(
        *keys,
        CHUNK,
        *[
            Running(r.name, r.kind, F.col(f"_total_{r.name}")).over(across).alias(f"_far_{r.name}")
            for r in running
        ],
    )
    joined = rows.join(carried, [*keys, CHUNK], "left")
    return joined.select(
        *kept,
        *[r.finish(F.col(f"_near_{r.name}"), F.col(f"_far_{r.name}")).alias(r.name) for r in running],
    )


def with_rank(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    order: Sequence[str],
    width: int | None = DEFAULT_WIDTH,
) -> DataFrame:
    """Add the 1-based position of each row inside its key."""
    counted = with_preceding(df, [Running(name, "sum", F.lit(1))], keys, order, width)
    return counted.withColumn(name, (F.col(name) + 1).cast("bigint"))


def with_running_sum(
    df: DataFrame,
    name: str,
    value: Column,
    keys: Sequence[str],
    order: Sequence[str],
    width: int | None = DEFAULT_WIDTH,
) -> DataFrame:
    """Add the inclusive running sum of ``value``."""
    own = f"_own_{name}"
    valued = df.withColumn(own, value)
    summed = with_preceding(valued, [Running(name, "sum", F.col(own))], keys, order, width)
    return summed.withColumn(name, F.col(name) + F.col(own)).drop(own)
