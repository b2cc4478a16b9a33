"""Runs of consecutive integers and their text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.ordered import AUTO, DEFAULT_WIDTH, Width, choose_width, with_rank

RUNS_PER_SEGMENT = 10_000


def consecutive_runs(
    df: DataFrame, value: str, keys: Sequence[str] = (), width: Width = AUTO
) -> DataFrame:
    """(keys, first, last): maximal runs of consecutive values; duplicates do not matter."""
    distinct = df.select(*keys, F.col(value).cast("bigint").alias("_v")).distinct()
    ranked = with_rank(distinct, "_rank", keys, ["_v"], _width(df, keys, width))
    return (
        ranked.groupBy(*keys, (F.col("_v") - F.col("_rank")).alias("_run"))
        .agg(F.min("_v").alias("first"), F.max("_v").alias("last"))
        .drop("_run")
    )


def compress_runs(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    runs_per_segment: int = RUNS_PER_SEGMENT,
    width: Width = AUTO,
) -> DataFrame:
    """(keys, segment, runs): runs as text, like ``1-3,5``.

    The text of a key is its segments in order, joined by commas. Segments keep
    a row of text, and the group it is collected from, to a bounded size; a key
    with no more runs than ``runs_per_segment`` has segment 0 only.
    """
    width = _width(df, keys, width)
    found = consecutive_runs(df, value, keys, width)
    ranked = with_rank(found, "_rank", keys, ["first"], width)
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(
        F.concat_ws("-", F.col("first"), F.col("last"))
    )
    listed = F.sort_array(F.collect_list(F.struct("first", text.alias("text"))))
    return (
        ranked.withColumn("segment", F.expr(f"(_rank - 1) div {int(runs_per_segment)}"))
        .groupBy(*keys, "segment")
        .agg(F.array_join(F.transform(listed, lambda r: r["text"]), ",").alias("runs"))
    )


def _width(df: DataFrame, keys: Sequence[str], width: Width) -> int | None:
    """Without keys everything is one group, so it is always cut."""
    if not keys and width == AUTO:
        return DEFAULT_WIDTH
    return choose_width(df, keys, width)
