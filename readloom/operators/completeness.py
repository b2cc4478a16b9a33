"""What exists, what is missing, what is left to do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDLE = "INTERVAL 5 MINUTES"


def _settled(as_of: Column, idle: str) -> Column:
    """Not empty, and untouched for longer than ``idle``."""
    return (F.col("size") > 0) & (as_of - F.col("mtime") > F.expr(idle))


def _file_name() -> Column:
    return F.substring_index("path", "/", -1)


def quiescent_files(
    inventory: DataFrame, pattern: str, as_of: Column | None = None, idle: str = IDLE
) -> DataFrame:
    """(block_id), sorted: ids in the names of settled files that match ``pattern``.

    The pattern is anchored by its author and has the id as group 1.
    """
    now = F.current_timestamp() if as_of is None else as_of
    matching = inventory.filter(_file_name().rlike(pattern) & _settled(now, idle))
    found = F.regexp_extract(_file_name(), pattern, 1).cast("bigint")
    return matching.select(found.alias("block_id")).orderBy("block_id")


def stage_matrix(
    blocks: DataFrame,
    completed: DataFrame,
    inventory: DataFrame,
    stages: Mapping[str, str],
    as_of: Column | None = None,
    idle: str = IDLE,
) -> DataFrame:
    """(block_id, aligned, one column per stage): which stages each block has passed.

    stages maps a stage to the pattern of its file names (block id = group 1).
    All stages are found in one pass over the inventory.
    """
    now = F.current_timestamp() if as_of is None else as_of
    block = F.coalesce(
        *[F.nullif(F.regexp_extract(_file_name(), p, 1), F.lit("")) for p in stages.values()]
    )
    reached = (
        inventory.filter(_settled(now, idle))
        .select(block.cast("bigint").alias("block_id"), *[_file_name().rlike(p).alias(s) for s, p in stages.items()])
        .filter(F.col("block_id").isNotNull())
        .groupBy("block_id")
        .agg(*[F.max(s).alias(s) for s in stages])
    )
    aligned = completed.select("block_id", F.lit(True).alias("aligned"))
    joined = blocks.select("block_id").join(aligned, "block_id", "left").join(reached, "block_id", "left")
    return joined.select(
        "block_id", *[F.coalesce(s, F.lit(False)).alias(s) for s in ("aligned", *stages)]
    )


def stage_totals(matrix: DataFrame) -> DataFrame:
    """One row: blocks per stage."""
    return matrix.agg(*[F.count_if(F.col(s)).alias(s) for s in matrix.columns if s != "block_id"])


def missing_artifacts(
    blocks: DataFrame,
    inventory: DataFrame,
    project: str,
    tracks: Sequence[str] = ("q", "trim", "repeats"),
    extensions: Sequence[str] = ("a2", "d2"),
) -> DataFrame:
    """(block_id, track, ext): required track files that are absent or empty; ``project`` is a plain name, not a pattern."""
    kinds = F.array(
        *[F.struct(F.lit(t).alias("track"), F.lit(x).alias("ext")) for t in tracks for x in extensions]
    )
    required = blocks.select("block_id", F.explode(kinds).alias("_k")).select("block_id", "_k.track", "_k.ext")
    quoted = project.replace("\\E", r"\E\\E\Q")
    shape = rf"^\.\Q{quoted}\E\.([0-9]+)\.([a-z]+)\.([a-z0-9]+)$"
    present = inventory.filter((F.col("size") > 0) & _file_name().rlike(shape)).select(
        F.regexp_extract(_file_name(), shape, 1).cast("bigint").alias("block_id"),
        F.regexp_extract(_file_name(), shape, 2).alias("track"),
        F.regexp_extract(_file_name(), shape, 3).alias("ext"),
    )
    return required.join(present, ["block_id", "track", "ext"], "left_anti")


def remaining(existing: DataFrame, finished: DataFrame, key: str = "block_id") -> DataFrame:
    """Existing keys without a finished one, each once."""
    return existing.select(key).distinct().join(finished.select(key), key, "left_anti")


def in_both(left: DataFrame, right: DataFrame, key: str = "block_id") -> DataFrame:
    """Keys in both listings, each once."""
    return left.select(key).intersect(right.select(key))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def dangling_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose ``column`` names no parent."""
    return child.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def key_checks(work: DataFrame, blocks: DataFrame) -> DataFrame:
    """(check, n): counts behind the keys of the planning tables."""
    pair = ["block_id1", "block_id2"]

    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")

    checks = {
        "duplicate_pairs": duplicate_keys(work, pair),
        "duplicate_blocks": duplicate_keys(blocks, ["block_id"]),
        "dangling_block_id1": dangling_references(work, "block_id1", blocks, "block_id"),
        "dangling_block_id2": dangling_references(work, "block_id2", blocks, "block_id"),
        "blocks": blocks,
        "work_items": work,
        "masked_items": work.filter("use_masking"),
    }
    rows = [counted(name, df) for name, df in checks.items()]
    report = rows[0]
    for row in rows[1:]:
        report = report.unionByName(row)
    return report
