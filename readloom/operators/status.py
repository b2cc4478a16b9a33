"""Status of work items, folded from task logs and summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import schemas
from readloom.operators.ordered import AUTO, CHUNK, Running, Width, choose_width, with_preceding

# Line shapes of the task logs.
STARTED = r"Starting job\(s\) ([0-9][0-9 ]*)"
FINISHED = r"Finished job\(s\) ([0-9][0-9 ]*)"
FAILED = r"Failed job\(s\) ([0-9][0-9 ]*)"
SCHEDULER_ERROR = r"^slurmstepd: error: \*\*\*"

# Later entries win when a row has several.
RANKED = (schemas.RESERVED, schemas.RUNNING, schemas.FAILED, schemas.COMPLETED)
ACTIVE = (
    schemas.RUNNING, schemas.RESERVED, schemas.PENDING, schemas.COMPLETING, schemas.CONFIGURING,
)


def _ids(line: Column, shape: str) -> Column:
    """Row ids named by a line of this shape; null for other lines."""
    named = F.regexp_extract(line, shape, 1)
    return F.when(
        named != "", F.transform(F.split(F.trim(named), " +"), lambda i: i.cast("bigint"))
    )


def parse_lines(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(file, line_no, _started, _failed, _finished, _error) of lines that say something: ids by shape, in one pass."""
    line = F.col("line")
    said = [_ids(line, shape).alias(name) for shape, name in ((STARTED, "_started"), (FAILED, "_failed"), (FINISHED, "_finished"))]
    parsed = lines.select("file", order, *said, line.rlike(SCHEDULER_ERROR).alias("_error"))
    return parsed.filter(F.col("_error") | F.coalesce("_started", "_failed", "_finished").isNotNull())


def parsed_events(parsed: DataFrame) -> DataFrame:
    """``log_events`` of what ``parse_lines`` gave."""
    return _events(parsed, (F.col("_started"), F.col("_failed"), F.col("_finished")))


def log_events(lines: DataFrame) -> DataFrame:
    """(rowid, rank): what each line says about each row it names."""
    return _events(lines, tuple(_ids(F.col("line"), shape) for shape in (STARTED, FAILED, FINISHED)))


def _events(rows: DataFrame, ids: tuple[Column, Column, Column]) -> DataFrame:
    said = [F.struct(named.alias("ids"), F.lit(rank).alias("rank")) for rank, named in enumerate(ids, 1)]
    return (
        rows.select(F.explode(F.array(*said)).alias("_s"))
        .filter(F.col("_s.ids").isNotNull())
        .select(F.explode("_s.ids").alias("rowid"), F.col("_s.rank").alias("rank"))
    )


def with_known_token(
    lines: DataFrame, tokens: DataFrame, pattern: str = r"_([0-9a-f]+_[0-9]+)_[0-9]+_[0-9]+\.log$"
) -> DataFrame:
    """Lines of files whose name carries one of the ``tokens`` (column token).

    The token is cut out of the name and compared whole, so no file is tried
    against every token.
    """
    named = lines.withColumn("token", F.regexp_extract("file", pattern, 1))
    known = tokens.filter(F.col("token").isNotNull()).select("token").distinct()
    return named.join(known, "token", "left_semi").drop("token")


def attribute_failures(
    lines: DataFrame, order: str = "line_no", chunk: str | None = None, width: Width = AUTO
) -> DataFrame:
    """(rowid, file, line_no): rows hit by a scheduler error.

    The error names no rows, so it falls on those of the last start line before
    it in the same file. An error before any start hits nothing. A file too
    large for a task is cut into chunks of ``width`` lines, or by the ``chunk``
    column, which must grow with ``order``.
    """
    marked = lines.select(
        "file",
        order,
        *([F.col(chunk).alias(CHUNK)] if chunk else []),
        _ids(F.col("line"), STARTED).alias("_started"),
        F.col("line").rlike(SCHEDULER_ERROR).alias("_error"),
    ).filter(F.col("_error") | F.col("_started").isNotNull())
    return _hits(marked, order, choose_width(lines, ["file"], width))


def parsed_failures(parsed: DataFrame, order: str = "line_no", width: Width = AUTO) -> DataFrame:
    """``attribute_failures`` of what ``parse_lines`` gave."""
    marked = parsed.select("file", order, "_started", "_error").filter(F.col("_error") | F.col("_started").isNotNull())
    return _hits(marked, order, choose_width(marked, ["file"], width))


def _hits(marked: DataFrame, order: str, chosen: int | None) -> DataFrame:
    if chosen is None:
        marked = marked.drop(CHUNK)
    placed = with_preceding(
        marked, [Running("_hit", "last", F.col("_started"))], ["file"], [order], chosen
    )
    hits = placed.filter(F.col("_error") & F.col("_hit").isNotNull())
    return hits.select(F.explode("_hit").alias("rowid"), "file", order)


def fold_status(
    requested: DataFrame,
    lines: DataFrame,
    order: str = "line_no",
    chunk: str | None = None,
) -> DataFrame:
    """(rowid, status) of every requested row: finished beats failed beats started.

    A row no line speaks of is RESERVED. Scheduler errors count as failures.
    """
    hit = attribute_failures(lines, order, chunk).select("rowid", F.lit(2).alias("rank"))
    return named_status(requested, log_events(lines).unionByName(hit))


def named_status(requested: DataFrame, events: DataFrame) -> DataFrame:
    """(rowid, status) of every requested row by the highest rank among its ``events`` (rowid, rank)."""
    best = events.groupBy("rowid").agg(F.max("rank").alias("rank"))
    name = F.element_at(F.array(*[F.lit(s) for s in RANKED]), F.coalesce("rank", F.lit(0)) + 1)
    return requested.select("rowid").join(best, "rowid", "left").select("rowid", name.alias("status"))


def status_summary(work: DataFrame) -> DataFrame:
    """One row: all items, and items per reported status, in one pass."""
    shown = (
        schemas.RUNNING, schemas.COMPLETED, schemas.PENDING, schemas.RESERVED,
        schemas.CANCELLED, schemas.FAILED, schemas.NOTSTARTED,
    )
    return work.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in shown],
    )


def project_summary(project: DataFrame, blocks: DataFrame, work: DataFrame) -> DataFrame:
    """``status_summary`` with the project's own fields and its number of blocks."""
    counts = status_summary(work)
    n_blocks = blocks.select(F.count(F.lit(1))).scalar()
    fields = [project.select(c).scalar().alias(c) for c in project.columns]
    return counts.select(*fields, n_blocks.alias("blocks"), *counts.columns)


def active_tokens(work: DataFrame) -> DataFrame:
    """One row: distinct reservations still held or running."""
    held = work.filter(F.col("status").isin(*ACTIVE))
    return held.agg(F.count_distinct("reservation_token").alias("n_active"))


def lookup_by_ids(work: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("jobid",)) -> DataFrame:
    """rowid and the asked columns of the rows named in ``ids``."""
    return work.join(ids.select("rowid"), "rowid", "left_semi").select("rowid", *columns)
