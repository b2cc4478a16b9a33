"""Status of work items from arriving log lines.

A file stream reads each file once. Logs that still grow must arrive as
finished segments whose lines carry their number (file, line_no, line), and the
segments of one log in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.operators.status import RANKED, log_events, named_status, parse_lines, parsed_events, parsed_failures
from readloom.streaming.versions import MergedTable, start_batches, write_version


def running_status(lines: DataFrame) -> DataFrame:
    """(rowid, status) of rows named so far, for update or complete output mode.

    The state is one rank per row. The highest rank wins, so arrival order does
    not matter. Scheduler errors, which need the order of lines, are left to ``stream_status``.
    """
    best = log_events(lines).groupBy("rowid").agg(F.max("rank").alias("rank"))
    name = F.element_at(F.array(*[F.lit(s) for s in RANKED]), F.col("rank") + 1)
    return best.select("rowid", name.alias("status"))


def _newest_start(starts: DataFrame) -> DataFrame:
    newest = starts.groupBy("file").agg(F.max(F.struct("line_no", "_started")).alias("_last"))
    return newest.select("file", "_last.line_no", "_last._started")


def _highest_rank(said: DataFrame) -> DataFrame:
    return said.groupBy("rowid").agg(F.max("rank").alias("rank"))


def _behind_last_starts(parsed: DataFrame, starts: MergedTable, batch_id: int) -> DataFrame:
    """The batch's parsed lines, and the last start line that the files of its errors had before."""
    earlier = starts.read(batch_id)
    if earlier is None:
        return parsed
    asked = parsed.filter("_error").select("file").distinct()
    found = _newest_start(earlier.join(asked, "file", "left_semi")).withColumn("_error", F.lit(False))
    return parsed.unionByName(found, allowMissingColumns=True)


def _add_starts(parsed: DataFrame, starts: MergedTable, batch_id: int) -> None:
    starts.add(parsed.filter(F.col("_started").isNotNull()).select("file", "line_no", "_started"), batch_id)


def stream_failures(
    lines: DataFrame, hits_dir: str, state_dir: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Attribute scheduler errors as their lines arrive; rows go to ``hits_dir``.

    The state is the last start line of each file, put in front of the file's next lines. A batch writes
    one row for each of its own files; ``MergedTable`` keeps the number of folders low. The
    batch operator then does the work, chunks of a hot file included.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        starts = MergedTable(batch.sparkSession, state_dir, _newest_start)
        parsed = parse_lines(batch).persist()
        write_version(parsed_failures(_behind_last_starts(parsed, starts, batch_id)), hits_dir, batch_id)
        _add_starts(parsed, starts, batch_id)
        parsed.unpersist()

    return start_batches(lines, handle, checkpoint, once)


def stream_status(
    lines: DataFrame, ranks_dir: str, state_dir: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """What arriving lines say about rows, scheduler errors included, into ``ranks_dir``.

    Each line is parsed once. A batch adds the rows it speaks of, with their highest rank in it; ``status_so_far``
    folds them. Both tables merge their runs as batches pass, so readers open few folders.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        starts = MergedTable(batch.sparkSession, state_dir, _newest_start)
        ranks = MergedTable(batch.sparkSession, ranks_dir, _highest_rank)
        parsed = parse_lines(batch).persist()
        hit = parsed_failures(_behind_last_starts(parsed, starts, batch_id)).select("rowid", F.lit(2).alias("rank"))
        ranks.add(parsed_events(parsed).unionByName(hit), batch_id)
        _add_starts(parsed, starts, batch_id)
        parsed.unpersist()

    return start_batches(lines, handle, checkpoint, once)


def status_so_far(spark: SparkSession, requested: DataFrame, ranks_dir: str) -> DataFrame:
    """(rowid, status) of every requested row: ``fold_status`` of all lines that arrived."""
    said = MergedTable(spark, ranks_dir, _highest_rank).read()
    return named_status(requested, spark.createDataFrame([], "rowid bigint, rank int") if said is None else said)
