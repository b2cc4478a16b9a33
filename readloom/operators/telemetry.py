"""Accounting records joined with resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = r"\.batch$"
JOB = ["cluster", "node", "job_raw"]


def _task() -> Column:
    return F.regexp_replace("job_task", BATCH, "")


def _well_formed() -> Column:
    return F.size(F.split(_task(), "_")) == 2


def _batch_only(accounting: DataFrame) -> DataFrame:
    return accounting.filter(F.col("job_raw").rlike(BATCH)).withColumn(
        "job_raw", F.regexp_replace("job_raw", BATCH, "")
    )


def batch_records(accounting: DataFrame) -> DataFrame:
    """Batch records with their suffix gone and array_id, task_id split out."""
    parts = F.split(_task(), "_")
    return (
        _batch_only(accounting)
        .filter(_well_formed())
        .select(
            "job_raw", parts[0].alias("array_id"), parts[1].alias("task_id"),
            "node", "cluster", "disk_read", "disk_write", "elapsed", "state",
        )
    )


def malformed_batch_records(accounting: DataFrame) -> DataFrame:
    """Batch records whose job name is not array_task."""
    return _batch_only(accounting).filter(~_well_formed())


def elapsed_seconds(elapsed: Column) -> Column:
    """Seconds of a [days-]hours:minutes:seconds text; null for other texts."""
    part = lambda n: F.regexp_extract(elapsed, r"^(?:([0-9]+)-)?([0-9]+):([0-9]+):([0-9]+)$", n)
    number = lambda n: F.when(part(n) == "", 0).otherwise(part(n).try_cast("bigint"))
    return F.when(part(4) != "", ((number(1) * 24 + number(2)) * 60 + number(3)) * 60 + number(4))


def latest_records(records: DataFrame, order: str = "elapsed") -> DataFrame:
    """One record per raw job id, the last in ``order``; a plain aggregate, so copies fold early.

    Elapsed times are ordered by their length, so a day comes after 23 hours. Where the
    records hold their place in the file, that is the ``order`` to give.
    """
    rest = [c for c in records.columns if c not in ("job_raw", order)]
    key = [elapsed_seconds(F.col(order)).alias("_seconds")] if order == "elapsed" else []
    newest = F.max(F.struct(*key, order, *rest)).alias("_r")
    return records.groupBy("job_raw").agg(newest).select(
        "job_raw", *[F.col(f"_r.{c}").alias(c) for c in records.columns if c != "job_raw"]
    )


def attach_samples(records: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per sample of a recorded job."""
    joined = samples.join(records, JOB)
    return joined.select(
        "job_raw",
        F.concat_ws("_", "array_id", "task_id").alias("jobid"),
        "node", "state", "localtime", "raw_time", "elapsed",
        "mem_limit_gb", "mem_used_gb", "swap_used_gb", "disk_read", "disk_write", "cores",
    )


def missing_telemetry(records: DataFrame, samples: DataFrame) -> DataFrame:
    """Recorded jobs without any sample."""
    return records.join(samples.select(*JOB), JOB, "left_anti")


def core_width_check(attached: DataFrame) -> DataFrame:
    """(job_raw, n_cores, n_samples): jobs whose core count differs from the first job's.

    The first job is the one with the lowest number.
    """
    widths = attached.groupBy("job_raw", F.size("cores").alias("n_cores")).agg(
        F.count(F.lit(1)).alias("n_samples")
    )
    lowest = F.struct(F.col("job_raw").cast("bigint").alias("id"), "n_cores")
    expected = widths.select(F.min(lowest)).scalar()["n_cores"]
    return widths.filter(F.col("n_cores") != expected)


def widen_cores(attached: DataFrame, n_cores: int | None = None) -> DataFrame:
    """cores as columns core1..coreN; N is the widest row unless given."""
    if n_cores is None:
        n_cores = attached.agg(F.max(F.size("cores"))).first()[0] or 0
    rest = [c for c in attached.columns if c != "cores"]
    return attached.select(
        *rest, *[F.get("cores", F.lit(i)).alias(f"core{i + 1}") for i in range(n_cores)]
    )
