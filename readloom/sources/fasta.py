"""FASTA in and out.

Records are split on newline + ``>`` by the text source itself, so plain files
stay splittable. Gzip files are read whole by one task each; repartition after.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.ordered import CHUNK, Running, with_preceding

RECORD_BREAK = "\n>"


def _raw_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    source = spark.read.text(paths, lineSep=RECORD_BREAK)
    return source.select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("split_row"),
    ).filter(F.length(F.trim(F.regexp_replace("value", "[\r\n]+", ""))) > 0)


def _header(value: Column) -> Column:
    first_line = F.regexp_replace(F.substring_index(value, "\n", 1), "\r$", "")
    return F.regexp_replace(first_line, "^>", "")


def _sequence(value: Column) -> Column:
    """All lines after the first, joined."""
    return F.regexp_replace(F.regexp_replace(value, "^[^\n]*\n?", ""), "[\r\n]+", "")


def read_fasta(spark: SparkSession, paths: str | Sequence[str], key: bool = False) -> DataFrame:
    """(id, seq, source_file) per record; several paths make one read set.

    key=True adds split_start and split_row: file order within source_file.
    """
    raw = _raw_records(spark, paths)
    columns = [_header(F.col("value")).alias("id"), _sequence(F.col("value")).alias("seq"), "source_file"]
    return raw.select(*columns, *(["split_start", "split_row"] if key else []))


def read_fasta_offsets(
    spark: SparkSession,
    paths: str | Sequence[str],
    measures: Callable[[Column], Sequence[Column]] = lambda seq: [seq.alias("seq")],
) -> DataFrame:
    """(id, measures, source_file, offset): records with their byte position in the file.

    Sums record sizes inside each input split and carries one total per split,
    so no file passes through one task. For uncompressed files. ``measures`` makes
    columns of a record's sequence before it is placed, so that only these are
    shuffled; without it the sequence itself is.
    """
    measured = measures(F.col("_seq"))
    raw = _raw_records(spark, paths).withColumn("_seq", _sequence(F.col("value"))).select(
        _header(F.col("value")).alias("id"),
        *measured,
        "source_file",
        "split_start",
        "split_row",
        (F.octet_length("value") + len(RECORD_BREAK)).cast("bigint").alias("_bytes"),
    ).withColumnRenamed("split_start", CHUNK)
    placed = with_preceding(
        raw, [Running("_before", "sum", F.col("_bytes"))], ["source_file"], ["split_row"]
    )
    # All but the first record lost their leading '>' to the separator.
    offset = F.when(F.col("_before") == 0, F.lit(0)).otherwise(F.col("_before") - 1)
    return placed.withColumn("offset", offset.cast("bigint")).drop("split_row", "_bytes", "_before", CHUNK)


def read_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(line): header lines of header lists or FASTA files; the rest is skipped."""
    lines = spark.read.text(paths)
    return lines.filter(F.startswith("value", F.lit(">"))).select(F.rtrim("value").alias("line"))


def fasta_record(name: Column, seq: Column, width: int | None = None) -> Column:
    """One record as text, the sequence optionally wrapped."""
    body = seq
    if width is not None:
        wrapped = F.regexp_replace(seq, f"(.{{{width}}})", "$1\n")
        body = F.regexp_replace(wrapped, "\n$", "")
    return F.concat(F.lit(">"), name.cast("string"), F.lit("\n"), body)


def write_fasta(
    df: DataFrame,
    path: str,
    name: str = "id",
    seq: str = "seq",
    width: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write a folder of FASTA files, one per partition."""
    df.select(fasta_record(F.col(name), F.col(seq), width).alias("value")).write.mode(mode).text(path)


def contaminant_name(target: Column, reference: Column) -> Column:
    """Record name of a screened-out read: its own and its match's."""
    return F.concat(target.cast("string"), F.lit(" || "), reference.cast("string"))
