"""Metadata index of a read set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.murmur import seq_hash
from readloom.functions.sequence import base_counts, seq_length
from readloom.operators.ordered import DEFAULT_WIDTH, Running, with_preceding
from readloom.sources.fasta import read_fasta_offsets


INDEX_COLUMNS = ("id", "len", "na", "nc", "ng", "nt", "nn", "offset", "hash")


def index_rows(reads: DataFrame, fold_case: bool = False) -> DataFrame:
    """(id, len, na..nn, offset, hash); ``reads`` holds id, seq and, if it is known, offset."""
    known = ["offset"] if "offset" in reads.columns else []
    return reads.select("id", *known, *_measures(F.col("seq"), fold_case))


def _measures(seq: Column, fold_case: bool) -> list[Column]:
    return [seq_length(seq).alias("len"), *base_counts(seq, fold_case), seq_hash(seq).alias("hash")]


def index_fasta(spark: SparkSession, paths: str | Sequence[str], fold_case: bool = False) -> DataFrame:
    """The index rows of FASTA files, with source_file; sequences are measured where they are read."""
    placed = read_fasta_offsets(spark, paths, lambda seq: _measures(seq, fold_case))
    return placed.select(*INDEX_COLUMNS, "source_file")


def measure_records(pieces: DataFrame, fold_case: bool = False) -> DataFrame:
    """(id, source_file, record_start, len, na..nn) of records that ``read_record_pieces`` gave in pieces.

    Counts add up, so each task sends one row per record that it has pieces of.
    """
    measures = [seq_length(F.col("seq")).alias("len"), *base_counts(F.col("seq"), fold_case)]
    counted = pieces.select("id", "source_file", "record_start", *measures)
    names = counted.columns[3:]
    return counted.groupBy("id", "source_file", "record_start").agg(*[F.sum(n).alias(n) for n in names])


def build_index(reads: DataFrame, fold_case: bool = False, offsets: DataFrame | None = None) -> DataFrame:
    """The index in ascending order of length, then place in the file.

    ``offsets`` (id, offset) is given where ``reads`` does not hold the places. Only the
    narrow index rows are joined and sorted; sequences stay out of the shuffle.
    """
    rows = index_rows(reads, fold_case)
    if offsets is not None:
        rows = rows.join(offsets.select("id", "offset"), "id")
    return rows.select(*INDEX_COLUMNS).orderBy("len", "offset")


def record_offsets(
    reads: DataFrame, order: str = "id", width: int | None = DEFAULT_WIDTH
) -> DataFrame:
    """Byte place of each read in the FASTA text ``write_fasta`` would give.

    A record is '>', the id, a line break, the sequence, and a line break.
    ``order`` is the numeric column the reads are written in order of.
    """
    size = F.octet_length(F.col("id").cast("string")) + F.octet_length("seq") + 3
    sized = reads.select(*[c for c in reads.columns if c != "seq"], seq_length(F.col("seq")).alias("len"),
                         size.cast("bigint").alias("_size"))
    return with_preceding(
        sized, [Running("offset", "sum", F.col("_size"))], [], [order], width
    ).drop("_size")
