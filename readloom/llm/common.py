"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.session import cut_lineage

#: ASCII white space, written out where a contract names it.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no model learns from; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """All rows if there are at most ``most``; else about that many, chosen by a hash of the key.

    The narrow count is one pass; the choice is a filter, so no task sees more than its own rows.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key.cast("string"), F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def _row_key(rows: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c).cast("string") for c in rows.columns], F.lit(17))


def bounded_sample_of_rows(rows: DataFrame, most: int) -> DataFrame:
    """All rows if there are at most ``most``; else at most about that many different ones.

    They are chosen by a hash of all columns and come once each, so an id, or a row, that repeats is no larger part of
    the sample than others.
    """
    n = rows.count()
    if n <= most:
        return rows
    chosen = rows.withColumn("_key", _row_key(rows)).where(F.pmod("_key", F.lit(1 << 30)) < int((1 << 30) * most / n))
    return chosen.dropDuplicates(["_key"]).drop("_key")


def bounded_sample_of_each(rows: DataFrame, group: str, sizes: dict[str, int], most: int) -> DataFrame:
    """About ``most`` rows at most: small groups whole, the others in about equal numbers.

    Rows are chosen as in :func:`bounded_sample_of_rows`. ``sizes`` has the rows of every group; a group gets what smaller ones leave of their equal shares.
    """
    left, share = most, {}
    for i, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        got = min(n, max(1, left // (len(sizes) - i)))
        share[name], left = got / n, left - got
    if all(x >= 1 for x in share.values()):
        return rows
    bars = rows.sparkSession.createDataFrame([(k, int((1 << 30) * x)) for k, x in share.items()], f"`{group}` string, _bar long")
    chosen = rows.withColumn("_key", _row_key(rows)).join(F.broadcast(bars), group).where(F.pmod("_key", F.lit(1 << 30)) < F.col("_bar"))
    return chosen.dropDuplicates(["_key"]).drop("_bar", "_key")


def labelled_texts(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """_id, _text and the other columns of ``known`` (one row per _id): one row per id and text.

    If these are more than ``most``, each id has one row, that of its text with the smallest hash: an
    id that repeats in ``docs`` neither fills the driver nor outweighs the other ids.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    chosen = cut_lineage(rows.select("_id", "_hash").join(known, "_id").distinct())
    if chosen.count() > most:
        chosen = chosen.groupBy(*[c for c in chosen.columns if c != "_hash"]).agg(F.min("_hash").alias("_hash"))
    return rows.join(chosen, ["_id", "_hash"]).dropDuplicates(["_id", "_hash"]).drop("_hash")


def batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Run ``make()`` once per task and its result on every Arrow batch."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in source:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def packed(docs: DataFrame) -> Column:
    """All columns as one struct, so that no helper column can clash with a column of the input."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if docs.columns else F.struct(F.lit(1).alias("_"))


def unpacked(df: DataFrame, struct: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(struct).getField(c).alias(c) for c in columns])


__all__ = ["BLANK", "batches", "bounded_sample", "bounded_sample_of_each", "bounded_sample_of_rows", "cut_lineage", "held_out", "labelled_texts", "packed", "table", "unpacked"]
