"""Exact deduplication by sorting content.

Sampled splitters (Spark's range partitioner) deal the rows out by a bounded prefix
of the normalised bytes, then by their 64-bit hash; an external sort inside each
partition puts equal texts next to each other; a window over the sorted rows starts
a new group wherever the full text differs from its neighbour's, so a hash never
decides. Only the bounded prefix and hash go into the splitter sample.

A text whose hash more than ``chunk_rows`` rows share is cut into chunks by a hash
of the id before the sort, and the heads of its chunks meet afterwards: no task
gets all copies of one text. Where very many copies fall to one of 64 parts of the ids, which copies
under one id do, rows are numbered, written, and cut by their number instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import cut_lineage, packed, unpacked

#: Copies of a text in one chunk, on average.
CHUNK_ROWS = 256
#: Hashes of hot texts up to this many go to every task; beyond, the join is a shuffled one.
BROADCAST_HASHES = 100_000
#: Parts of the ids that copies of a text are counted in, and chunks' worth of rows that a part may have.
ID_PARTS = 64
PART_CHUNKS = 8
#: Leading bytes of a text in the sort key.
PREFIX = 16


def normalised(text: Column) -> Column:
    """Null becomes empty; every run of ASCII white space becomes one space.

    Single spaces are already in form, so the pattern passes over them.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _sorted(docs: DataFrame, text: str, doc_id: str, row: Column, chunk_rows: int) -> DataFrame:
    """Rows range-partitioned by content: _row, _id, _raw, _prefix, _hash, _chunk, _chunks."""
    norm = normalised(F.col(f"`{text}`"))
    keyed = docs.select(row.alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_raw"), F.xxhash64(norm).alias("_hash"), F.substring(norm, 1, PREFIX).alias("_prefix"))
    by_id = F.xxhash64(F.col("_id").cast("string"), F.lit(5))
    parts = keyed.groupBy("_hash", F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(6)), F.lit(ID_PARTS)).alias("_part")).agg(F.count("*").alias("_n"))
    sizes = parts.groupBy("_hash").agg(F.sum("_n").alias("_n"), F.max("_n").alias("_most"))
    hot = cut_lineage(sizes.where(F.col("_n") > chunk_rows).select("_hash", F.ceil(F.col("_n") / chunk_rows).alias("_chunks"), "_most"))
    if hot.where(F.col("_most") > PART_CHUNKS * chunk_rows).head(1):
        keyed = cut_lineage(keyed.withColumn("_no", F.monotonically_increasing_id()))
        by_id = F.xxhash64("_no", F.lit(5))
    hot = hot.drop("_most")
    if hot.count() <= BROADCAST_HASHES:
        hot = F.broadcast(hot)
    return (
        keyed.join(hot, "_hash", "left")
        .withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
        .withColumn("_chunk", F.pmod(by_id, F.col("_chunks")))
        .drop("_no")
        .repartitionByRange("_prefix", "_hash", "_chunk")
        .withColumn("_text", normalised(F.col("_raw")))
    )


def _neighbours() -> Window:
    return Window.partitionBy("_prefix", "_hash", "_chunk", "_text")


def _least(name: str) -> Column:
    """The smallest id, nulls last, and of its chunks the first, as equal ids may lie in several."""
    return F.min(F.struct(F.col(name).isNull().alias("_null"), F.col(name).alias("_keep"), F.col("_chunk").alias("_at")))


def _by_id():
    return _neighbours().orderBy(F.col("_id").asc_nulls_last())


def decisions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Null texts equal empty ones. Ties and repeated rows: of rows that share text and
    smallest id exactly one is kept. Null ids sort last; a group of null ids only has a
    null keep_id and still keeps one row. An empty table gives an empty result.
    """
    rows = _sorted(docs, text, doc_id, F.lit(None).cast("string"), chunk_rows)
    near = rows.select(
        "_id",
        "_hash",
        "_chunk",
        (F.col("_chunks") > 1).alias("_hot"),
        F.sha2("_text", 256).alias("_sha"),
        F.row_number().over(_by_id()).alias("_rank"),
        F.min("_id").over(_neighbours()).alias("_first"),
        F.count("*").over(_neighbours()).alias("_size"),
        "_text",
    ).withColumn("_text", F.when(F.col("_hot") & (F.col("_rank") == 1), F.col("_text")))
    near = cut_lineage(near)
    heads = near.where(F.col("_hot") & (F.col("_rank") == 1))
    # one row per chunk of a hot text: the full texts are compared once more
    groups = heads.groupBy("_hash", "_text").agg(_least("_first").alias("_best"), F.sum("_size").alias("_total"))
    settled = heads.join(groups, ["_hash", "_text"]).select("_hash", "_chunk", F.col("_sha"), "_best._keep", "_best._at", "_total")
    hot = near.where("_hot").join(settled, ["_hash", "_chunk", "_sha"])
    kept = (F.col("_rank") == 1) & (F.col("_chunk") == F.col("_at"))
    cold = near.where(~F.col("_hot")).withColumns({"_keep": F.col("_first"), "_total": F.col("_size"), "_at": F.col("_chunk")})
    columns = [F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_total").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256")]
    return cold.select(*columns).unionByName(hot.select(*columns))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts are shuffled once, with their rows. Cases are as in :func:`decisions`.
    """
    rows = _sorted(docs, text, doc_id, packed(docs.drop(text)), chunk_rows)
    heads = cut_lineage(rows.withColumn("_rank", F.row_number().over(_by_id())).where("_rank = 1").drop("_rank", "_text"))
    hot = heads.where("_chunks > 1").withColumn("_text", normalised(F.col("_raw")))
    best = hot.groupBy("_hash", "_text").agg(_least("_id").alias("_best"))
    winners = hot.join(best, ["_hash", "_text"]).where(F.col("_chunk") == F.col("_best._at"))
    out = heads.where("_chunks = 1").select("_row", "_raw").unionByName(winners.select("_row", "_raw"))
    others = [c for c in docs.columns if c != text]
    return out.select(*[F.col("_raw").alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns]) if others else out.select(F.col("_raw").alias(text))
