"""Bottom-n k-mer sketches and the similarity screen built on them.

A sequence's sketch is the n smallest distinct k-mer hashes. It is computed
inside the row: no k-mer is ever shuffled.

The best match joins on hashes. Where a hash is in many references, that join would make a
row for each of them and each target. Then an index is searched instead: hashes are put in
order of rarity, a first match gives each target a similarity to beat, and only those
references are looked at whose first shared hash lies early enough on both sides to beat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.sequence import reverse_complement, seq_length
from readloom.session import cut_lineage

PIECE = 1 << 16
BROADCAST_ROWS = 2_000_000
MATCH_ROWS = 500_000
#: Letters, and texts, in one batch of pieces put together; letters of a record whose sketches are merged at once.
BATCH_LETTERS = 4 << 20
BATCH_TEXTS = 4_096
MERGED_LETTERS = 1 << 26
#: References that may share a hash before matches are searched by the index.
MOST_SHARED = 64


def kmers(text: Column, k: int) -> Column:
    """All k-mers in order, by a zero-width match at every position: one linear pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def pieces(text: Column, k: int) -> Column:
    """The text in pieces of PIECE letters, each prolonged by the k - 1 letters that follow it."""
    shape = f"(?s)(.{{1,{PIECE}}})(?=(.{{0,{k - 1}}}))"
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(shape), F.lit(1)),
        F.regexp_extract_all(text, F.lit(shape), F.lit(2)),
        lambda body, tail: F.concat(body, tail),
    )


def minhash_array(text: Column, k: int = 13, n: int = 100, canonical: bool = False, hash_name: str = "xxhash64") -> Column:
    """The sketch as an ascending array. Shorter texts than k give an empty one.

    hash_name: "xxhash64", or "md5" for hashes another engine can recompute.
    canonical=True hashes the lesser of each k-mer and its reverse complement.
    """
    def digest(kmer: Column) -> Column:
        strand = F.least(kmer, reverse_complement(kmer)) if canonical else kmer
        return F.md5(strand) if hash_name == "md5" else F.xxhash64(strand)

    def smallest(hashes: Column) -> Column:
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, n)

    def sketch(piece: Column) -> Column:
        return smallest(F.transform(F.array_distinct(kmers(piece, k)), digest))

    # The n smallest of a union are among the n smallest of its parts, so a long
    # text holds the k-mers of one piece at a time.
    empty = F.array().cast("array<string>" if hash_name == "md5" else "array<bigint>")
    long_text = F.aggregate(
        pieces(text, k), empty, lambda kept, piece: smallest(F.concat(kept, sketch(piece)))
    )
    return F.when(seq_length(text) <= PIECE, sketch(text)).otherwise(long_text)


@dataclass(frozen=True)
class SketchOptions:
    k: int = 13
    n: int = 100
    canonical: bool = False
    hash_name: str = "xxhash64"

    def of(self, text: Column) -> Column:
        return minhash_array(text, self.k, self.n, self.canonical, self.hash_name)


def minhash_sketch(seqs: DataFrame, options: SketchOptions = SketchOptions()) -> DataFrame:
    """(id, h): one row per sketch hash; ``seqs`` holds id and seq."""
    return seqs.select("id", F.explode(options.of(F.col("seq"))).alias("h"))


def sketch_pieces(pieces: DataFrame, options: SketchOptions = SketchOptions()) -> DataFrame:
    """(id, source_file, record_start, h): sketches of records that ``read_record_pieces`` gave in pieces.

    The pieces must be read with an overlap of k - 1 letters or more, so that each k-mer begins in one
    piece. The n smallest hashes of a record are among the n smallest of its pieces. Pieces are put
    together to texts before they are hashed, so short ones do not bring n hashes each, and a record that is one text is not shuffled.
    """
    record = ["id", "source_file", "record_start"]
    narrow = pieces.select(*record, "offset", "seq", F.substring("following", 1, options.k - 1).alias("following"))
    texts = narrow.mapInArrow(_joined, narrow.schema)
    whole = (F.col("offset") == 0) & (F.col("following") == "") if options.k > 1 else F.lit(False)
    whole = F.coalesce(whole, F.lit(False))
    sketched = lambda rows: rows.select(*record, "offset", options.of(F.concat("seq", "following")).alias("_sketch"))
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_sketch")))), 1, options.n).alias("_sketch")
    # a long record's texts are merged by stretches first, so that no group outgrows a row
    stretch = F.expr(f"offset div {MERGED_LETTERS}").alias("_stretch")
    parts = sketched(texts.filter(~whole)).groupBy(*record, stretch).agg(merged).groupBy(*record).agg(merged)
    return sketched(texts.filter(whole)).drop("offset").unionByName(parts).select(*record, F.explode("_sketch").alias("h"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that follow one another in a task as texts of up to PIECE letters, with what follows the last."""
    schema, ready, letters = None, [], 0
    key, offset, held, size, following = None, 0, [], 0, ""

    def text() -> tuple:
        return (*key, offset, "".join(held), following)

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for *record, at, seq, after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if record != key or at != offset + size or size + len(seq) > PIECE:
                if key is not None:
                    ready.append(text())
                    letters += size
                key, offset, held, size = record, at, [], 0
            held.append(seq)
            size += len(seq)
            following = after
            if letters >= BATCH_LETTERS or len(ready) >= BATCH_TEXTS:
                yield packed()
                ready, letters = [], 0
    if key is not None:
        ready.append(text())
        yield packed()


def sketch_references(references: DataFrame, options: SketchOptions = SketchOptions()) -> DataFrame:
    """(reference_id, bsize, h): a table of the references' sketches, to be matched as often as needed.

    References with equal sketches match alike, so only the lowest id of them is kept.
    """
    return cut_lineage(
        references.select("id", options.of(F.col("seq")).alias("_sketch"))
        .groupBy("_sketch")
        .agg(F.min("id").alias("reference_id"))
        .select("reference_id", F.size("_sketch").alias("bsize"), F.explode("_sketch").alias("h"))
    )


def best_match(
    targets: DataFrame, references: DataFrame, options: SketchOptions = SketchOptions()
) -> DataFrame:
    """(target_id, reference_id, hits, asize, bsize, ji): the best reference per target.

    Ties go to the lowest reference id; a target without a hit keeps hits 0 and
    ji 0.
    """
    return match_sketches(targets, sketch_references(references, options), options)


def match_sketches(targets: DataFrame, refs: DataFrame, options: SketchOptions = SketchOptions()) -> DataFrame:
    """``best_match`` against what ``sketch_references`` gave."""
    sketched = targets.select(F.col("id").alias("target_id"), options.of(F.col("seq")).alias("_sketch"))
    counts = refs.groupBy("h").agg(F.count("*").alias("df"))
    if (counts.agg(F.max("df")).first()[0] or 0) > MOST_SHARED:
        return _match_by_index(sketched, refs)
    return _match_by_hash(sketched, refs)


def _small(table: DataFrame) -> DataFrame:
    """The table, broadcast only if it is known to be small; otherwise its joins shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _best(matches: DataFrame, key: str) -> DataFrame:
    """The first match per key by similarity, then reference id; ``matches`` holds hits, asize and bsize."""
    ji = F.col("hits") / (F.col("asize") + F.col("bsize") - F.col("hits"))
    ranked = F.struct(
        (-F.coalesce(ji, F.lit(0.0))).alias("_down"),
        "reference_id",
        "hits",
        F.col("asize").cast("bigint").alias("asize"),
        F.coalesce(F.col("bsize"), F.lit(0)).cast("bigint").alias("bsize"),
    )
    return (
        matches.groupBy(key)
        .agg(F.min(ranked).alias("_best"))
        .select(
            key,
            "_best.reference_id",
            "_best.hits",
            "_best.asize",
            "_best.bsize",
            (-F.col("_best._down")).alias("ji"),
        )
    )


def _match_by_hash(sketched: DataFrame, refs: DataFrame) -> DataFrame:
    """Every target hash meets every reference that has it."""
    hashes = sketched.select(
        "target_id", F.size("_sketch").alias("asize"), F.explode_outer("_sketch").alias("h")
    )
    counted = (
        hashes.join(_small(refs), "h", "left")
        .groupBy("target_id", "asize", "reference_id", "bsize")
        .agg(F.count("reference_id").alias("hits"))
    )
    return _best(counted, "target_id")


def _match_by_index(sketched: DataFrame, refs: DataFrame) -> DataFrame:
    """Targets with equal sketches are matched once; the others by ``search_index``."""
    sketched = cut_lineage(sketched)
    distinct = cut_lineage(
        sketched.filter(F.size("_sketch") > 0)
        .select("_sketch")
        .distinct()
        .select(F.monotonically_increasing_id().alias("_key"), "_sketch")
    )
    first, others = search_index(distinct, refs)
    found = distinct.join(_best(first.unionByName(others), "_key"), "_key").drop("_key", "asize")
    zero = F.lit(0).cast("bigint")
    return sketched.join(found, "_sketch", "left").select(
        "target_id",
        "reference_id",
        F.coalesce("hits", zero).alias("hits"),
        F.size("_sketch").cast("bigint").alias("asize"),
        F.coalesce("bsize", zero).alias("bsize"),
        F.coalesce("ji", F.lit(0.0)).alias("ji"),
    )


def search_index(distinct: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_key, reference_id, bsize, asize, hits): a first match per sketch, and all that may beat it.

    ``distinct`` holds _key and _sketch, ``refs`` what ``sketch_references`` gave. Positions count
    hashes from the rarest one. If a pair shares its first hash at position i of a and j of b, it
    shares at most min(|a| - i, |b| - j). References alike in (hash, |b|, j) are a
    block; a block that cannot beat the first match is passed over as one row.
    """
    rarity = cut_lineage(refs.groupBy("h").agg(F.count("*").alias("df"), F.min("reference_id").alias("_pilot")))
    seen = _small(rarity)
    order = F.array_sort(F.collect_list(F.struct("df", "h")))
    whole = cut_lineage(refs.join(seen, "h").groupBy("reference_id", "bsize").agg(order.alias("_order")))
    postings = cut_lineage(
        whole.select("reference_id", "bsize", F.posexplode("_order").alias("j", "_x")).select("reference_id", "bsize", "j", "_x.h")
    )
    blocks = _small(postings.groupBy("h", "bsize", "j").agg(F.min("reference_id").alias("_least")))
    sketches = _small(whole.select("reference_id", "bsize", F.transform("_order", lambda x: x["h"]).alias("_other")))
    shared = F.size(F.array_intersect("_sketch", "_other")).cast("bigint")

    # the reference named most often by the hashes goes first; hashes in no reference are the rarest
    placed = (
        distinct.select("_key", F.explode("_sketch").alias("h"))
        .join(seen, "h", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .groupBy("_key")
        .agg(order.alias("_order"), F.mode("_pilot", True).alias("reference_id"))
        .filter(F.col("reference_id").isNotNull())
    )
    placed = cut_lineage(
        placed.join(distinct, "_key")
        .join(sketches, "reference_id")
        .select("_key", "reference_id", "bsize", F.size("_sketch").alias("asize"), shared.alias("hits"), "_order")
    )
    union = F.col("asize") + F.col("bsize") - F.col("hits")
    early = placed.select(
        "_key",
        "asize",
        "hits",
        union.alias("_union"),
        F.col("reference_id").alias("_first"),
        F.posexplode("_order").alias("i", "_x"),
    ).select("*", "_x.h").filter((F.col("_x.df") > 0) & ((F.col("asize") - F.col("i")) * F.col("_union") >= F.col("hits") * F.col("asize")))
    most = F.least(F.col("asize") - F.col("i"), F.col("bsize") - F.col("j"))
    ahead = most * F.col("_union") - F.col("hits") * (F.col("asize") + F.col("bsize") - most)
    open_blocks = early.join(blocks, "h").filter((ahead > 0) | ((ahead == 0) & (F.col("_least") < F.col("_first"))))
    tie = (ahead > 0).alias("_ahead")
    pairs = (
        open_blocks.select("_key", "asize", "_first", "h", "bsize", "j", tie)
        .join(postings, ["h", "bsize", "j"])
        .filter((F.col("reference_id") < F.col("_first")) | (F.col("_ahead") & (F.col("reference_id") != F.col("_first"))))
        .select("_key", "asize", "reference_id", "bsize")
        .distinct()
    )
    others = pairs.join(distinct, "_key").join(sketches.drop("bsize"), "reference_id")
    columns = ["_key", "reference_id", "bsize", "asize"]
    return placed.select(*columns, "hits"), others.select(*columns, shared.alias("hits"))


def screen(
    targets: DataFrame,
    references: DataFrame,
    min_similarity: float,
    options: SketchOptions = SketchOptions(),
) -> DataFrame:
    """Targets with their best match and ``is_contaminant`` (ji above the cutoff).

    Split it with ``contaminants`` and ``clean``. The cutoff has no default,
    because one below 0 sends everything to the contaminants. A target that no
    reference shares a hash with has hits 0, ji 0 and no asize.
    """
    return screen_sketched(targets, sketch_references(references, options), min_similarity, options)


def screen_sketched(
    targets: DataFrame,
    refs: DataFrame,
    min_similarity: float,
    options: SketchOptions = SketchOptions(),
) -> DataFrame:
    """``screen`` against what ``sketch_references`` gave.

    Matches with a hit are written as a narrow table.
    """
    return with_matches(targets, cut_lineage(match_sketches(targets, refs, options).filter("hits > 0")), min_similarity)


def with_matches(targets: DataFrame, found: DataFrame, min_similarity: float) -> DataFrame:
    """``targets`` with the written matches ``found``.

    While these are few, they go to the targets, whose texts then stay where they are.
    """
    if found.count() <= MATCH_ROWS:
        found = F.broadcast(found)
    joined = targets.join(found.withColumnRenamed("target_id", "id"), "id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({
        "hits": F.coalesce("hits", zero),
        "bsize": F.coalesce("bsize", zero),
        "ji": F.coalesce("ji", F.lit(0.0)),
        "is_contaminant": F.coalesce("ji", F.lit(0.0)) > F.lit(min_similarity),
    })


def contaminants(screened: DataFrame) -> DataFrame:
    return screened.filter("is_contaminant")


def clean(screened: DataFrame) -> DataFrame:
    return screened.filter(~F.col("is_contaminant"))
