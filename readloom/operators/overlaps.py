"""Clean-up, annotation and filtering of pairwise read overlaps.

The rules here are this library's own. Coordinates are half-open; b places of a
"-" overlap count along the reverse complement of b.

Annotation works per read. Rows are reduced to one per place on the read before
any window, so a read has at most as many rows as bases, however many overlaps
it takes part in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.operators.intervals import (
    hysteresis,
    longest_interval,
    merge_intervals,
    step_function,
)
from readloom.operators.ordered import AUTO, CHUNK, Running, Width, choose_width, chunk_of, with_preceding
from readloom.session import cut_lineage

PAIR = ["a", "b", "strand"]


def _islands(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], spans: Sequence[tuple[str, str]], distance: int, width: int | None, name: str
) -> DataFrame:
    """Add ``name``: the first row of the island a row belongs to, as a struct of ``order``.

    In ``order``, a row opens an island if one of its ``spans`` (start, end) starts more
    than ``distance`` past the farthest end of all rows before it.
    """
    if width is not None:
        rows = rows.withColumn(CHUNK, chunk_of(order[0], width))
    ends = [Running(f"_reach{i}", "max", F.col(end)) for i, (_, end) in enumerate(spans)]
    reached = with_preceding(rows, ends, keys, order, width)
    opens = F.col("_reach0").isNull()
    for i, (start, _) in enumerate(spans):
        opens = opens | (F.col(start) - F.col(f"_reach{i}") > distance)
    opened = reached.withColumn("_opens", F.when(opens, F.struct(*order)))
    grouped = with_preceding(opened, [Running("_before", "last", F.col("_opens"))], keys, order, width)
    return grouped.withColumn(name, F.coalesce("_opens", "_before")).drop("_opens", "_before", CHUNK, *[r.name for r in ends])


def stitch(overlap: DataFrame, max_distance: int = 40, width: Width = AUTO) -> DataFrame:
    """Join collinear overlaps of one pair and strand that lie within ``max_distance`` on both reads.

    An overlap runs along the diagonals from its start to its end (place on a less
    place on b). Diagonals that touch, or lie within ``max_distance`` of each other,
    are one band, so chains on other diagonals may interleave. Within a band, in order
    of place on a, an overlap opens a new chain if it starts more than ``max_distance``
    past the farthest end of all before it, on a or on b; overlaps inside an earlier one join it.
    Bounds are the outermost, diffs add up.
    """
    per_pair = [*PAIR, "a_len", "b_len", "block"]
    starts, ends = F.col("ab") - F.col("bb"), F.col("ae") - F.col("be")
    distinct = overlap.groupBy(*per_pair, "ab", "ae", "bb", "be").agg(F.sum("diffs").alias("diffs"))
    distinct = distinct.withColumns({"_low": F.least(starts, ends), "_high": F.greatest(starts, ends)})
    order = ["ab", "ae", "bb", "be"]
    width = choose_width(overlap, PAIR, width)
    if width is None:
        banded = _islands(distinct, PAIR, ["_low", "_high", *order], [("_low", "_high")], max_distance, None, "_band")
    else:
        # All overlaps of a hot pair may share a diagonal; one row stands for them.
        diagonals = distinct.groupBy(*PAIR, "_low").agg(F.max("_high").alias("_high"))
        bands = _islands(diagonals, PAIR, ["_low"], [("_low", "_high")], max_distance, width, "_band").drop("_high")
        banded = distinct.join(bands, [*PAIR, "_low"])
    banded = banded.withColumn("_band", F.col("_band._low"))
    chained = _islands(banded, [*PAIR, "_band"], order, [("ab", "ae"), ("bb", "be")], max_distance, width, "_chain")
    return (
        chained.groupBy(*per_pair, "_band", "_chain")
        .agg(
            F.min("ab").alias("ab"), F.max("ae").alias("ae"),
            F.min("bb").alias("bb"), F.max("be").alias("be"),
            F.sum("diffs").alias("diffs"),
        )
        .select(*overlap.columns)
    )


def read_depth(overlap: DataFrame) -> DataFrame:
    """(read_id, b, e, depth): number of overlaps over each stretch of read a."""
    spans = overlap.select(F.col("a").alias("read_id"), F.col("ab").alias("b"), F.col("ae").alias("e"),
                           F.lit(1).cast("bigint").alias("depth"))
    return step_function(spans, ["read_id"], ["depth"])


def repeat_track(
    overlap: DataFrame, coverage: float, high: float = 2.0, low: float = 1.7
) -> DataFrame:
    """Repeat regions: opened at depth >= high x coverage, closed at depth < low x coverage."""
    regions = hysteresis(read_depth(overlap), ["read_id"], "depth", high * coverage, low * coverage)
    return regions.select("read_id", F.lit("repeats").alias("kind"), "b", "e")


def segment_quality(overlap: DataFrame, segment: int = 100) -> DataFrame:
    """(read_id, b, e, diffs, bases): totals of the overlaps covering each stretch.

    b and e count segments. An overlap counts for the segments it covers whole,
    with all its differences and bases.
    """
    spans = overlap.select(
        F.col("a").alias("read_id"),
        F.expr(f"(ab + {int(segment) - 1}) div {int(segment)}").alias("b"),
        F.expr(f"ae div {int(segment)}").alias("e"),
        F.col("diffs").cast("bigint").alias("diffs"),
        (F.col("ae") - F.col("ab")).cast("bigint").alias("bases"),
    ).filter(F.col("e") > F.col("b"))
    return step_function(spans, ["read_id"], ["diffs", "bases"])


def quality_trim(
    overlap: DataFrame,
    segment: int = 100,
    threshold: int = 30,
    min_segments: int = 5,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Trim track: the longest run of good segments, at least ``min_segments`` long.

    A segment is good if the overlaps covering it differ in at most
    ``threshold`` percent of their bases; uncovered segments are not good. The
    earliest run wins ties. With ``previous``, a run ends at the previous trim.
    """
    quality = segment_quality(overlap, segment)
    good = quality.filter(
        (F.col("bases") > 0) & (F.col("diffs") * 100 <= F.col("bases") * F.lit(threshold))
    ).select("read_id", "b", "e")
    runs = merge_intervals(good, ["read_id"])
    if previous is not None:
        inside = previous.select(
            "read_id",
            F.expr(f"(b + {int(segment) - 1}) div {int(segment)}").alias("_pb"),
            F.expr(f"e div {int(segment)}").alias("_pe"),
        )
        runs = runs.join(inside, "read_id").select(
            "read_id", F.greatest("b", "_pb").alias("b"), F.least("e", "_pe").alias("e")
        )
    long_enough = runs.filter(F.col("e") - F.col("b") >= min_segments)
    best = longest_interval(long_enough, ["read_id"])
    return best.select(
        "read_id", F.lit("trim").alias("kind"),
        (F.col("b") * segment).alias("b"), (F.col("e") * segment).alias("e"),
    )


def track_merge(parts: Sequence[DataFrame]) -> DataFrame:
    """One track from per-block parts; a row found in several parts is kept once."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


def track_duplicates(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows found more than once among the parts, with how often."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*whole.columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def missing_blocks(rows: DataFrame, blocks: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(kind, block_id) of the expected ``blocks`` that a track of one of ``kinds`` has no row of.

    ``rows`` holds kind and block_id, as often as there are rows in the parts of the tracks; null
    block ids count for nothing. Each task folds its rows into one bitmap per kind and 32,768
    blocks, so only bitmaps are shuffled, and an expected block looks its bit up in one of them.
    """
    place = [F.bitmap_bucket_number("block_id").alias("_bucket"), F.bitmap_bit_position("block_id").alias("_bit")]
    known = rows.filter(F.col("block_id").isNotNull()).select("kind", *place)
    maps = known.groupBy("kind", "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    wanted = blocks.select("block_id").filter(F.col("block_id").isNotNull()).distinct().select("block_id", *place)
    asked = wanted.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    byte = F.conv(F.hex(F.substring("_map", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.lit(1) == F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(1)
    return asked.join(maps, ["kind", "_bucket"], "left").filter(F.col("_map").isNull() | ~there).select("kind", "block_id")


def track_combine(first: DataFrame, second: DataFrame, kind: str = "combined_repeats") -> DataFrame:
    """Interval union of two tracks per read."""
    both = first.select("read_id", "b", "e").unionByName(second.select("read_id", "b", "e"))
    merged = merge_intervals(both, ["read_id"])
    return merged.select("read_id", F.lit(kind).alias("kind"), "b", "e")


def remove_gaps(overlap: DataFrame, trim: DataFrame, distance: int = 100) -> DataFrame:
    """Keep, per read, the overlaps of its longest covered stretch inside the trim.

    Stretches up to ``distance`` apart count as one. Reads without a trim, and
    overlaps outside it, are dropped. The earliest stretch wins ties.
    """
    bounds = trim.select(F.col("read_id").alias("a"), F.col("b").alias("_tb"), F.col("e").alias("_te"))
    begin, end = F.greatest("ab", "_tb"), F.least("ae", "_te")
    # One row per place on the read is all the stretches need, and all that meets the trim here.
    places = overlap.groupBy("a", "ab").agg(F.max("ae").alias("ae"))
    spans = places.join(bounds, "a").select("a", begin.alias("b"), end.alias("e")).filter("e > b")
    stretch = longest_interval(merge_intervals(spans, ["a"], distance), ["a"])
    kept = stretch.select("a", F.col("b").alias("_sb"), F.col("e").alias("_se")).join(bounds, "a")
    inside = (end > begin) & (begin >= F.col("_sb")) & (end <= F.col("_se"))
    return overlap.join(kept, "a").filter(inside).select(*overlap.columns)


def _shifted(places: Sequence[str], by: Column) -> list[Column]:
    return [(F.col(p) + by).alias(p) for p in places]


def clip_to_trim(overlap: DataFrame, trim: DataFrame) -> DataFrame:
    """Overlaps cut down to the trimmed parts of both reads.

    What is cut from one read is cut from the other, base for base. Reads
    without a trim row lose their overlaps. Adds the trims as _ta_b, _ta_e,
    _tb_b, _tb_e, the latter two along b as the overlap sees it.
    """
    of_a = trim.select(F.col("read_id").alias("a"), F.col("b").alias("_ta_b"), F.col("e").alias("_ta_e"))
    of_b = trim.select(F.col("read_id").alias("b"), F.col("b").alias("_b0"), F.col("e").alias("_e0"))
    forward = F.col("strand") == "+"
    joined = overlap.join(of_a, "a").join(of_b, "b").select(
        *overlap.columns, "_ta_b", "_ta_e",
        F.when(forward, F.col("_b0")).otherwise(F.col("b_len") - F.col("_e0")).alias("_tb_b"),
        F.when(forward, F.col("_e0")).otherwise(F.col("b_len") - F.col("_b0")).alias("_tb_e"),
    )
    head = F.greatest(F.lit(0), F.col("_ta_b") - F.col("ab"), F.col("_tb_b") - F.col("bb"))
    tail = F.greatest(F.lit(0), F.col("ae") - F.col("_ta_e"), F.col("be") - F.col("_tb_e"))
    rest = [c for c in joined.columns if c not in ("ab", "ae", "bb", "be")]
    cut = joined.select(*rest, *_shifted(["ab", "bb"], head), *_shifted(["ae", "be"], -tail))
    return cut.filter((F.col("ae") > F.col("ab")) & (F.col("be") > F.col("bb")))


def filter_overlaps(
    overlap: DataFrame,
    trim: DataFrame,
    repeats: DataFrame,
    min_len: int = 1000,
    min_non_repeat: int = 300,
    max_leftover: int = 0,
    stitch_distance: int | None = 100,
) -> DataFrame:
    """Drop short, repeat-only and dangling overlaps.

    Stitched and clipped to the trims first. Kept overlaps are at least
    ``min_len`` long on a, have ``min_non_repeat`` bases outside a's repeats,
    and reach to within ``max_leftover`` of a trimmed read's end on each side.
    """
    whole = overlap if stitch_distance is None else stitch(overlap, stitch_distance)
    clipped = clip_to_trim(whole, trim)
    left = F.least(F.col("ab") - F.col("_ta_b"), F.col("bb") - F.col("_tb_b"))
    right = F.least(F.col("_ta_e") - F.col("ae"), F.col("_tb_e") - F.col("be"))
    reaching = clipped.filter(
        (F.col("ae") - F.col("ab") >= min_len) & (left <= max_leftover) & (right <= max_leftover)
    )
    inside = covered_bases(reaching.select(F.col("a").alias("read_id"), "ab", "ae"), repeats)
    places = ["a", "ab", "ae"]
    masked = reaching.join(inside.toDF(*places, "_masked"), places)
    return masked.filter(F.col("ae") - F.col("ab") - F.col("_masked") >= min_non_repeat).select(*overlap.columns)


def covered_bases(spans: DataFrame, track: DataFrame, width: Width = AUTO) -> DataFrame:
    """(read_id, start, end, n) of the distinct ``spans`` (read_id and two places): bases of ``track`` inside each.

    The bases that intervals cover before a place are a running sum; a place looks up the
    last interval that begins before it, as of its position in the read. No list
    of a read's intervals is made, so many intervals and many spans take linear time.
    """
    start, end = spans.columns[1:]
    width = choose_width(spans.select("read_id").unionByName(track.select("read_id")), ["read_id"], width)
    merged = merge_intervals(track.select("read_id", "b", "e"), ["read_id"])
    summed = with_preceding(merged, [Running("_sum", "sum", F.col("e") - F.col("b"))], ["read_id"], ["b"], width)
    intervals = summed.select("read_id", F.col("b").alias("_at"), F.struct("b", "e", "_sum").alias("_interval"))
    spans = spans.distinct()
    places = spans.select("read_id", F.explode(F.array(start, end)).alias("_at")).distinct()
    every = intervals.unionByName(places.withColumn("_interval", F.lit(None).cast(intervals.schema["_interval"].dataType)))
    # an interval that begins at a place covers nothing before it, so the order of equals does not matter
    asked = with_preceding(every, [Running("_last", "last", F.col("_interval"))], ["read_id"], ["_at"], width).filter("_interval IS NULL")
    before = F.coalesce(F.col("_last._sum") + F.least(F.col("_at"), F.col("_last.e")) - F.col("_last.b"), F.lit(0))
    # written, as both ends of a span look it up
    known = cut_lineage(asked.select("read_id", "_at", before.cast("bigint").alias("_before")))
    at_start = known.toDF("read_id", start, "_to_start")
    at_end = known.toDF("read_id", end, "_to_end")
    return spans.join(at_start, ["read_id", start]).join(at_end, ["read_id", end]).select(
        "read_id", start, end, (F.col("_to_end") - F.col("_to_start")).alias("n")
    )


def merge_overlaps(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts in (a, b, ab) order; b and ab also split reads with very many overlaps."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.orderBy("a", "b", "ab")


def check_overlaps(overlap: DataFrame, reads: DataFrame) -> DataFrame:
    """(block, bad_order, out_of_bounds, missing_reads): invalid rows of each block that has any."""
    order = (F.col("ab") >= F.col("ae")) | (F.col("bb") >= F.col("be"))
    bounds = (
        (F.col("ab") < 0) | (F.col("bb") < 0)
        | (F.col("ae") > F.col("a_len")) | (F.col("be") > F.col("b_len"))
    )
    rows = overlap.select("block", "a", "b", order.alias("_order"), bounds.alias("_bounds"))
    known = reads.select("read_id").distinct()
    with_a = rows.join(known.select(F.col("read_id").alias("a"), F.lit(True).alias("_has_a")), "a", "left")
    with_b = with_a.join(known.select(F.col("read_id").alias("b"), F.lit(True).alias("_has_b")), "b", "left")
    missing = F.col("_has_a").isNull() | F.col("_has_b").isNull()
    counts = with_b.groupBy("block").agg(
        F.count_if(F.col("_order")).alias("bad_order"),
        F.count_if(F.col("_bounds")).alias("out_of_bounds"),
        F.count_if(missing).alias("missing_reads"),
    )
    return counts.filter((F.col("bad_order") > 0) | (F.col("out_of_bounds") > 0) | (F.col("missing_reads") > 0))


def overlap_stats(overlap: DataFrame) -> DataFrame:
    """Per block: rows, distinct reads, length sum, minimum, maximum and mean, differences."""
    length = F.col("ae") - F.col("ab")
    return overlap.groupBy("block").agg(
        F.count(F.lit(1)).alias("n_overlaps"),
        F.count_distinct("a").alias("n_reads"),
        F.sum(length).alias("sum_len"),
        F.min(length).alias("min_len"),
        F.max(length).alias("max_len"),
        (F.sum(length) / F.count(F.lit(1))).alias("mean_len"),
        F.sum("diffs").alias("diffs"),
    )


def trim_reads(reads: DataFrame, trim: DataFrame, min_length: int = 3000) -> DataFrame:
    """Reads cut to their trim; those shorter than ``min_length`` after it are dropped."""
    long_enough = trim.filter(F.col("e") - F.col("b") >= min_length).select("read_id", "b", "e")
    cut = F.substring("seq", F.col("b") + 1, F.col("e") - F.col("b"))
    return (
        reads.join(long_enough, "read_id")
        .withColumn("seq", cut)
        .withColumn("len", F.octet_length("seq").cast("bigint"))
        .filter(F.col("len") >= min_length)
        .select("read_id", "seq", "len")
    )


def shift_track(track: DataFrame, trim: DataFrame, min_length: int = 3000) -> DataFrame:
    """A track moved onto the reads ``trim_reads`` gives."""
    bounds = trim.filter(F.col("e") - F.col("b") >= min_length).select(
        "read_id", F.col("b").alias("_tb"), F.col("e").alias("_te")
    )
    moved = track.join(bounds, "read_id").select(
        "read_id", "kind",
        (F.greatest("b", "_tb") - F.col("_tb")).alias("b"),
        (F.least("e", "_te") - F.col("_tb")).alias("e"),
    )
    return moved.filter(F.col("e") > F.col("b"))
