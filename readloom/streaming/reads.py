"""Selection and screening of arriving reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from readloom.operators.select import longest_n
from readloom.operators.sketch import SketchOptions, clean, contaminants, match_sketches, sketch_references, with_matches
from readloom.session import cut_lineage, drop_table, scratch_path
from readloom.sources.tables import spread
from readloom.streaming.versions import read_version, start_batches, write_version


def stream_longest(
    reads: DataFrame, n: int, state_dir: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Keep the n longest reads (id, len, ...) seen so far; the newest version is the answer."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = batch
        if batch_id > 0:
            known = batch.unionByName(read_version(batch.sparkSession, state_dir, batch_id - 1))
        write_version(longest_n(known, n), state_dir, batch_id)

    return start_batches(reads, handle, checkpoint, once)


def stream_screen(
    targets: DataFrame,
    references: DataFrame,
    min_similarity: float,
    contaminant_dir: str,
    clean_dir: str,
    checkpoint: str,
    options: SketchOptions = SketchOptions(),
    once: bool = True,
) -> StreamingQuery:
    """Screen arriving reads (id, seq) against a static reference set, into two sinks.

    The references are sketched once, when the query starts.
    """
    refs = sketch_references(references, options)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # only the narrow matches are kept; the texts are read again for each sink
        path = scratch_path(batch.sparkSession)
        found = cut_lineage(match_sketches(spread(batch.select("id", "seq"), "id"), refs, options).filter("hits > 0"), path)
        screened = with_matches(batch, found, min_similarity)
        write_version(contaminants(screened), contaminant_dir, batch_id)
        write_version(clean(screened), clean_dir, batch_id)
        drop_table(batch.sparkSession, path)

    return start_batches(targets, handle, checkpoint, once)
