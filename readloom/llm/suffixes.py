"""Repeated passages by sparse suffix arrays.

A suffix is kept only where a text's minimisers are: in every window of ``least``
words the seed (``seed`` words in a row) with the smallest hash, the leftmost on ties.
Equal windows choose the same position, so two texts that share ``least`` words in a
row keep a suffix at the same place of it. Suffixes are gathered by their seed; seeds
in one document only are dropped. For the others, the window is moved left word by
word over all places at which this seed is its minimiser; for each such start the
suffixes are sorted and equal neighbours are found, by the hash of ``least`` words.
So each window of a text is compared once, and the union of its repeated windows is
its matches extended to the left and right as far as they go: the result is that of
comparing all windows of all texts, without listing those whose seed is unique.

Of all words about one in ``(least - seed + 2) / 2`` becomes a suffix. The suffixes of a
seed with more than ``hot`` of them are cut into parts of about that many. Each part names
its different windows once, with the least and greatest id that hold them; these summaries
are merged by window, and the parts get back which of their windows are repeated. So the
rows that move are those of a part's different windows, however many copies it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from readloom.llm.common import batches, cut_lineage

LEAST, SEED = 50, 8
#: Suffixes of a seed that are compared together, on average, once it has more.
HOT = 4_096
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows of a text that are handled at a time.
_SPAN = 1 << 16


def _rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` words, mixed; no terms but its own enter a window's hash."""
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        out *= _BASE
        out += hashes[i : len(hashes) - width + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def windows(text: str | None, least: int = LEAST, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a text: number of the first window, and per window its minimiser's
    position, the seed's hash there, and the hashes of the piece's words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if len(words) < least:
        return
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    for at in range(0, len(words) - least + 1, _SPAN):
        part = hashes[at : at + _SPAN + least - 1]
        seeds = _rolling(part, seed)
        width = least - seed + 1
        first = np.lib.stride_tricks.sliding_window_view(seeds, width).argmin(axis=1) + np.arange(len(part) - least + 1)
        yield at, first + at, seeds[first], part


def _suffixes(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """_key (seed hash), _id, _doc (hash of the text), _at (word position): the kept suffixes."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, rows, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n, text in enumerate(batch.column(1)):
                last = -1
                for _, first, key, _ in windows(text.as_py(), least, seed):
                    new = np.flatnonzero(np.diff(first, prepend=last))  # a minimiser stays for a run of windows
                    last = first[-1]
                    keys.append(key[new])
                    rows.append(np.full(len(new), n))
                    places.append(first[new])
            row = pa.array(np.concatenate(rows))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(row), batch.column(2).take(row), pa.array(np.concatenate(places))], ["_key", "_id", "_doc", "_at"])

        return step

    return batches(docs.select("_id", "_text", "_doc"), make, "_key long, _id long, _doc long, _at long")


def _compared(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """_key, _parts, _id, _from (first window), _hashes of its windows, per wanted suffix of ``docs`` (with _places)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, parts, rows, starts, found = [], [], [], [], []
            for n, (text, places) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                wanted = {(p["_at"], p["_key"]): p["_parts"] for p in places}  # an id may repeat with other texts
                for at, first, key, part in windows(text.as_py(), least, seed):
                    cut = np.flatnonzero(np.diff(first, prepend=-1))
                    seeds = zip(first[cut].tolist(), key[cut].view(np.int64).tolist(), strict=True)
                    chosen = [(s, e, *own) for s, e, own in zip(cut.tolist(), [*cut[1:].tolist(), len(first)], seeds, strict=True) if own in wanted]
                    if not chosen:
                        continue
                    hashes = _rolling(part, least).view(np.int64)
                    for s, e, place, own in chosen:
                        keys.append(own)
                        parts.append(wanted[place, own])
                        rows.append(n)
                        starts.append(at + s)
                        found.append(hashes[s:e])
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), lists], ["_key", "_parts", "_id", "_from", "_hashes"])

        return step

    return batches(docs, make, "_key long, _parts long, _id long, _from long, _hashes array<long>")


def _together(source: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables in which every value of the first column has all its rows, which are adjacent."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column(0).to_numpy()
        ready = int(np.searchsorted(key, key[-1]))
        if ready or held[0].column(0)[0].as_py() != key[-1]:
            table = pa.Table.from_batches([*held[:-1], batch.slice(0, ready)])
            held = [batch.slice(ready)]
            if table.num_rows:
                yield table
    if held:
        yield pa.Table.from_batches(held)


def _spread(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window: the row of its suffix, its place among that row's, and its hash."""
    lists = table.column("_hashes").combine_chunks()
    begins = lists.offsets.to_numpy()
    sizes = np.diff(begins)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(begins[:-1] - begins[0], sizes), lists.flatten().to_numpy()


#: Rows of :func:`_neighbours`: suffix of a whole seed, suffix of a seed that is cut, repeated window of a part.
_WHOLE, _CUT, _MARK = 0, 1, 2


def _neighbours(rows: DataFrame) -> DataFrame:
    """_id, _from, _to, _first (least id that has one of these windows): runs of repeated windows.

    ``rows`` holds _part, _kind, _id, _from, _hashes; rows of a part are adjacent and come
    together. A whole seed's windows are sorted and compared with their neighbours. A
    part of a cut seed is told its repeated windows by marks, whose _id is the least holder.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(source):
            owner, step, hashes = _spread(table)
            own = table.column("_id").to_numpy()
            ids, kind = own[owner], table.column("_kind").to_numpy()[owner]
            first, keep = np.empty(len(hashes), np.int64), np.zeros(len(hashes), bool)
            whole, cut, mark = (np.flatnonzero(kind == k) for k in (_WHOLE, _CUT, _MARK))
            if len(whole):
                order = whole[np.lexsort((ids[whole], hashes[whole]))]
                h, i = hashes[order], ids[order]
                head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                size = np.diff(np.append(head, len(h)))
                least, most = i[head], i[np.append(head[1:], len(h)) - 1]
                first[order], keep[order] = np.repeat(least, size), np.repeat(least != most, size)
            if len(cut) and len(mark):
                mark = mark[np.argsort(hashes[mark])]
                at = mark[np.minimum(np.searchsorted(hashes[mark], hashes[cut]), len(mark) - 1)]
                first[cut], keep[cut] = ids[at], hashes[at] == hashes[cut]
            if not keep.any():
                continue
            place, row, first = (table.column("_from").to_numpy()[owner] + step)[keep], owner[keep], first[keep]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))))
            found = own[row[new]], place[new], place[np.append(new[1:], len(place)) - 1], np.minimum.reduceat(first, new)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["_id", "_from", "_to", "_first"])

    return rows.mapInArrow(run, "_id long, _from long, _to long, _first long")


def _summaries(rows: DataFrame) -> DataFrame:
    """_part, _window, _low, _high: each part's different windows, and the ids that bound their holders.

    Rows of a part are adjacent in ``rows`` and come together.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(source):
            owner, _, hashes = _spread(table)
            ids, parts = table.column("_id").to_numpy()[owner], table.column("_part").to_numpy()[owner]
            order = np.lexsort((ids, hashes, parts))
            p, h, i = parts[order], hashes[order], ids[order]
            head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (p[1:] != p[:-1]))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p[head], h[head], i[head], i[np.append(head[1:], len(h)) - 1])], ["_part", "_window", "_low", "_high"])

    return rows.mapInArrow(run, "_part long, _window long, _low long, _high long")


def _marks(rows: DataFrame) -> DataFrame:
    """_part, _window, _first: the windows of each part that two different ids hold in any part."""
    sums = cut_lineage(_summaries(rows.repartition("_part").sortWithinPartitions("_part")))
    twice = sums.groupBy("_window").agg(F.min("_low").alias("_first"), F.max("_high").alias("_last")).where("_first < _last")
    return sums.select("_part", "_window").join(twice, "_window").select("_part", "_window", "_first")


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, start_word, end_word, n_words, first_doc_id: passages that other documents hold as well.

    A passage is a longest run of words each of which lies in ``least`` words in a row
    that another document holds, too; documents without one have no row. Words are what ASCII white space
    separates, compared as they are. first_doc_id is the smallest id that holds a window
    of the passage; the passage is the first of its kind where that is its own id. Null
    texts and ids, and texts of fewer words, take no part; rows that share an id, with equal or
    other texts, count as one document, whose places add up. An empty table gives no
    row. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).where("_id IS NOT NULL AND _text IS NOT NULL")
    rows = rows.withColumn("_doc", F.xxhash64("_text"))
    kept = cut_lineage(_suffixes(rows, least, seed))
    seeds = kept.groupBy("_key").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.count("*").alias("_n"))
    seeds = cut_lineage(seeds.where("_low < _high").select("_key", F.ceil(F.col("_n") / hot).alias("_parts")))
    # the places of one text: an id with many texts has as many lists
    wanted = kept.join(seeds, "_key").groupBy("_id", "_doc").agg(F.collect_set(F.struct("_at", "_key", "_parts")).alias("_places"))
    compared = cut_lineage(_compared(rows.join(wanted, ["_id", "_doc"]).select("_id", "_text", "_places"), least, seed))
    part = F.when(F.col("_parts") == 1, F.col("_key")).otherwise(F.xxhash64("_key", F.pmod(F.xxhash64("_id", "_from"), F.col("_parts"))))
    kind = F.when(F.col("_parts") == 1, _WHOLE).otherwise(_CUT)
    suffixes = compared.select(part.alias("_part"), kind.alias("_kind"), "_id", "_from", "_hashes")
    marks = _marks(suffixes.where(F.col("_kind") == _CUT))
    marks = marks.select("_part", F.lit(_MARK).alias("_kind"), F.col("_first").alias("_id"), F.lit(0).cast("long").alias("_from"), F.array("_window").alias("_hashes"))
    runs = _neighbours(suffixes.unionByName(marks).repartition("_part").sortWithinPartitions("_part"))
    # runs that begin at one place end up together, so an id has no more rows here than its longest text has words
    runs = runs.groupBy("_id", "_from").agg(F.max("_to").alias("_to"), F.min("_first").alias("_first"))
    by_start = Window.partitionBy("_id").orderBy("_from")
    reach = F.max("_to").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.withColumn("_new", F.coalesce((F.col("_from") > reach + least).cast("int"), F.lit(1)))
    groups = begun.withColumn("_group", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = groups.groupBy("_id", "_group").agg(F.min("_from").alias("start_word"), (F.max("_to") + least).alias("end_word"), F.min("_first").alias("first_doc_id"))
    return spans.select(F.col("_id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")
