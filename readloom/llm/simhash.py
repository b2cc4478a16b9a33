"""SimHash near-duplicates with BK-trees.

Fingerprints of equal texts are folded first. Searching every fingerprint in every
shard's tree would cost the square of their number, so a shard is the set of
fingerprints that agree in two of five bit blocks: fingerprints within three bits
differ in at most three blocks, so every link lies inside a shard, and nothing is
lost. Each shard is a BK-tree, children keyed by their Hamming distance to the
parent; a search follows only the edges that the radius allows. A shard above
``shard`` fingerprints is cut into parts, and each part's tree is sent to every
other part of its shard, so a tree and its queries always have a bounded size.
Out of a shard go the links of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from readloom.llm.common import batches, cut_lineage
from readloom.llm.components import components

RADIUS = 3
#: Fixed values of the fingerprint: words in a shingle, seed of the hash.
SHINGLE, SEED = 3, 42
#: Bit blocks, as (shift, width); any two fingerprints within RADIUS agree in two of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Most fingerprints in a tree.
SHARD = 1024
_SPAN = 1 << 17


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint; null and blank texts give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SPAN):
        pieces = map(whole.__getitem__, map(slice, starts[at : min(at + _SPAN, n)].tolist(), ends[SHINGLE - 1 :][at : at + _SPAN].tolist()))
        hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64, min(_SPAN, n - at))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_id, _fp (long) for every row."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["_id", "_fp"])

        return step

    return batches(rows, make, "_id long, _fp long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            known, children = todo.pop()
            d = (known ^ value).bit_count()
            if d <= radius:
                yield known
            if children:
                todo += [children[e] for e in range(max(d - radius, 0), d + radius + 1) if e in children]


def _forest(trees: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among ``trees``, or between ``queries`` and ``trees``."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, out = BKTree(), []

    def join(value: int) -> None:
        for other in tree.within(value, radius):
            a, b = top(value), top(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((value, other))

    for value in trees:
        if queries is None:
            join(value)
        tree.add(value)
    for value in queries or ():
        join(value)
    return out


def _search(rows: DataFrame, radius: int) -> DataFrame:
    """Links inside the shards of _key, _left, _right, _query, _fp; rows of a shard are adjacent."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(block: list[np.ndarray]) -> pa.RecordBatch | None:
            key, left, right, query, fp = block
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0)) + 1
            out = []
            begin = np.concatenate(([0], cut))
            end = np.concatenate((cut, [len(key)]))
            for s, e in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
                values, asks = fp[s:e].view(np.uint64), query[s:e]
                if left[s] == right[s]:
                    out += _forest(values.tolist(), None, radius)
                else:
                    out += _forest(values[~asks].tolist(), values[asks].tolist(), radius)
            if not out:
                return None
            pairs = np.array(out, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in source:
            block = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                block = [np.concatenate((a, b)) for a, b in zip(held, block, strict=True)]
            if not len(block[0]):
                continue
            key, left, right = block[:3]
            same = (key == key[-1]) & (left == left[-1]) & (right == right[-1])
            at = len(key) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [x[at:] for x in block]
            if at and (found := links([x[:at] for x in block])) is not None:
                yield found
        if held is not None and (found := links(held)) is not None:
            yield found

    return rows.mapInArrow(run, "a long, b long")


def link_forest(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """a, b: links among the distinct fingerprints _fp, enough to connect all that are connected."""
    if radius > RADIUS:
        raise ValueError(f"the bit blocks find links of at most {RADIUS} bits")
    keys = []
    for n, (x, y) in enumerate(combinations(BLOCKS, 2)):
        part = lambda block: F.shiftrightunsigned("_fp", block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))
        keys.append(F.shiftleft(F.lit(n).cast("long"), 26) + F.shiftleft(part(x), 13) + part(y))
    keyed = prints.select("_fp", F.explode(F.array(*keys)).alias("_key"))
    sizes = cut_lineage(keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1"))
    keyed = keyed.join(sizes, "_key").withColumn("_parts", F.ceil(F.col("_n") / shard)).withColumn("_part", F.pmod(F.xxhash64("_fp"), F.col("_parts")))
    # a part meets itself once and each other part once, as the tree of the lower number
    ways = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1),
        lambda other: F.struct(F.least("_part", other).alias("_left"), F.greatest("_part", other).alias("_right"), (other < F.col("_part")).alias("_query")),
    )
    rows = keyed.select("_key", "_fp", F.explode(ways).alias("_way")).select("_key", "_way.*", "_fp")
    return _search(rows.repartition("_key", "_left", "_right").sortWithinPartitions("_key", "_left", "_right", "_fp"), radius)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, one row per row of ``docs``.

    component_id is the smallest id that links of at most ``radius`` differing bits
    reach. Null and blank texts have fingerprint zero and are linked like any other.
    Null ids reach others but never name a component. Repeated rows are repeated.
    """
    prints = cut_lineage(fingerprints(docs, text, doc_id))
    distinct = cut_lineage(prints.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = components(link_forest(distinct.select("_fp"), radius, shard))
    rooted = distinct.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    names = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    of_print = cut_lineage(rooted.join(names, "root").select("_fp", "component_id"))
    return prints.join(of_print, "_fp").select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group that links connect, one document stays, the smallest.

    A document is an id with a text; documents are ordered by id, null ids last, then by a hash of the text. So
    an id that repeats with different texts loses only those that have a smaller near copy, and of near copies
    under one id one stays. Rows equal in id and text share their fate; exact deduplication drops such copies. Null and blank texts
    are one group. An empty table stays empty. All columns stay, whatever their names.
    """
    key = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text"))
    rows = docs.select(key.alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["_key", "_fp"])

        return step

    prints = cut_lineage(batches(rows, make, "_key struct<none: boolean, id: long, text: long>, _fp long"))
    roots = components(link_forest(prints.select("_fp").distinct(), radius, shard)).toDF("_fp", "_root")
    grouped = prints.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    stays = grouped.groupBy("_root").agg(F.min("_key").alias("_stays"))
    gone = cut_lineage(grouped.join(stays, "_root").where("_key <> _stays").select(F.col("_key").alias("_gone")).distinct())
    return docs.join(gone, key.eqNullSafe(F.col("_gone")), "left_anti")
