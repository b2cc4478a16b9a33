"""Similarity join of documents on their sets of word shingles, by rare-first prefixes.

Shingles are ordered by how often they occur, rare ones first; how often is read from a table of
counters of fixed size, which orders all shingles alike in every task. Two sets of similarity
``LEAST`` share a shingle among the first tenth of each (the prefix), so only prefixes are
joined. Where two meet, their sizes (length filter), the places of the shared shingle in
both (positional filter) and counts of their shingles by ranges of hashes (suffix
filter, over all of a set and not only what follows) bound the similarity from above. Pairs that are left are
compared on their whole sets, each once.

Equal sets are folded first: a class of copies is one node. A shingle that very many
prefixes share does not pair them all. Each shingle has a hub, the set that holds it
earliest, and all others are compared with the hub alone; only sets that are not connected by then
meet in blocks of bounded size, and there only with sets of other components. Components come out whole:
what is skipped is a link inside a component that is already connected.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from readloom.llm.bits import Bits, bits_of
from readloom.llm.common import cut_lineage
from readloom.llm.components import components
from readloom.llm.grams import Block

#: Fixed values of the contract: words of a shingle, per cent of the union that the intersection holds at least.
WORDS, LEAST = 3, 90
#: Bytes of text hashed together, in arrays of some 100 times that size; a longer text is hashed alone.
BYTES = 1 << 17
#: Rows of a batch that are Python objects, or a batch of results, at a time.
ROWS = 256
#: Counters that order the shingles, a power of two, and the parts in which they are added up.
SLOTS, SLOT_PARTS = 1 << 20, 64
#: Ranges of hashes of the suffix filter, at least and at most; between, about one for each ``RANGE`` shingles.
RANGES, MOST_RANGES, RANGE = 16, 4096, 32
#: Sets of a shingle that are compared in one task, on average.
BLOCK = 1024
#: Keys of rows up to this many go to every task; beyond, a table of bits finds the rows.
BROADCAST_KEYS = 200_000

_KIND = bytes(1 if c == 32 or 9 <= c <= 13 else 0 for c in range(256))
_NODE = "struct<high: long, low: long>"


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; fewer words are one shingle, none give no shingle."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < BYTES:
            size += len(texts[end] or b"")
            end += 1
        block = Block([t or b"" for t in texts[at:end]], _KIND)
        counts = np.bincount(block.doc, minlength=end - at)
        begins = np.cumsum(counts) - counts
        first, found = block.runs(words)
        cuts = np.searchsorted(first, np.append(begins, len(block.starts))).tolist()
        short = np.flatnonzero((counts > 0) & (counts < words))
        whole = dict(zip(short.tolist(), block.prints(begins[short], counts[short]), strict=True))
        for i in range(end - at):
            own = np.sort(found[cuts[i] : cuts[i + 1]])
            yield np.array([whole[i]], np.uint64) if i in whole else own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own
        at = end


def node_of(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two longs."""
    high, low = np.frombuffer(xxh3_128_digest(found.tobytes()), np.int64)
    return int(high), int(low)


def slot_of(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(SLOTS - 1)).astype(np.int64)


def ranges_of(found: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of equal ranges, up to 255; larger sets have more ranges, so chance evens out no less in them."""
    ranges = min(max(RANGES, 1 << (len(found) // RANGE).bit_length()), MOST_RANGES)
    counts = np.bincount((found >> np.uint64(65 - ranges.bit_length())).astype(np.int64), minlength=ranges)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``ROWS`` rows, without a copy."""
    return (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def _nodes(pairs: list[tuple[int, int]]) -> pa.Array:
    high, low = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.StructArray.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["high", "low"])


def _signed(rows: DataFrame, words: int) -> DataFrame:
    """_id, _n, _node, _ranges per row of (_id, _text); and per task a row with the counters of its shingles.

    _ranges counts the shingles by range of their hashes.
    """

    names = ["_id", "_n", "_node", "_ranges", "_counts"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in (part for whole in source for part in _slices(whole)):
            sizes, nodes, ranges = [], [], []
            for found in shingle_sets(batch.column(1).to_pylist(), words):
                ranges.append(ranges_of(found))
                total[slot_of(found)] += 1  # once where two shingles of a text share a counter: the order stays one order
                sizes.append(len(found))
                nodes.append(node_of(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _nodes(nodes), pa.array(ranges, pa.binary()), pa.nulls(len(sizes), pa.binary())], names)
        if total.any():
            blob = zlib.compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), _nodes([(0, 0)]), pa.nulls(1, pa.binary()), pa.array([blob], pa.binary())], names)

    return cut_lineage(rows.mapInArrow(run, f"_id long, _n long, _node {_NODE}, _ranges binary, _counts binary"))


def _order(signed: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: ``SLOTS`` numbers, whatever the input."""
    each = SLOTS // SLOT_PARTS

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in source:
            for blob in batch.column(0):
                total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint16)
        if total.any():
            parts = [total[at : at + each].tobytes() for at in range(0, SLOTS, each)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["_part", "_counts"])

    def total(part: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(x, np.int64) for x in part["_counts"])
        return pd.DataFrame({"_part": part["_part"][:1], "_counts": [whole.tobytes()]})

    parts = signed.where("_counts IS NOT NULL").select("_counts").mapInArrow(add, "_part int, _counts binary")
    out = np.zeros(SLOTS, np.uint32)
    for row in parts.groupBy("_part").applyInPandas(total, "_part int, _counts binary").collect():
        out[row["_part"] * each :][:each] = np.minimum(np.frombuffer(row["_counts"], np.int64), 1 << 31)
    return out


def _chosen(batch: pa.RecordBatch, keys: Bits) -> list[bytes | None]:
    """The texts of a batch (_text, _key) whose key may be in the table."""
    return batch.column(0).filter(pa.array(keys.has(batch.column(1).to_numpy().view(np.uint64)))).to_pylist()


def _prefix(found: np.ndarray, order: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``found``, rare shingles first, and how many of them are the prefix."""
    # found is sorted, so equal counters leave the order of the hashes
    by = np.argsort(order[slot_of(found)], kind="stable")
    return by, len(found) - -(-least * len(found) // 100) + 1


def _prefixes(rows: DataFrame, reps, order, words: int, least: int) -> DataFrame:
    """_token, _node, _n, _pos: the prefixes of all sets, each of a row that speaks for its copies."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in source for part in _slices(whole)):
            tokens, names, counts = [np.empty(0, np.uint64)], [], []
            for found in shingle_sets(_chosen(batch, reps.value), words):
                if len(found):
                    by, n = _prefix(found, order.value, least)
                    tokens.append(found[by[:n]])
                    names.append((*node_of(found), len(found)))
                    counts.append(n)
            high, low, n = np.repeat(np.array(names, np.int64).reshape(-1, 3), counts, axis=0).T
            place = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.int64)
            node = pa.StructArray.from_arrays([pa.array(high), pa.array(low)], ["high", "low"])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), node, pa.array(n), pa.array(place)], ["_token", "_node", "_n", "_pos"])

    return rows.select("_text", "_key").mapInArrow(run, f"_token long, _node {_NODE}, _n long, _pos long")


def _shared(prefixes: DataFrame, least: int) -> DataFrame:
    """The entries of the prefixes whose shingle another set of similar size may share, and whether more than two may (_many).

    Tables of bits keep the others out of the shuffles. Classes of sizes are so wide that sets which can link are in one or in
    neighbouring ones; a shingle whose sets are in as many classes, no two of them neighbours, links none.
    """
    wide = max(math.log(100 / least) * 1.01, 1e-9)
    size = F.floor(F.log("_n") / wide) % 64
    some = prefixes.select("_token", F.col("_node.low").alias("_low"), size.cast("int").alias("_size"))
    some = some.withColumn("_size", F.expr("shiftleft(1L, _size)"))
    each = some.groupBy("_token").agg(F.min("_low").alias("_a"), F.max("_low").alias("_b"), F.bit_or("_size").alias("_sizes"), F.count("*").alias("_sets")).where("_a < _b")
    apart = "bit_count(_sizes) = _sets AND (_sizes & (shiftleft(_sizes, 1) | shiftrightunsigned(_sizes, 63))) = 0"
    twice = cut_lineage(each.where(f"NOT ({apart})").select("_token", "_sets"))
    many = twice.where("_sets > 2")
    context = prefixes.sparkSession.sparkContext
    bits = context.broadcast([bits_of(x, "_token", x.count(), 32) for x in (twice, many)])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = batch.column(0).to_numpy().view(np.uint64)
            more = pa.array(bits.value[1].has(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, more], [*batch.schema.names, "_many"]).filter(pa.array(bits.value[0].has(found)))

    return cut_lineage(prefixes.mapInArrow(run, f"_token long, _node {_NODE}, _n long, _pos long, _many boolean"))


def may_link(n, pos, ranges, m, at, others, least: int) -> np.ndarray:
    """Whether sets of sizes n and m that share a shingle at pos and at, and none before, can reach the similarity.

    ``ranges`` and ``others`` count their shingles by range of hashes: where the counts differ, so do the sets.
    """
    need = -(-least * (n + m) // (100 + least))
    size = (100 * np.minimum(n, m) >= least * np.maximum(n, m)) & (np.minimum(n - pos, m - at) >= need)
    apart = np.abs(ranges.astype(np.int64) - others.astype(np.int64)).sum(axis=-1)
    return size & (n + m - np.maximum(apart, pos + at) >= 2 * need)


def _counts_of(column: list[bytes], ranges: int) -> np.ndarray:
    """The counts of :func:`ranges_of`, those of neighbouring ranges added up until ``ranges`` are left."""
    counts = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), ranges, -1)
    # cut at 255 once more, so that counts that were cut before and those that were not stay comparable
    return np.minimum(counts.sum(axis=-1, dtype=np.int64), 255)


def ranges_allow(n, ranges: list[bytes], m, others: list[bytes], least: int) -> np.ndarray:
    """:func:`may_link` of sets with these counts by range, by what the counts alone say."""
    good = np.zeros(len(n), bool)
    widths = np.array([(len(x), len(y)) for x, y in zip(ranges, others, strict=True)]).reshape(-1, 2)
    for pair in np.unique(widths, axis=0):
        at, fewer = np.flatnonzero((widths == pair).all(axis=1)), int(pair.min())
        good[at] = may_link(n[at], 0, _counts_of([ranges[i] for i in at], fewer), m[at], 0, _counts_of([others[i] for i in at], fewer), least)
    return good


def _pairs(met: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """a, b, each pair once: of the pairs (_node, _n, _pos and the same in _other) those that pass the filters."""
    n, m, pos, at = F.col("_n"), F.col("_other._n"), F.col("_pos"), F.col("_other._pos")
    size = (100 * F.least(n, m) >= least * F.greatest(n, m)) & ((100 + least) * F.least(n - pos, m - at) >= least * (n + m))
    ends = met.where(size).select(F.least("_node", "_other._node").alias("a"), F.greatest("_node", "_other._node").alias("b")).distinct()
    own = sets.select("_node", "_size", "_ranges")
    near = ends.join(own.toDF("a", "_n", "_ranges"), "a").join(own.toDF("b", "_m", "_others"), "b")

    def suffix(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                good = ranges_allow(batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_numpy(), batch.column(5).to_pylist(), least)
                kept = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return near.select("a", "b", "_n", "_ranges", "_m", "_others").mapInArrow(suffix, f"a {_NODE}, b {_NODE}")


def _hub_pairs(entries: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Every set with the hub of each of its shingles: the set that holds it earliest, as it has the fewest shingles of its own."""
    hub = F.min(F.struct("_pos", "_n", "_node")).alias("_other")
    hubs = entries.groupBy("_token").agg(hub, F.count("*").alias("_sets")).where("_sets > 1").drop("_sets")
    return _pairs(entries.join(hubs, "_token").where("_node <> _other._node"), sets, least)


def _block_pairs(entries: DataFrame, sets: DataFrame, least: int, block: int) -> DataFrame:
    """Sets of different components (_root) that share a shingle with others.

    The sets of a shingle are cut into parts of about ``block``, and each part meets each other one and itself in a
    partition of its own.
    """
    crowd = entries.groupBy("_token").agg(F.min("_root").alias("_least"), F.max("_root").alias("_most"), F.count("*").alias("_sets"))
    crowd = cut_lineage(crowd.where("_least < _most AND _sets > 2").select("_token", F.ceil(F.col("_sets") / block).alias("_parts")))
    own = F.pmod(F.xxhash64("_node"), F.col("_parts"))
    ways = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1),
        lambda other: F.struct(F.least(own, other).alias("_left"), F.greatest(own, other).alias("_right"), (other < own).alias("_asks")),
    )
    keys = ["_token", "_left", "_right"]
    rows = entries.join(crowd, "_token").select("*", F.explode(ways).alias("_way")).select("_token", "_node", "_root", "_n", "_pos", "_way.*")
    others = rows.select(*keys, "_asks", F.struct("_node", "_root", "_n", "_pos").alias("_other")).where("NOT _asks").drop("_asks")
    once = F.col("_asks") | ((F.col("_left") == F.col("_right")) & (F.col("_node") > F.col("_other._node")))
    met = rows.join(others, keys).where(once & (F.col("_root") != F.col("_other._root")))
    return _pairs(met, sets, least)


def _key(doc_id: str) -> Column:
    """A long for an id, null ones included."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def _sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """_node, _set of the wanted sets (_node, _key of a row that has it), gathered from the texts, and of few others that tables of bits let through.

    A set comes again where several rows that speak for it are read in different batches.
    """
    context, n = rows.sparkSession.sparkContext, wanted.count()
    owners = context.broadcast(bits_of(wanted, "_key", n, 16))
    if n <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(wanted.select("_key").distinct()), "_key", "left_semi")
    some = context.broadcast(bits_of(wanted.select(F.col("_node.low").alias("_low")), "_low", n, 16))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            seen = set()
            for batch in _slices(whole):
                sets = {}
                for found in shingle_sets(_chosen(batch, owners.value), words):
                    node = node_of(found)
                    if node not in seen and some.value.has(np.array([node[1]]).view(np.uint64))[0]:
                        seen.add(node)
                        sets[node] = found.view(np.int64)
                if sets:
                    yield pa.RecordBatch.from_arrays([_nodes(list(sets)), pa.array(list(sets.values()), pa.list_(pa.int64()))], ["_node", "_set"])

    return rows.select("_text", "_key").mapInArrow(run, f"_node {_NODE}, _set array<long>")


def _verified(rows: DataFrame, known: DataFrame, pairs: DataFrame, words: int, least: int) -> DataFrame:
    """The pairs (a, b, each once) whose sets are similar enough."""
    wanted = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct().join(known.select("_node", _key("_least").alias("_key")), "_node"))
    # written as read, so that making them one row a set and the join are one shuffle
    sets = cut_lineage(_sets(rows, wanted, words)).groupBy("_node").agg(F.first("_set").alias("_set"))
    both = pairs.join(sets.toDF("b", "_of_b"), "b").join(sets.toDF("a", "_of_a"), "a")
    common = F.size(F.array_intersect("_of_a", "_of_b"))
    return cut_lineage(both.withColumn("_common", common).where(100 * F.col("_common") >= least * (F.size("_of_a") + F.size("_of_b") - F.col("_common"))).select("a", "b"))


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Two documents are linked when 100 times the size of the intersection of their sets of shingles is at least
    ``least`` times that of the union; component_id is the smallest id that links reach. Sets are
    compared by 64-bit hashes of their shingles and named by 128-bit ones. Null, empty and blank texts have
    an empty set and are linked with nothing, not with each other. Repeated rows and equal texts have equal
    sets, so they are linked. Null ids link others but never name a component; one that only null ids
    reach has a null component_id. An empty table gives no rows. Other columns take no part, whatever their names.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("_text"))
    rows = own.select("_text", _key("_id").alias("_key"))
    context = docs.sparkSession.sparkContext
    signed = _signed(own, words)
    order = context.broadcast(_order(signed))
    signed = signed.where("_n IS NOT NULL").drop("_counts")
    # one row of each class of copies speaks for it, found by its id
    sets = cut_lineage(signed.where("_n > 0").groupBy("_node").agg(F.min("_id").alias("_least"), F.max("_ranges").alias("_ranges"), F.max("_n").alias("_size")))
    reps = context.broadcast(bits_of(sets.select(_key("_least").alias("_key")), "_key", sets.count(), 16))
    entries = _shared(cut_lineage(_prefixes(rows, reps, order, words, least)), least)
    tried = cut_lineage(_hub_pairs(entries, sets, least))
    links = _verified(rows, sets, tried, words, least)
    roots = cut_lineage(components(links).toDF("_node", "_root"))
    # a shingle of two sets has paired them already
    placed = entries.where("_many").drop("_many").join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    rest = cut_lineage(_block_pairs(placed, sets, least, block).join(tried, ["a", "b"], "left_anti"))
    more = _verified(rows, sets, rest, words, least) if not rest.isEmpty() else rest
    if not more.isEmpty():
        # between components only, so few
        of = roots.toDF("_node", "_root")
        ends = more.join(of.toDF("a", "_a"), "a", "left").join(of.toDF("b", "_b"), "b", "left")
        tops = cut_lineage(components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))).toDF("_root", "_top"))
        # a set that had no link so far is its own component
        known = sets.join(roots, "_node", "left").select("_node", F.coalesce("_root", "_node").alias("_root"))
        roots = known.join(tops, "_root", "left").select("_node", F.coalesce("_top", "_root").alias("_root"))
    rooted = sets.join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    names = rooted.groupBy("_root").agg(F.min("_least").alias("_name"))
    of_set = cut_lineage(rooted.join(names, "_root").select("_node", "_name"))
    named = signed.join(of_set, "_node", "left")
    component = F.when(F.col("_n") > 0, F.col("_name")).otherwise(F.col("_id"))
    return named.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), component.alias("component_id"))
