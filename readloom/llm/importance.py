"""Importance resampling towards a target distribution, on hashed n-gram features.

Every run of one to three words is a feature; its bucket is the CRC-32 of its bytes
modulo ``BUCKETS``. The gain of a bucket is the log of how much more likely the target
is to show it than the documents are; a document's weight is the sum of its features'
gains, and the Gumbel-max trick turns weights into a draw without replacement.

Almost all features are made of a few words. One pass over all documents finds the
frequent words and pairs: a word or pair of a share above 1 / ``HEAD`` of all reaches
that share in some block of texts, so every block reports only those. At most ``HEAD``
words and ``PAIRS`` pairs are kept and broadcast: the exact CRC states of a word alone
and after a space, and the buckets of the pairs with the states to go on from. A word of the
head extends the state of what stands before it by table look-ups (CRCs are linear);
a word of the tail is read byte by byte. Head or tail, the CRC is the same, so the
bucket totals are exact and do not depend on what the head holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import cut_lineage
from readloom.llm.grams import Block

#: Fixed values of the contract: buckets, words in a feature, seed of the draw, fewest words of a drawn document.
BUCKETS, WORDS, SEED, LEAST_WORDS = 10_000, 3, 42, 20
#: Of every 100 documents with enough words, this many are drawn.
PERCENT = 5
#: Most words and pairs in the broadcast vocabulary, longest word in it, slots of its table of pairs.
HEAD, PAIRS, HEAD_BYTES, SLOTS = 1 << 15, 1 << 15, 31, 1 << 17
#: Slots of its table of words; bytes of text handled together.
WORD_SLOTS, CHUNK = 1 << 18, 1 << 20

_KIND = bytes(0 if c > 127 or chr(c).isalnum() else 1 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = 0xFFFFFFFF


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k = b of a CRC becomes when n more bytes are read, the XOR over k being the whole."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.empty((HEAD_BYTES + 2, 4, 256), np.uint32)
    out[0] = [[b << 8 * k for b in range(256)] for k in range(4)]
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> 8) ^ step[out[n - 1] & 255]
    return out


class Head:
    """The frequent words with their CRC states, and the frequent pairs with theirs."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]) -> None:
        words = [w for w in words if len(w) <= HEAD_BYTES]
        ids = {w: i for i, w in enumerate(words)}
        own = Block([b" ".join(words)], _KIND)
        self.of_word = np.full(WORD_SLOTS, -1, np.int64)
        # the words come in order of their counts: of two in a slot the more frequent one stays
        self.of_word[self.word_slot(own.words[::-1])] = np.arange(len(words))[::-1]
        self.letters = np.stack([own.letters(np.arange(len(words)), k) for k in range(-(-HEAD_BYTES // 8))]) if words else np.zeros((4, 1), np.uint64)
        self.alone = np.array([zlib.crc32(w) for w in words] or [0], np.uint32)
        self.after_space = np.array([zlib.crc32(b" " + w) for w in words] or [0], np.uint32)
        self.size = np.array([len(w) + 1 for w in words] or [0], np.int64)
        self.shifts = _shifts()
        self.keys = np.full(SLOTS, np.iinfo(np.int64).max, np.int64)
        self.states = np.zeros(SLOTS, np.uint32)
        known = [(ids[a] << 32 | ids[b], zlib.crc32(a + b" " + b)) for a, b in reversed(pairs) if a in ids and b in ids]
        if known:
            keys, states = (np.array(x) for x in zip(*known, strict=True))
            slots = self.slot(keys)
            # of two pairs in a slot the more frequent one stays, as it comes last
            last = len(slots) - 1 - np.unique(slots[::-1], return_index=True)[1]
            self.keys[slots[last]], self.states[slots[last]] = keys[last], states[last]
        self.buckets = self.states % np.uint32(BUCKETS)

    @staticmethod
    def word_slot(prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(64 - WORD_SLOTS.bit_length() + 1)).astype(np.int64)

    def ids(self, block: Block) -> np.ndarray:
        """Numbers of the words of a block, -1 for those of the tail; the words are compared, not only their fingerprints."""
        found = self.of_word[self.word_slot(block.words)]
        good = (found >= 0) & (block.ends - block.starts + 1 == self.size[found])
        todo = np.flatnonzero(good)
        for k, letters in enumerate(self.letters):
            good[todo] = block.letters(todo, k) == letters[found[todo]]
            todo = todo[good[todo] & (self.size[found[todo]] - 1 > 8 * k + 8)]
        return np.where(good, found, -1)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def extend(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """CRC states after a space and the words ``ids`` more."""
        n = self.size[ids]
        out = self.after_space[ids]
        for k in range(4):
            out = out ^ self.shifts[n, k, (states >> np.uint32(8 * k)) & np.uint32(255)]
        return out


def features(block: Block, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document number of every feature of a block."""
    doc, ids = block.doc, head.ids(block)
    rare, text = ids < 0, block.text

    def extended(states: np.ndarray, last: np.ndarray) -> np.ndarray:
        """States after a space and the words at ``last`` more: the head's by look-up, the tail's from their bytes."""
        out = head.extend(states, ids[last])
        tail = np.flatnonzero(rare[last])
        pieces = (b" " + text[s:e] for s, e in zip(block.starts[last[tail]].tolist(), block.ends[last[tail]].tolist(), strict=True))
        out[tail] = np.fromiter(map(zlib.crc32, pieces, states[tail].tolist()), np.uint32, len(tail))
        return out

    states = head.alone[ids]
    tail = np.flatnonzero(rare)
    states[tail] = np.fromiter((zlib.crc32(text[s:e]) for s, e in zip(block.starts[tail].tolist(), block.ends[tail].tolist(), strict=True)), np.uint32, len(tail))
    found, owners = [states % np.uint32(BUCKETS)], [doc]
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    keys = ids[second - 1] << 32 | ids[second]
    slots = head.slot(keys)
    known = head.keys[slots] == keys  # a tail word makes a key below zero, which no pair of the table has
    pairs, unseen = head.states[slots], np.flatnonzero(~known)
    pairs[unseen] = extended(states[second[unseen] - 1], second[unseen])
    buckets = head.buckets[slots].copy()
    buckets[unseen] = pairs[unseen] % np.uint32(BUCKETS)
    found.append(buckets)
    owners.append(doc[second])
    # a pair goes on to a third word where the next pair begins with its second one
    on = np.flatnonzero(np.diff(second) == 1)
    third = second[on] + 1
    found.append(extended(pairs[on], third) % np.uint32(BUCKETS))
    owners.append(doc[third])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def _blocks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, block) of about ``CHUNK`` bytes; a longer text is a block of its own."""
    texts, size, begin = [], 0, 0
    for row, value in enumerate(batch.column(text).to_pylist()):
        texts.append(value or b"")
        size += len(texts[-1])
        if size >= CHUNK:
            yield begin, row + 1, Block(texts, _KIND)
            texts, size, begin = [], 0, row + 1
    if texts:
        yield begin, batch.num_rows, Block(texts, _KIND)


def _texts(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(F.col(f"`{text}`").cast("string").cast("binary").alias("_text"))


def frequent(docs: DataFrame, text: str = "text") -> Head:
    """The head of all documents: at most ``HEAD`` words and ``PAIRS`` pairs come to the driver."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for _, _, block in _blocks(batch, 0):
                codes, texts = block.distinct()
                inside = np.flatnonzero(block.doc[1:] == block.doc[:-1])
                for pair, most, keys in ((False, HEAD, codes), (True, PAIRS, codes[inside] << 32 | codes[inside + 1])):
                    numbers, values = pd.factorize(keys)
                    counts = np.bincount(numbers, minlength=len(values))
                    heavy = counts >= max(2, len(keys) // most)
                    values, counts = values[heavy], counts[heavy]
                    first = [texts[i] for i in (values >> 32 if pair else values).tolist()]
                    second = [texts[i] for i in (values & _MASK).tolist()] if pair else [None] * len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(counts)], ["_a", "_b", "_n"])

    parts = _texts(docs, text).mapInArrow(run, "_a binary, _b binary, _n long")
    fits = (F.octet_length("_a") <= HEAD_BYTES) & (F.octet_length(F.coalesce("_b", F.lit(b""))) <= HEAD_BYTES)
    counted = cut_lineage(parts.where(fits).groupBy("_a", "_b").agg(F.sum("_n").alias("_n")))
    best = lambda rows, most: rows.orderBy(F.desc("_n"), "_a", "_b").limit(most).collect()
    words = [bytes(r["_a"]) for r in best(counted.where("_b IS NULL"), HEAD)]
    return Head(words, [(bytes(r["_a"]), bytes(r["_b"])) for r in best(counted.where("_b IS NOT NULL"), PAIRS)])


def bucket_totals(rows: DataFrame, head, text: str = "text") -> np.ndarray:
    """How many features of all rows each bucket holds; ``head`` is a broadcast :class:`Head`."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in source:
            for _, _, block in _blocks(batch, 0):
                total += np.bincount(features(block, head.value)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["_bucket", "_n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in _texts(rows, text).mapInArrow(run, "_bucket long, _n long").groupBy("_bucket").agg(F.sum("_n").alias("_n")).collect():
        out[row["_bucket"]] = row["_n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, per bucket."""
    n, m = int(documents.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratio = ((target + 1).astype(float) * float(n)) / ((documents + 1).astype(float) * float(m))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, head, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_id, _words, n_features, weight: one row per row of ``docs``."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("_text"))
    gain = rows.sparkSession.sparkContext.broadcast(gain)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for begin, end, block in _blocks(batch, 1):
                buckets, owner = features(block, head.value)
                # sums below 2^53 are exact in doubles
                weight = np.bincount(owner, gain.value[buckets], end - begin).astype(np.int64)
                n = np.bincount(block.doc, minlength=end - begin)
                several = sum(np.maximum(n - k, 0) for k in range(WORDS))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(n), pa.array(several), pa.array(weight)], ["_id", "_words", "n_features", "weight"])

    return rows.mapInArrow(run, "_id long, _words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Add the 1-based place of every row in ``order``, a total order.

    Spark's sampled range partitioner deals the rows out, a window numbers them inside
    each partition, and one row per partition carries the numbers on.
    """
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin")))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(begins, "_part").withColumn(name, inside.cast("long") + F.col("_begin")).drop("_part", "_begin")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of ``docs``.

    The weight says how much more a text is like ``target`` than like the documents as a whole;
    score adds Gumbel noise that depends on the id alone; rank counts the drawn rows, those
    of the highest scores (ties to the smaller id, null ids last), and is null for the others.
    Drawn are ``percent`` of every 100 rows that have at least ``LEAST_WORDS`` words.
    Null, empty and wordless texts have no feature and weight zero. Repeated rows are
    rows of their own with equal scores, ranked one after the other. A null id draws its noise
    as an empty one. An empty table gives no rows; an empty target leaves the
    smoothing as its distribution. Other columns take no part, whatever their names.
    """
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(frequent(docs, text))
    gain = gains(bucket_totals(docs, head, text), bucket_totals(target, head, target_text))
    drawn_from = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(drawn_from, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    enough = F.col("_words") >= LEAST_WORDS
    # written with a number per row, so that equal rows keep their order in every later pass
    rows = weights(docs, head, gain, text, doc_id).withColumns({"score": F.col("weight") + noise, "_enough": enough, "_row": F.monotonically_increasing_id()})
    rows = cut_lineage(rows)
    most = rows.where("_enough").count() * percent // 100
    placed = ranked(rows, [F.desc("_enough"), F.desc("score"), F.asc_nulls_last("_id"), F.asc("_row")], "_place")
    rank = F.when(F.col("_enough") & (F.col("_place") <= most), F.col("_place"))
    return placed.select(F.col("_id").alias("doc_id"), "n_features", "weight", "score", rank.alias("rank"))
