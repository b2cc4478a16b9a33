"""Packing token sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the whole instance is a histogram of
at most ``capacity`` rows, whatever the number of documents. It is reduced by Martello
and Toth's dominance rules (sets of pieces that some best packing holds are fixed and
taken away), and the rest is packed best fit decreasing, both with many equal pieces
at a time. The outcome is a short list of intervals "the pieces of this length with
these ranks go to these sequences"; every piece finds its place in it by its own rank.
Ranks come from counts per length and block of rows, so a length that most pieces
share is not one task.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import batches, cut_lineage

CAPACITY = 2048
#: Id after each document.
END = 0
TOKENIZER = "word_bpe_49k.json"
#: Words kept with their ids in a worker; beyond, it starts anew.
MOST_WORDS = 300_000
#: Bytes of text that are cut into words at a time.
SLICE = 1 << 22
#: Pieces that are ranked together, on average.
RANK_ROWS = 4_096
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


#: How the byte-level step of the tokenizer writes each byte: printable ones as they are, the rest from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_SPELLED = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordTokenizer(dict):
    """Little-endian unsigned 32-bit ids of words, made when first asked for.

    The tokenizer drops white space and never joins across it, so a text's ids are those
    of its words, one after another. Closing punctuation is cut off a word of letters
    first: both are tokens of their own to the tokenizer. Lower-case words of Latin
    letters go straight to its model, as no other step of it changes them; anything else
    takes all its steps. ``most`` bounds the memory, not the result.
    """

    def __init__(self, path: str, most: int = MOST_WORDS) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.split_off = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        plain = core.isascii()
        if core.isalpha() and (plain or (max(core) < "\u0250" and "\u0130" not in core)):
            small = core.lower()
            if len(core) < len(word):
                found = self[small] + self[word[len(core) :]]
            elif small != word:
                found = self[small]
            else:
                found = array("I", [t.id for t in self.split_off(word if plain else word.encode().decode("latin-1").translate(_SPELLED))]).tobytes()
        else:
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another and without closing ones, and where each begins.

        Words are cut and numbered by Arrow; only different words are looked up.
        """
        if len(self) > self.most:
            self.clear()
        words = pc.ascii_split_whitespace(texts)
        numbered = words.flatten().dictionary_encode()
        # one string for all of them is quicker to hand over than a string each
        listed = pc.binary_join(pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary), " ")[0].as_py()
        found = list(map(self.__getitem__, listed.split(" "))) if len(numbered.dictionary) else []
        known, sizes = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = numbered.indices.to_numpy()
        size = sizes[index]
        ends = np.cumsum(size)
        # the n-th id of a word stands n places behind the word's first one
        place = np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        begins = words.offsets.to_numpy() - words.offsets[0].as_py()
        return known[place], np.concatenate(([0], ends))[begins]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about SLICE bytes, a longer text by itself."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")), at + 1)
        yield texts.slice(at, end - at)
        at = end


_KEPT: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and END, cut at the capacity."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def make():
        tokenizer = _KEPT.setdefault(path, WordTokenizer(path))
        closing = array("I", [END]).tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc = [], [], [], [], []
            n = 0
            for texts in _slices(batch.column(1)):
                ids, begins = tokenizer.ids(texts)
                for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    whole = memoryview(ids[begin:end].tobytes() + closing)
                    for k, at in enumerate(range(0, len(whole) // 4, capacity)):
                        part = whole[4 * at : 4 * (at + capacity)]
                        row.append(n)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                    n += 1
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

        return step

    return batches(rows, make, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Interval:
    """Pieces of ``length`` with ranks from ``low``: ``each`` to a sequence from ``first`` on, from ``offset`` on."""

    length: int
    low: int
    high: int
    first: int
    each: int
    offset: int


class _Stock:
    """How many pieces of each length are left, and the ranks that are given out."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.sizes = sorted(self.left)
        self.plan: list[Interval] = []
        self.sequences = 0

    def take(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        low = self.used[length]
        self.plan.append(Interval(length, low, low + n, first, each, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.sizes.remove(length)

    def fix(self, lengths: list[int], times: int) -> None:
        """``times`` new sequences that hold just ``lengths``."""
        first, offset = self.sequences, 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            self.take(length, each * times, first, each, offset)
            offset += each * length
        self.sequences += times

    def largest(self, most: int, but: dict[int, int]) -> int | None:
        """Largest length up to ``most`` of which a piece is left besides those in ``but``."""
        for i in range(bisect_left(self.sizes, most + 1) - 1, -1, -1):
            if self.left[self.sizes[i]] > but.get(self.sizes[i], 0):
                return self.sizes[i]
        return None

    def smallest(self, n: int, but: int) -> list[int]:
        """The ``n`` shortest pieces besides one of length ``but``."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n, self.left[s] - (s == but))
            if len(out) >= n:
                break
        return out[:n]

    def best_pair(self, space: int, but: int) -> int:
        """Most that two pieces besides one of length ``but`` take of ``space``; 0 if no two fit."""
        low, high, best = 0, bisect_left(self.sizes, space + 1) - 1, 0
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            if self.left[a] - (a == but) < 1:
                low += 1
            elif self.left[b] - (b == but) < 1 or a + b > space or (low == high and self.left[a] - (a == but) < 2):
                high -= 1
            else:
                best = max(best, a + b)
                low += 1
        return best


def reduce(stock: _Stock, capacity: int) -> None:
    """Fix sets that dominate every other set with the same largest piece.

    For a piece of each length, longest first: alone if nothing fits beside it; with its
    longest partner if that fills the sequence, if no two pieces fit beside it, or if no
    three do and no two take more than the partner. Whatever a packing holds beside the
    piece can change places with the partner, so some best packing has the set. Lengths
    for which no rule holds are left to the best fit.
    """
    for length in sorted(stock.left, reverse=True):
        while stock.left[length]:
            space = capacity - length
            partner = stock.largest(space, {length: 1})
            if partner is None:
                stock.fix([length], stock.left[length])
                continue
            few = stock.smallest(3, length)
            if partner < space and len(few) > 1 and few[0] + few[1] <= space:
                if len(few) == 3 and sum(few) <= space or stock.best_pair(space, length) > partner:
                    break
            stock.fix([length, partner], stock.left[length] // 2 if partner == length else min(stock.left[length], stock.left[partner]))


def best_fit(stock: _Stock, capacity: int) -> None:
    """Best fit decreasing on what is left; sequences with equal space are handled together."""
    spaces: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # space -> (first sequence, how many)

    def add(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in open_:
                open_[space] = []
                insort(spaces, space)
            open_[space].append((first, n))

    for length in sorted(stock.left, reverse=True):
        while stock.left[length]:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                    spaces.pop(at)
            else:
                space, first = capacity, stock.sequences
                n = -(-stock.left[length] // (capacity // length))
                stock.sequences += n
            each = space // length
            full = min(n, stock.left[length] // each)
            rest = min(stock.left[length] - full * each, each) if full < n else 0
            if full:
                stock.take(length, full * each, first, each, capacity - space)
            if rest:
                stock.take(length, rest, first + full, rest, capacity - space)
                add(space - rest * length, first + full, 1)
            add(space - each * length, first, full)
            add(space, first + full + (rest > 0), n - full - (rest > 0))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Interval], int]:
    """Intervals and the number of sequences for so many pieces of each length."""
    stock = _Stock(counts)
    reduce(stock, capacity)
    best_fit(stock, capacity)
    return stock.plan, stock.sequences


def place(cut: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``cut`` with sequence_id and offset. Lengths are from 1 to ``capacity``."""
    counted = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    intervals, _ = plan({r.length: r.n for r in counted}, capacity)
    total = sum(r.n for r in counted)
    bins = max(1, -(-total // rank_rows))
    rows = cut.withColumn("_bin", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("piece"), F.col("ids_crc32")), F.lit(bins)))
    sizes = rows.groupBy("length", "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_lineage(sizes.select("length", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("length", "_bin").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("_inside", F.row_number().over(inside) - 1).join(sizes, ["length", "_bin"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_inside")).alias("_rank"))
    by_length: dict[int, list[Interval]] = {}
    for interval in intervals:  # in the order of their ranks
        by_length.setdefault(interval.length, []).append(interval)
    steps = {length: [np.array([getattr(i, k) for i in own], np.int64) for k in ("low", "first", "each", "offset")] for length, own in by_length.items()}
    shared = cut.sparkSession.sparkContext.broadcast(steps)

    def make():
        known = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                low, first, each, begin = known[size]
                at = np.searchsorted(low, rank[own], "right") - 1
                nth = rank[own] - low[at]
                sequence[own] = first[at] + nth // each[at]
                offset[own] = begin[at] + nth % each[at] * size
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

        return step

    return batches(ranked, make, cut.schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null texts are empty and hold END alone. Repeated rows, and rows without an id, are
    packed as often as they come. Sequences are gapless from offset 0.
    """
    return place(cut_lineage(pieces(docs, path, capacity, text, doc_id)), capacity, rank_rows)
