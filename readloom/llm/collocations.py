"""Phrase collocation mining with Rabin-Karp fingerprints.

numpy prefix polynomials hash every word of a block of texts, and prefix polynomials
over the words hash every run of words, so a phrase's fingerprint is two look-ups whatever its
length. Phrases are counted by length: a phrase can only be frequent if the two
phrases one word shorter inside it are, and these are looked up in a bit table of the
frequent fingerprints of that length. The table is of bounded size: where it fills up it
prunes less and loses nothing. Only fingerprints and counts of what is left are shuffled.

A last pass over the texts verifies and materialises. Occurrences whose
fingerprint is frequent point at the first one of their task, word for word comparison
with it tells collisions apart, and each task sends one row per phrase: its text, its
count and a document that holds it. Counts are then added up by text, so a collision costs a
row and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from readloom.llm.bits import Bits, bits_of
from readloom.llm.common import cut_lineage
from readloom.llm.grams import ALL, Block

#: Fixed values of the contract: longest phrase, least occurrences, factor of the score, per cent that a longer phrase may hold, phrases per language.
LONGEST, LEAST, SCALE, INSIDE, TOP = 4, 30, 2_000_000, 80, 2000
#: Bytes of text handled together; a piece longer than this is one block.
BLOCK = 1 << 21
#: Fingerprints counted, or words and phrases held, before they leave a task; rows that leave it together.
HELD, ROWS = 1 << 21, 1 << 16
#: Phrases ranked by one task, on average.
RANKED = 50_000

#: 0 inside a word, 1 blank, 2 between pieces.
_KIND = bytes(2 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 1 if chr(c) in " \t" else 0 for c in range(256))


def _candidates(block: Block, n: int, shorter: Bits | None) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of the runs of ``n`` words whose two runs of one word less may be frequent."""
    first, found = block.runs(n)
    if shorter is None or not len(first):
        return first, found
    some, less = block.runs(n - 1)
    good = np.zeros(len(block.starts), bool)
    good[some] = shorter.has(less)
    may = good[first] & good[first + 1]
    return first[may], found[may]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut between pieces."""
    if len(text) <= BLOCK:
        yield text
        return
    kind, at = text.translate(_KIND), 0
    while at < len(text):
        end = len(text) if len(text) - at <= BLOCK else kind.rfind(b"\2", at, at + BLOCK) + 1
        if end <= at:
            end = kind.find(b"\2", at + BLOCK) + 1 or len(text)
        yield text[at:end]
        at = end


def _blocks(batch: pa.RecordBatch, mask: int) -> Iterator[tuple[Block, list[str], list[int | None]]]:
    """Blocks of a batch (_id, _lang, _text) with the language and id of each of their documents."""
    texts, langs, ids, size = [], [], [], 0

    def block():
        keys = {x: xxh64_intdigest(x) for x in set(langs)}
        return Block(texts, _KIND, np.array([keys[x] for x in langs], np.uint64), mask), langs, ids

    for doc_id, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        for part in _pieces(text or b""):
            texts.append(part)
            langs.append(lang)
            ids.append(doc_id)
            size += len(part)
            if size >= BLOCK:
                yield block()
                texts, langs, ids, size = [], [], [], 0
    if texts:
        yield block()


def _counted(rows: DataFrame, n: int, shorter, least: int, mask: int) -> DataFrame:
    """_print of the runs of ``n`` words that occur ``least`` times or more."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["_print", "_n"])

        for batch in source:
            for block, _, _ in _blocks(batch, mask):
                held.append(_candidates(block, n, shorter and shorter.value)[1])
                size += len(held[-1])
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    counts = rows.mapInArrow(run, "_print long, _n long").groupBy("_print").agg(F.sum("_n").alias("_n"))
    return cut_lineage(counts.where(F.col("_n") >= least).select("_print"))


class _Found:
    """Phrases of a task: for each the words it points at, as numbers, and how often they occurred."""

    def __init__(self, longest: int) -> None:
        self.words: dict[bytes, int] = {}
        # fingerprints in order, and which phrase each one is
        self.known = [np.empty(0, np.uint64) for _ in range(longest)]
        self.place = [np.empty(0, np.int64) for _ in range(longest)]
        # per phrase its language, its document and its words
        self.shown = [np.empty((0, n + 2), np.int64) for n in range(1, longest + 1)]
        self.times = [np.empty(0, np.int64) for _ in range(longest)]
        self.others: dict[tuple[str, bytes], list] = {}
        self.langs: dict[str, int] = {}
        self.ids: list[int | None] = []

    def size(self) -> int:
        return len(self.words) + sum(map(len, self.times)) + len(self.others)

    def add(self, block: Block, langs: list[str], ids: list[int | None], tables: list[Bits]) -> None:
        own, texts = block.distinct()
        fresh = set(texts) - self.words.keys()
        self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh)), strict=True))
        number = np.fromiter(map(self.words.__getitem__, texts), np.int64, len(texts))[own]
        for lang in langs:
            self.langs.setdefault(lang, len(self.langs))
        lang = np.array([self.langs[x] for x in langs], np.int64)
        for name, n in zip(langs, np.bincount(block.doc, minlength=len(langs)).tolist(), strict=True):
            self.others.setdefault((name, b""), [0, 0, None])[1] += n
        for n, table in enumerate(tables, 1):
            first, found = block.runs(n)
            may = table.has(found)
            first = first[may]
            codes, values = pd.factorize(found[may])
            head = np.empty(len(values), np.int64)
            head[codes[::-1]] = first[::-1]
            known, place, times, shown = self.known[n - 1], self.place[n - 1], self.times[n - 1], self.shown[n - 1]
            where = np.searchsorted(known, values)
            at = np.append(place, -1)[where]
            at[np.append(known, 0)[where] != values] = -1
            new = np.flatnonzero(at < 0)
            new = new[np.argsort(values[new])]
            at[new] = np.arange(len(times), len(times) + len(new))
            self.known[n - 1], self.place[n - 1] = np.insert(known, where[new], values[new]), np.insert(place, where[new], at[new])
            doc = block.doc[head[new]]
            shown = np.concatenate((shown, np.stack([lang[doc], len(self.ids) + doc, *(number[head[new] + k] for k in range(n))], axis=1)))
            # an equal fingerprint is not enough: language and words have to be those of the occurrence pointed at
            of = at[codes]
            same = lang[block.doc[first]] == shown[of, 0]
            for k in range(n):
                same &= number[first + k] == shown[of, k + 2]
            self.shown[n - 1] = shown
            self.times[n - 1] = np.bincount(of[same], minlength=len(shown)) + np.concatenate((times, np.zeros(len(new), np.int64)))
            for other in first[~same].tolist():
                doc = block.doc[other]
                phrase = b" ".join(texts[i] for i in own[other : other + n].tolist())
                self.others.setdefault((langs[doc], phrase), [n, 0, ids[doc]])[1] += 1
        self.ids += ids

    def rows(self) -> Iterator[pa.RecordBatch]:
        words, langs = list(self.words), list(self.langs)
        names, kinds = ["_lang", "_words", "_phrase", "_n", "_doc"], [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        rest = [[k[0] for k in self.others], [v[0] for v in self.others.values()], [k[1] for k in self.others], [v[1] for v in self.others.values()], [v[2] for v in self.others.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rest, kinds, strict=True)], names)
        for n, (shown, times) in enumerate(zip(self.shown, self.times, strict=True), 1):
            for at in range(0, len(times), ROWS):
                part = shown[at : at + ROWS]
                texts = [list(map(words.__getitem__, part[:, k + 2].tolist())) for k in range(n)]
                phrases = list(map(b" ".join, zip(*texts, strict=True)))
                columns = [[langs[i] for i in part[:, 0].tolist()], np.full(len(part), n, np.int32), phrases, times[at : at + ROWS], [self.ids[i] for i in part[:, 1].tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _phrases(rows: DataFrame, tables, mask: int) -> DataFrame:
    """_lang, _words, _phrase, _n, _doc: a row per phrase of a frequent fingerprint and task, or part of one; no word stands for the sum of all words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(len(tables.value))
        for batch in source:
            for block, langs, ids in _blocks(batch, mask):
                found.add(block, langs, ids, tables.value)
                if found.size() > HELD:
                    yield from found.rows()
                    found = _Found(len(tables.value))
        yield from found.rows()

    return rows.mapInArrow(run, "_lang string, _words int, _phrase binary, _n long, _doc long").withColumn("_phrase", F.col("_phrase").cast("string"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: int = LEAST, longest: int = LONGEST, mask: int = ALL) -> DataFrame:
    """lang, words, phrase, n, doc_id: every run of up to ``longest`` words that occurs ``least`` times in its language.

    words is the number of words, doc_id one document that holds the phrase: that of the occurrence its rows pointed at, the
    smallest of several. The row of zero words has the number of all words of the language.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("_id"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("_lang"),
        F.col(f"`{text}`").cast("string").cast("binary").alias("_text"),
    )
    context = docs.sparkSession.sparkContext
    tables, shorter = [], None
    for n in range(1, longest + 1):
        frequent = _counted(rows, n, shorter, least, mask)
        size = frequent.count()
        if not size:
            break
        tables.append(bits_of(frequent, "_print", size))
        shorter = context.broadcast(tables[-1])
    found = _phrases(rows, context.broadcast(tables), mask).groupBy("_lang", "_words", "_phrase").agg(F.sum("_n").alias("_n"), F.min("_doc").alias("_doc"))
    found = found.where((F.col("_words") == 0) | (F.col("_n") >= least))
    return cut_lineage(found.select(F.col("_lang").alias("lang"), F.col("_words").alias("words"), F.col("_phrase").alias("phrase"), F.col("_n").alias("n"), F.col("_doc").alias("doc_id")))


def _joined(words: Column, begin: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def scored(frequent: DataFrame, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, score, doc_id of the candidates among ``frequent`` that no longer one covers."""
    words = F.split("phrase", " ")
    some = frequent.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), "doc_id")
    n = F.col("words")
    within = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: _joined(words, i, m))))
    longer = some.where("words > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    left = some.join(longer, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (100 * F.col("_most") < inside * F.col("a"))).drop("_most")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), n - 1))).select("*", _joined(words, F.lit(1), F.col("k")).alias("_left"), _joined(words, F.col("k") + 1, n - F.col("k")).alias("_right"))
    counts = frequent.where("words >= 1").select("lang", "phrase", "n")
    cuts = cuts.join(counts.toDF("lang", "_left", "l"), ["lang", "_left"]).join(counts.toDF("lang", "_right", "r"), ["lang", "_right"])
    # decimals, as the product may pass 64 bits
    score = F.expr(f"cast({SCALE} as decimal(38,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "doc_id")).alias("_low"))
    return lowest.select("lang", "phrase", "_low.a", "_low.l", "_low.r", "_low.score", "_low.doc_id")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; every task ranks a bounded share of a language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = cut_lineage(rows)
    parts = -(-rows.count() // RANKED)
    while parts > 1:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
        parts = -(-parts // max(2, RANKED // top))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP, mask: int = ALL) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, doc_id: the ``top`` phrases of each language.

    Null languages are ``und``; null and empty texts have no words; repeated rows count each time. Ties of
    score and count go by the phrase's bytes. A language without a frequent phrase
    has no rows, an empty table gives none. Null ids point nowhere: doc_id is null where only rows without an id
    hold a phrase. Other columns take no part, whatever their names.
    """
    frequent = frequent_phrases(docs, text, lang, doc_id, least, longest, mask)
    totals = frequent.where("words = 0").select("lang", F.col("n").alias("_all"))
    best = _best(scored(frequent, inside), top).join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", F.col("_all").alias("n"), "score", "doc_id")
