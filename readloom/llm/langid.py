"""Language identification with bit-sliced n-gram filters.

Every language has a Bloom filter of the character n-grams that are typical of it. The
filters share their hash functions and are stored bit-sliced: slot i holds one bit per
language, so three look-ups and two ANDs return all languages that contain an n-gram.
A text's n-grams are looked up, the bits are counted per language, the count that false
positives alone would give is taken off, and the largest rest decides.

The filters are learned from at most about ``max_rows`` labelled rows, of which a rare
language keeps all it has up to its equal share, and have a fixed
largest size; prediction reads every row and its whole text, a piece at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import batches, bounded_sample_of_each, held_out

MAX_ROWS = 8_000
#: An n-gram is typical of a language that uses it at least this share of how often its heaviest user does.
TYPICAL = 0.25
#: Most n-grams per language: the most frequent ones.
MAX_GRAMS = 1 << 18
HASHES = 3
MIN_BITS, MAX_BITS = 12, 23
UNKNOWN = "und"
_PIECE = 1 << 19
#: Odd multipliers, one per hash function.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(piece: str) -> np.ndarray:
    """One n-gram per letter: the letter and its neighbours, lower-cased, anything else as a space.

    ``piece`` has one character of context on both sides.
    """
    codes = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    out = codes[:-2] << np.uint64(42)
    out |= codes[1:-1] << np.uint64(21)
    out |= codes[2:]
    return out[letter[1:-1]]


def pieces(text: str):
    padded = f" {text} "
    for at in range(0, max(len(padded) - 2, 0), _PIECE):
        yield padded[at : at + _PIECE + 2]


@dataclass(frozen=True)
class LanguageModel:
    """``slots``: (slots, bytes) of uint8, one bit per language; ``noise``: false-positive rates."""

    languages: list[str]
    slots: np.ndarray
    noise: np.ndarray

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Per language the n-grams that its filter holds; the number of n-grams."""
        shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
        histogram = np.zeros((self.slots.shape[1], 256), np.int64)
        n = 0
        for piece in pieces(text):
            found = grams(piece)
            n += len(found)
            masks = self.slots[(found * _MIX[0]) >> shift]
            for mix in _MIX[1:HASHES]:
                masks &= self.slots[(found * mix) >> shift]
            for byte in range(masks.shape[1]):
                histogram[byte] += np.bincount(masks[:, byte], minlength=256)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        return (histogram @ bits).reshape(-1)[: len(self.languages)], n

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the corrected counts; ties go to the language with more training rows."""
        if not text:
            return UNKNOWN, 0.0
        found, n = self.counts(text)
        if not n or not self.languages:
            return UNKNOWN, 0.0
        real = np.maximum((found - n * self.noise) / np.maximum(1 - self.noise, 1e-9), 0.0)
        best = int(real.argmax())
        return self.languages[best], float(real[best] / real.sum()) if real.any() else 0.0


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> LanguageModel:
    """Learn from rows with an id, a text and a language that are not held out.

    Languages are ordered by their rows, then by name. Without such rows the model knows no
    language, and every text is ``und``.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    rows = rows.where("_id IS NOT NULL AND _text IS NOT NULL AND _lang IS NOT NULL").where(~held_out(F.col("_id")))
    sizes = {r._lang: r.n for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").collect()}
    languages = list(sizes)
    sample = bounded_sample_of_each(rows, "_lang", sizes, max_rows).select("_lang", "_text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_lang.setdefault(lang, []).extend(grams(p) for p in pieces(text.as_py()))
            names, found, counts = [], [], []
            for lang, parts in by_lang.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                names += [lang] * len(gram)
                found.append(gram.view(np.int64))
                counts.append(n)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(found)), pa.array(np.concatenate(counts))], ["_lang", "_gram", "_n"])

        return step

    counts = batches(sample, make, "_lang string, _gram long, _n long").groupBy("_gram", "_lang").agg(F.sum("_n").alias("_n"))
    totals = counts.groupBy("_lang").agg(F.sum("_n").alias("_all"))
    rates = counts.join(F.broadcast(totals), "_lang").withColumn("_rate", F.col("_n") / F.col("_all"))  # one row per language
    typical = rates.withColumn("_most", F.max("_rate").over(Window.partitionBy("_gram"))).where(F.col("_rate") >= TYPICAL * F.col("_most"))
    ranked = typical.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_n"), "_gram"))).where(F.col("_rank") <= MAX_GRAMS)
    found = ranked.select("_lang", "_gram").collect()  # at most MAX_GRAMS per language
    return build(languages, [(languages.index(r[0]), r[1]) for r in found])


def build(languages: list[str], typical: list[tuple[int, int]]) -> LanguageModel:
    """Filters for (language number, n-gram) pairs."""
    owner = np.array([t[0] for t in typical], np.int64)
    gram = np.array([t[1] for t in typical], np.int64).view(np.uint64)
    most = int(np.bincount(owner, minlength=1).max()) if len(owner) else 0
    bits = min(max((8 * most).bit_length(), MIN_BITS), MAX_BITS)
    slots = np.zeros((1 << bits, max(1, -(-len(languages) // 8))), np.uint8)
    for mix in _MIX[:HASHES]:
        at = (gram * mix) >> np.uint64(64 - bits)
        np.bitwise_or.at(slots, (at, owner // 8), (1 << (owner % 8)).astype(np.uint8))
    filled = np.unpackbits(slots, axis=1, bitorder="little").mean(axis=0)[: len(languages)]
    return LanguageModel(languages, slots, filled**HASHES)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    ``und`` with score 0 for texts that are null or have no letter; a text none of whose
    n-grams is known gets the language with most training rows and score 0.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        use = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [use.predict(t.as_py()) for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    out = batches(rows, make, rows.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
