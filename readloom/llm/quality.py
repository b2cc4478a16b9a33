"""Quality classifier: naive Bayes support vectors over character n-grams.

The features are indicators of a text's hashed character n-grams, and of n-grams over
a second stream that says of each word whether it repeats the word before it. They are
scaled by the log ratio of how often the two classes hold them, and brought to about
unit length; a linear hinge-loss model over them is fitted by dual coordinate descent,
and its margin becomes a probability by a sigmoid fitted on out-of-fold margins.

The model is fitted on at most about ``max_rows`` labelled rows; scoring reads every
row and its whole text, a piece at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import batches, bounded_sample, held_out, labelled_texts
from readloom.llm.linear import fit_hinge, fit_sigmoid, sigmoid

#: Bound of the labelled sample.
MAX_ROWS = 8_000
#: Hashed n-grams.
BITS = 17
WIDTH = 1 << BITS
ORDER = 3
#: Orders of the n-grams of repeated words; each has a number after those of the hashed ones.
REPEATS = (1, 2, 4, 8, 16)
FEATURES = WIDTH + len(REPEATS)
#: Added to a vector's squared length, so that very short texts lean on the bias.
FLOOR = 20.0
#: Added to both classes' counts.
SMOOTH = 1.0
FOLDS = 3
#: Least score of a document that stays.
KEEP = 0.7
_PIECE = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Sorted numbers of the hashed n-grams in a text, padded with a space on both sides.

    ``seen`` is a cleared scratch array of FEATURES booleans, and is cleared again.
    """
    text = f" {text or ''} "
    for at in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE + ORDER - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(codes) < ORDER:
            break
        gram = codes[: len(codes) - ORDER + 1].copy()
        for n in range(1, ORDER):
            gram *= np.uint64(1 << 21)
            gram += codes[n : len(codes) - ORDER + 1 + n]
        gram *= _MIX
        gram >>= np.uint64(64 - BITS)
        seen[gram] = True
    words = text.split()
    run = longest = 0
    for same in map(eq, words[1:], words):
        run = run + 1 if same else 0
        if run > longest:
            longest = run
    seen[WIDTH:] = [longest >= n for n in REPEATS]
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass(frozen=True)
class QualityModel:
    """``ratio`` and ``weights`` (bias last) over hashed n-grams; ``scale``, ``shift`` of the sigmoid."""

    ratio: np.ndarray
    weights: np.ndarray
    scale: float
    shift: float

    def vector(self, found: np.ndarray) -> np.ndarray:
        return _unit(self.ratio[found])

    def score(self, found: np.ndarray) -> float:
        margin = float(self.vector(found) @ self.weights[found]) + self.weights[-1]
        return float(sigmoid(self.scale * margin + self.shift))


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt(values @ values + FLOOR)


def _fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = [np.full(FEATURES, SMOOTH), np.full(FEATURES, SMOOTH)]
    for found, label in zip(rows, labels, strict=True):
        counts[label][found] += 1
    ratio = np.log(counts[1] / ((labels == 1).sum() + 2 * SMOOTH)) - np.log(counts[0] / ((labels == 0).sum() + 2 * SMOOTH))
    return ratio, fit_hinge([(r, _unit(ratio[r])) for r in rows], labels, FEATURES)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    """Fit on labelled rows that are not held out.

    Rows without an id or with a label other than 0 and 1 teach nothing; of a repeated
    label row the smaller label counts. Rows equal in id and text teach once, and an id with
    several texts as in :func:`labelled_texts`. With one class or none, every text scores the share
    of class 1 (1 if there are no labels at all).
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("_label"))
    known = bounded_sample(known.where(~held_out(F.col("_id"))), F.col("_id"), max_rows)
    # the labels choose the rows before any text is read
    rows = labelled_texts(docs, known, max_rows)

    def make():
        seen = np.zeros(FEATURES, bool)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            grams = [ngrams(t.as_py(), seen).astype(np.int32).tobytes() for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary()), batch.column(2)], ["_id", "_grams", "_label"])

        return step

    taught = batches(rows.select(F.col("_id").cast("string"), "_text", "_label"), make, "_id string, _grams binary, _label int")
    # a bounded sample, in an order that does not depend on the partitions
    sample = sorted(taught.collect(), key=lambda r: (len(r[0]), r[0], r[1]))
    grams, target = [np.frombuffer(r[1], np.int32) for r in sample], np.array([r[2] for r in sample], np.int64)
    if len(set(target.tolist())) < 2:
        share = float(target.mean()) if len(target) else 1.0
        return QualityModel(np.zeros(FEATURES), np.zeros(FEATURES + 1), 0.0, 500.0 if share == 1 else -500.0)
    margins = np.zeros(len(target))
    fold = np.arange(len(target)) % FOLDS
    for k in range(FOLDS):
        learn, judge = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        ratio, weights = _fit([grams[i] for i in learn], target[learn])
        margins[judge] = [_unit(ratio[grams[i]]) @ weights[grams[i]] + weights[-1] for i in judge]
    scale, shift = fit_sigmoid(margins, target)
    return QualityModel(*_fit(grams, target), scale, shift)


def add_scores(docs: DataFrame, model: QualityModel, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` as a struct _row, and _score of the whole text; null scores as empty."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        seen, use = np.zeros(FEATURES, bool), shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [use.score(ngrams(t.as_py(), seen)) for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_row", "_score"])

        return step

    return batches(rows, make, rows.select("_row", F.lit(0.0).alias("_score")).schema)


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    rows = add_scores(docs, train(docs, labels, max_rows), ["doc_id"]).select("_row.doc_id", F.col("_score").alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that score at least KEEP, with all their columns."""
    kept = add_scores(docs, train(docs, labels, max_rows), docs.columns).where(F.col("_score") >= KEEP)
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
