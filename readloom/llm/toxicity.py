"""Toxicity by classifier chains.

The categories are label columns, in a given order. The first has a linear (logistic)
model over indicators of words and word beginnings, so that a stem counts whatever its
ending; each later one has these and the probabilities of all earlier categories as
features. In training these probabilities are out of fold: they
come from models that have not seen the row, as at prediction.

Words and beginnings are chosen by how unevenly the classes of any category use them, on a bounded
sample of labelled rows. Prediction reads every row and its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import batches, bounded_sample, cut_lineage, held_out, labelled_texts
from readloom.llm.linear import fit_logistic, sigmoid

#: Label columns in chain order. The value 0 of ``quality`` is its positive class.
CATEGORIES = ("quality", "toxic")
POSITIVE = {"quality": 0, "toxic": 1}
MAX_ROWS = 8_000
#: Most words in the model, fewest sample rows that hold one, and least difference between the classes in standard errors.
MAX_WORDS, MIN_ROWS, MIN_Z = 2_048, 4, 4.0
FOLDS = 4
#: Least probability of the last category that is predicted as such.
THRESHOLD = 0.5


#: Lengths of word beginnings.
STEMS = (4, 5, 6, 7)
_MARKS = "\"'.,;:!?()[]{}<>*#$%&|@+=-_~`/\\"
#: Words that a worker remembers.
_REMEMBERED = 500_000


def parts(word: str) -> list[str]:
    """The word without the marks around it, ended by a blank, and its beginnings."""
    word = word.strip(_MARKS)
    return [word + " ", *[word[:n] for n in STEMS if len(word) >= n]] if word else []


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words and beginnings of a text."""
    return {part for word in set((text or "").lower().split()) for part in parts(word)}


@dataclass(frozen=True)
class ChainModel:
    """``weights``: per category, over the words, the earlier probabilities, and the bias."""

    categories: tuple[str, ...]
    words: dict[str, int]
    weights: list[np.ndarray]

    def predict(self, text: str | None, memory: dict[str, tuple[int, ...]]) -> list[float]:
        """Probability per category; ``memory`` holds what words amount to, and may start empty."""
        found: set[int] = set()
        for word in set((text or "").lower().split()):
            known = memory.get(word)
            if known is None:
                if len(memory) >= _REMEMBERED:
                    memory.clear()
                known = memory[word] = tuple(self.words[p] for p in parts(word) if p in self.words)
            if known:
                found.update(known)
        index = sorted(found)
        earlier: list[float] = []
        for weights in self.weights:
            tail = weights[len(self.words) :]
            earlier.append(float(sigmoid(weights[index].sum() + tail[:-1] @ np.array(earlier) + tail[-1])) if len(tail) > 1 else float(sigmoid(weights[index].sum() + tail[0])))
        return earlier


def _positive(category: str) -> Column:
    return F.when(F.col(category).isin(0, 1), (F.col(category) == POSITIVE.get(category, 1)).cast("int"))


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_rows: int = MAX_ROWS) -> ChainModel:
    """Fit the chain on labelled rows that are not held out.

    Rows without an id or without one of the labels teach nothing; of repeated label rows
    the larger positive label counts. Rows equal in id and text teach once, and an id with
    several texts as in :func:`labelled_texts`. A category with one class only has a constant model.
    """
    known = labels.select(F.col("doc_id").alias("_id"), *[_positive(c).alias(f"_y{i}") for i, c in enumerate(categories)]).dropna()
    known = known.groupBy("_id").agg(*[F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(categories))]).where(~held_out(F.col("_id")))
    known = bounded_sample(known, F.col("_id"), max_rows)
    rows = labelled_texts(docs, known, max_rows)
    targets = [f"_y{i}" for i in range(len(categories))]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([sorted(words_of(t.as_py())) for t in batch.column(1)], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], ["_id", "_words", *targets])

        return step

    schema = ", ".join(["_id string", "_words array<string>", *[f"{t} int" for t in targets]])
    sample = cut_lineage(batches(rows.select(F.col("_id").cast("string"), "_text", *targets), make, schema))
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in targets]).first()
    used = sample.select(F.explode("_words").alias("_word"), *targets).groupBy("_word").agg(F.count("*").alias("_n"), *[F.sum(t).alias(t) for t in targets]).where(F.col("_n") >= MIN_ROWS)
    uneven = F.lit(0.0)
    for t in targets:
        share = (totals[t] or 0) / max(totals.n, 1)
        if 0 < share < 1:
            uneven = F.greatest(uneven, F.abs(F.col(t) - F.col("_n") * share) / F.sqrt(F.col("_n") * share * (1 - share)))
    words = used.withColumn("_z", uneven).where(F.col("_z") >= MIN_Z).orderBy(F.desc("_z"), "_word").limit(MAX_WORDS).select("_word").collect()
    index = {r[0]: i for i, r in enumerate(sorted(words))}
    listed = F.array_intersect("_words", F.array(*[F.lit(w) for w in index]).cast("array<string>")) if index else F.array().cast("array<string>")
    taught = sorted(sample.select("_id", listed, *targets).collect(), key=lambda r: (len(r[0]), r[0], r[1]))  # a bounded sample
    features = [np.array(sorted(index[w] for w in r[1]), np.int64) for r in taught]
    target = np.array([r[2:] for r in taught], np.int64).reshape(len(taught), len(categories))
    return ChainModel(tuple(categories), index, fit_chain(features, target, len(index)))


def fit_chain(features: list[np.ndarray], target: np.ndarray, width: int) -> list[np.ndarray]:
    """Weights per category; the earlier probabilities are out of fold."""
    n = len(features)
    earlier, weights = np.zeros((n, 0)), []
    fold = np.arange(n) % FOLDS
    for k in range(target.shape[1]):
        y = target[:, k]
        if n == 0 or y.min() == y.max():
            constant = np.zeros(width + k + 1)
            constant[-1] = 500.0 if n and y[0] else -500.0
            weights.append(constant)
            earlier = np.column_stack([earlier, np.full(n, float(n and y[0]))])
            continue
        out = np.zeros(n)
        for f in range(FOLDS):
            learn, judge = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(judge) or not len(learn):
                continue
            w = fit_logistic([features[i] for i in learn], earlier[learn], y[learn], width)
            out[judge] = [sigmoid(w[features[i]].sum() + w[width:-1] @ earlier[i] + w[-1]) for i in judge]
        weights.append(fit_logistic(features, earlier, y, width))
        earlier = np.column_stack([earlier, out])
    return weights


def predict(docs: DataFrame, model: ChainModel) -> DataFrame:
    """doc_id, held_out, score, predicted, and p_<category> for each: one row per row of ``docs``.

    score is the last category's probability; null texts score as empty ones.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{c}" for c in model.categories]

    def make():
        use, memory = shared.value, {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([use.predict(t.as_py(), memory) for t in batch.column(1)]).reshape(batch.num_rows, len(names))
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(len(names))]], ["doc_id", *names])

        return step

    out = batches(rows, make, rows.select("doc_id", *[F.lit(0.0).alias(n) for n in names]).schema)
    score = F.col(names[-1])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), *names)
