"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector shared by all ordered thresholds. The result is the
expected severity sum_k k * P(grade = k), 0 to 3, and the likeliest side of "any toxicity", P(grade >= 1) >= 1/2.

x holds which lower-cased feature words of a text, and which word beginnings of 4 and 5 bytes, occur, hashed. Labels
say toxic or not; the grades are derived in training: a toxic text is graded 1 to 3 by how many of its features are
toxicity marks (features far commoner in toxic than in clean training texts): up to a third, up to two thirds, or more
of the training texts' counts.

The model is fitted in one task on a bounded sample: of each class, the max_rows labelled documents with the smallest
hash of their id. Every row is scored, over its whole text.

Defined results: null and empty texts have no features: they are not trained on, and severity follows the thresholds
alone. Labels other than 0 and 1 are left out; a doc_id labelled twice counts once, with its smallest label. With no
training rows or one class only, the severity is 0 for all. Repeated rows are scored each for itself; columns other
than those named are ignored, except that score() returns them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from redline.llm import words as W
from redline.llm.features import feature_words
from redline.llm.quality_model import Ftrl, labelled_sample

BITS = 20
MAX_ROWS = 3000
BEGINNINGS = (4, 5)
GRADES = 4


def present_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the distinct features of each text, in order."""
    data = W.LOWER[data]
    starts, ends, bounds = feature_words(data, offsets)
    text = W.text_of(bounds).astype(np.int64)
    place = lambda h: (h >> W.U(64 - bits)).astype(np.int64)
    keys = [text << bits | place(W.span_hashes(data, starts, ends))]
    for n in BEGINNINGS:
        at = np.flatnonzero(ends - starts > n)
        keys.append(text[at] << bits | place(W.mix(W.span_hashes(data, starts[at], starts[at] + n) + W.U(n))))
    key = np.unique(np.concatenate(keys))
    return key >> bits, key & ((1 << bits) - 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def mark_counts(rows: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Toxicity marks in each text: features at least 8 times as common in toxic texts, and in 2 of them at least."""
    bad, good = np.zeros(size), np.zeros(size)
    for row, y in zip(rows, toxic):
        (bad if y else good)[row] += 1
    marks = (bad >= 2) & (bad / toxic.sum() >= 8 * (good + 0.5) / (len(toxic) - toxic.sum()))
    return np.array([marks[row].sum() for row in rows])


def grade(rows: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    count = mark_counts(rows, toxic, size)
    low, high = np.quantile(count[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (count > low) + (count > high), 0)


class OrdinalModel:
    """Cumulative-link model. The shared weights take follow-the-regularised-leader steps, whose L1 part keeps features
    that are no evidence at exactly zero, and which may not fall below zero: words can only add to the severity, and a
    text without marks stays below the first threshold. The thresholds take plain adaptive steps."""

    def __init__(self, size: int, grades: int = GRADES, rate: float = 0.3, l1: float = 2.0):
        self.weights = Ftrl(size, alpha=rate, l1=l1, l2=0.05)
        self.cut = np.linspace(2.0, 6.0, grades - 1)
        self.cut_gain = np.full(grades - 1, 1e-4)

    def step(self, at: np.ndarray, y: int) -> None:
        """One gradient step on -log P(grade = y)."""
        w = np.maximum(self.weights.weights(at), 0)
        eta = w.sum()
        high = _sigmoid(self.cut[y] - eta) if y < len(self.cut) else 1.0
        low = _sigmoid(self.cut[y - 1] - eta) if y else 0.0
        p = max(high - low, 1e-12)
        d_high, d_low = high * (1 - high), low * (1 - low)
        self.weights.update(at, np.full(len(at), (d_high - d_low) / p), w)
        for k, d in ((y, -d_high / p), (y - 1, d_low / p)):
            if 0 <= k < len(self.cut):
                self.cut_gain[k] += d * d
                self.cut[k] -= 0.05 / np.sqrt(self.cut_gain[k]) * d
        self.cut = np.maximum.accumulate(self.cut + np.arange(len(self.cut)) * 1e-9)


def probabilities(eta: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... (columns)."""
    return _sigmoid(eta[:, None] - cut[None, :])


def fit_sample(rows: list[np.ndarray], toxic: np.ndarray, bits: int, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << bits
    if not len(rows) or toxic.min() == toxic.max():
        return np.zeros(size), np.full(GRADES - 1, 35.0)
    y = grade(rows, toxic, size)
    model, draw = OrdinalModel(size), np.random.default_rng(7)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            model.step(rows[i], int(y[i]))
    return np.maximum(model.weights.weights()[:size], 0), model.cut


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bits: int = BITS, max_rows: int = MAX_ROWS) -> dict:
    """A model; training reads max_rows documents of each class at most, in one task; 2**bits weights at most come to
    the driver."""
    sample = [labelled_sample(labels, label, F.col("y") == y, max_rows) for y in (0, 1)]
    both = sample[0].union(sample[1]).groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(both), "doc_id")

    def features(batches):
        for batch in batches:
            for first, end, data, offsets in W.text_chunks(batch.column(1)):
                text, place = present_features(data, offsets, bits)
                cut = np.searchsorted(text, np.arange(end - first + 1))
                keep = np.flatnonzero(np.diff(cut))
                some = batch.slice(first, end - first).take(pa.array(keep))
                edges = pa.array(np.append(cut[keep], len(place)), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.ListArray.from_arrays(edges, pa.array(place.astype(np.int32)))], names=["doc_id", "y", "places"])

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        w, cut = fit_sample([np.asarray(p) for p in rows.places], rows.y.to_numpy(), bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": np.concatenate([at, -1 - np.arange(len(cut))]).astype("int32"), "weight": np.concatenate([w[at], cut])})

    trained = chosen.mapInArrow(features, "doc_id long, y int, places array<int>").groupBy().applyInPandas(train, "place int, weight double").toPandas()
    place, weight = trained.place.to_numpy(), trained.weight.to_numpy()
    w, cut = np.zeros(1 << bits, np.float32), np.full(GRADES - 1, 35.0)
    w[place[place >= 0]] = weight[place >= 0]
    cut[-1 - place[place < 0]] = weight[place < 0]
    return {"bits": bits, "weights": w, "cut": cut}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All rows and columns of docs plus severity double, grade int (likeliest), toxic_share double (P(grade >= 1)) and
    is_toxic boolean; columns of those names are replaced."""
    added = [StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("toxic_share", DoubleType()), StructField("is_toxic", BooleanType())]
    kept = docs.drop(*(f.name for f in added))
    at = kept.columns.index("text")
    spread = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(kept.schema.fields + added)
    names = schema.fieldNames()

    def run(batches):
        m = spread.value
        for batch in batches:
            for first, end, data, offsets in W.text_chunks(batch.column(at)):
                text, place = present_features(data, offsets, m["bits"])
                above = probabilities(np.bincount(text, m["weights"][place], end - first), m["cut"])
                each = np.hstack([np.ones((end - first, 1)), above]) - np.hstack([above, np.zeros((end - first, 1))])
                new = [pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays(batch.slice(first, end - first).columns + new, names=names)

    return kept.mapInArrow(run, schema)
