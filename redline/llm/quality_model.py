"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates
(per-coordinate steps, L1 and L2), scored as sparse dot products.

Both classes weigh the same in training, however rare one is. Epochs over the sample go on until the loss is small or no
longer falls, so a small sample is gone over more often than a large one; at the end the intercept is fitted once more by itself,
on all examples, so that 1/2 lies between the classes.

A text's features are log(1 + count), scaled to length one, so texts of any length compare. The model is fitted in one
task on a bounded sample: the max_rows labelled documents with the smallest hash of their id. Nothing else is sampled:
every row is scored, over its whole text.

Defined results: null and empty texts have no features and get the score of the intercept; they are not trained on.
Rows without a label, or whose label is null or not 0/1, are not trained on; a doc_id labelled twice counts once, with
its smallest label. With no training rows, or one class only, the intercept tells the smoothed class share (1/2 if
there are none). Repeated documents are scored each for itself. Columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from redline.llm import words as W
from redline.llm.features import hashed

BITS = 18
MAX_N = 2
MAX_ROWS = 4000
EPOCHS = 60
#: Training ends when an epoch's mean loss is below ENOUGH, or fell by less than SETTLED of itself.
ENOUGH, SETTLED = 0.05, 0.01
MODEL_FIELDS = "place int, weight double"


def unit_features(data: np.ndarray, offsets: np.ndarray, bits: int, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value): log counts scaled to length one."""
    text, place, count = hashed(data, offsets, bits, max_n, lower=False)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(text, value * value, len(offsets) - 1))
    return text, place, value / norm[text]


class Ftrl:
    """Follow the regularised leader, one example at a time; place 2**bits is the intercept."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at: np.ndarray, slope: np.ndarray, w: np.ndarray) -> None:
        more = slope * slope
        self.z[at] += slope - (np.sqrt(self.n[at] + more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += more


def fit_sample(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and intercept from (places, values, label) rows."""
    size = 1 << bits
    ones = sum(y for _, _, y in examples)
    if ones in (0, len(examples)):
        return np.zeros(size), float(np.log((ones + 1) / (len(examples) - ones + 1)))
    share = {1: len(examples) / (2 * ones), 0: len(examples) / (2 * (len(examples) - ones))}
    model = Ftrl(size)
    draw, last = np.random.default_rng(5), np.inf
    for _ in range(epochs):
        loss = 0.0
        for i in draw.permutation(len(examples)):
            place, value, y = examples[i]
            at, x = np.append(place, size), np.append(value, 1.0)
            w = model.weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            model.update(at, share[y] * (p - y) * x, w)
            loss -= share[y] * np.log(p if y else 1 - p)
        loss /= len(examples)
        if loss < ENOUGH or loss > (1 - SETTLED) * last:
            break
        last = loss
    w = model.weights()[:size]
    return w, fit_intercept(np.array([w[p] @ v for p, v, _ in examples]), np.array([y for _, _, y in examples]), share)


def fit_intercept(scores: np.ndarray, y: np.ndarray, share: dict[int, float]) -> float:
    """Where the weighted slope of the loss over the scores is zero, by halving; it falls in the intercept."""
    weight = np.where(y == 1, share[1], share[0])
    low, high = -scores.max() - 35, -scores.min() + 35
    for _ in range(100):
        b = (low + high) / 2
        slope = weight @ (y - 1 / (1 + np.exp(-np.clip(scores + b, -35, 35))))
        low, high = (b, high) if slope > 0 else (low, b)
    return float((low + high) / 2)


def labelled_sample(labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """doc_id and y of the max_rows usable labelled ids with the smallest hashes; its size is bounded by max_rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(usable)
    one = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def crc_rest(divisor: int) -> Column:
    """crc32 of the decimal doc_id, modulo; null where doc_id is null."""
    return F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(divisor))


def sample_features(docs: DataFrame, sample: DataFrame, bits: int, max_n: int) -> DataFrame:
    """y, places, values of the sample's documents with text. Only the sample, of bounded size, is broadcast."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in W.text_chunks(batch.column(1)):
                text, place, value = unit_features(data, offsets, bits, max_n)
                cut = np.searchsorted(text, np.arange(end - first + 1))
                keep = np.flatnonzero(np.diff(cut))
                y = batch.column(2).slice(first, end - first).take(pa.array(keep))
                ids = batch.column(0).slice(first, end - first).take(pa.array(keep))
                edges = pa.array(np.append(cut[keep], len(place)), pa.int32())
                arrays = [ids, y, pa.ListArray.from_arrays(edges, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(value))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "y", "places", "marks"])

    return chosen.mapInArrow(run, "doc_id long, y int, places array<int>, marks array<double>")


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", bits: int = BITS, max_n: int = MAX_N, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> dict:
    """A model: the non-zero weights (2**bits at most) and the intercept. Training reads max_rows documents at most,
    in one task; only the weights come to the driver."""
    sample = labelled_sample(labels, label, F.lit(True) if usable is None else usable, max_rows)

    def train(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        w, intercept = fit_sample([(np.asarray(p.values), np.asarray(v.values), y) for p, v, y in zip(rows.column("places"), rows.column("marks"), rows.column("y").to_pylist())], bits, epochs)
        at = np.flatnonzero(w)
        return pa.table({"place": pa.array(np.append(at, -1).astype("int32")), "weight": pa.array(np.append(w[at], intercept).astype("float64"))})

    trained = sample_features(docs, sample, bits, max_n).groupBy().applyInArrow(train, MODEL_FIELDS).toPandas()
    w = np.zeros(1 << bits, np.float32)
    inner = trained[trained.place >= 0]
    w[inner.place.to_numpy()] = inner.weight.to_numpy()
    outer = trained.weight[trained.place < 0]
    return {"bits": bits, "max_n": max_n, "weights": w, "intercept": float(outer.iloc[0]) if len(outer) else 0.0}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All rows and columns of docs plus score double, 0 to 1 (columns of that name are replaced)."""
    kept = docs.drop("score")
    at = kept.columns.index("text")
    spread = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(kept.schema.fields + [StructField("score", DoubleType())])
    names = schema.fieldNames()

    def run(batches):
        m = spread.value
        for batch in batches:
            for first, end, data, offsets in W.text_chunks(batch.column(at)):
                text, place, value = unit_features(data, offsets, m["bits"], m["max_n"])
                total = np.bincount(text, value * m["weights"][place], end - first) + m["intercept"]
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays(batch.slice(first, end - first).columns + [pa.array(p)], names=names)

    return kept.mapInArrow(run, schema)
