"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are single words and pairs of neighbours, hashed to 2^BITS places; a place's value is its count over the
root of the text's n-gram count. A score is one sparse dot product.

Training reads at most ``SAMPLE_ROWS`` labelled documents of at most about ``SAMPLE_WORDS`` words in all, the first by a
hash of their id, each whole, so that the driver's work has a bound; features are made on the executors.

Defined cases: null or wordless text has the bias alone as score; null doc_id is scored, never learnt from, and counts
as held out; of repeated labels the lowest is taken; repeated rows are scored each; an empty table gives no rows; without
any label every score is 0.5; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import slices, split_words, window_hashes, word_hashes

BITS = 18
SAMPLE_ROWS, SAMPLE_WORDS = 8000, 6_000_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % folds


def places(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, repeats included."""
    h = word_hashes(split_words(text))
    both = np.concatenate([window_hashes(h, 1), window_hashes(h, 2)])
    return (both >> np.uint64(64 - BITS)).astype(np.int32)


def _features(batches):
    for batch in slices(batches):
        at, values = [], []
        for text in batch.column(1).to_pylist():
            found = places(text)
            unique, counts = np.unique(found, return_counts=True)
            at.append(unique.astype(np.int32))
            values.append((counts / max(1.0, np.sqrt(len(found)))).astype(np.float32))
        yield pa.record_batch([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["label", "at", "value"])


class Ftrl:
    """Per-coordinate FTRL-Proximal (McMahan et al. 2013) for logistic loss."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, seed: int = 7) -> np.ndarray:
    """Weights of 2^BITS places and, last, the bias."""
    model, order = Ftrl((1 << BITS) + 1), np.random.default_rng(seed)
    bias, one = np.array([1 << BITS], np.int32), np.ones(1, np.float32)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, at, value = rows[k]
            model.learn(np.concatenate([at, bias]), np.concatenate([value, one]), label)
    return model.weights().astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> np.ndarray:
    """Weights learnt from ``labels`` (doc_id, quality) of documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(fold("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # so many rows at most are broadcast
    texts = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row an id
    texts = texts.withColumn("n", F.size(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")))
    before = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # sample_rows rows at most
    texts = texts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_words).select("label", "text")
    found = texts.mapInArrow(_features, "label int, at array<int>, value array<float>").toArrow()
    if not found.num_rows:
        return np.zeros((1 << BITS) + 1, np.float32)
    label, at, value = (found.column(c).combine_chunks() for c in ("label", "at", "value"))
    bounds, places_of, values = at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy()
    rows = [(y, places_of[lo:hi], values[lo:hi]) for y, lo, hi in zip(label.to_pylist(), bounds[:-1], bounds[1:], strict=True)]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    return train(rows)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text). ``weights`` have a fixed size, 1 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        bias = float(w[-1])
        for batch in slices(batches):
            z = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(2).to_pylist()):
                found = places(text)
                z[k] = bias + float(w[found].sum(dtype=np.float64)) / np.sqrt(max(1, len(found)))
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(True)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labels`` and score every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return score(docs, fit(docs, labels))
