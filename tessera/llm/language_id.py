"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, each keeps its largest value, and a
softmax layer reads these. A text is cut into windows that cover all of it; its prediction is the mean of theirs.

Training reads at most ``SAMPLE_ROWS`` documents, the first by a hash of their id, each whole, until ``SAMPLE_WINDOWS``
windows are there, so that the driver's work has a bound. For prediction, embedding and filters are folded into tables by byte and byte pair.

Defined cases: null text or text without a letter is ``und`` with score 0; null doc_id is predicted, never learnt from,
and counts as held out; rows without lang are not learnt from; repeated rows are predicted each; an empty table
gives no rows; without any labelled row every text is ``und``; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality_classifier import fold
from tessera.llm.words import slices

WINDOW = 192
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 6
#: Training takes documents in the order of a hash of their id, each whole, up to so many or so many windows.
SAMPLE_ROWS, SAMPLE_WINDOWS = 3000, 12_000
#: Windows that are held at once.
BLOCK = 512
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_OVER = max(WIDTHS) - 1


def windows(data: bytes) -> np.ndarray:
    """Rows of WINDOW bytes that cover ``data``, each with the next bytes the widest filter reaches into; zeros after the end."""
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(n * WINDOW + _OVER, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW + _OVER), (WINDOW, 1))


class ByteNet:
    """Parameters, training and prediction."""

    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.p["bias"] = np.zeros(len(classes), np.float32)

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over a batch of windows."""
        p, n = self.p, len(x)
        embedded = p["embed"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            spans = np.concatenate([embedded[:, k : k + WINDOW] for k in range(w)], axis=2)
            value = spans @ p[f"w{w}"] + p[f"c{w}"]
            at = value.argmax(axis=1)
            top = np.take_along_axis(value, at[:, None, :], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            kept.append((spans, at, top > 0))
        hidden = np.concatenate(pooled, axis=1)
        logits = hidden @ p["out"] + p["bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        grad = {"out": hidden.T @ prob, "bias": prob.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = prob @ p["out"].T
        rows = np.arange(n)[:, None]
        for k, (w, (spans, at, live)) in enumerate(zip(WIDTHS, kept, strict=True)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS] * live
            grad[f"c{w}"] = g.sum(axis=0)
            chosen = spans[rows, at]  # n, filters, w * embed
            grad[f"w{w}"] = np.einsum("nfe,nf->ef", chosen, g)
            into = (g[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            where = x[rows[:, :, None], at[:, :, None] + np.arange(w)]
            np.add.at(grad["embed"], where.reshape(-1), into.reshape(-1, EMBED))
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                part, t = order[lo : lo + batch], t + 1
                for k, g in self._step(x[part], y[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def folded(self) -> dict[int, list[np.ndarray]]:
        """For each width, tables whose looked-up rows add up to the filters' values: one by byte pair for every two
        bytes, and one by byte for a last odd one."""
        out = {}
        for w in WIDTHS:
            single = [self.p["embed"] @ self.p[f"w{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)]
            single[0] = single[0] + self.p[f"c{w}"]
            pairs = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(1 << 16, FILTERS) for k in range(0, w - 1, 2)]
            out[w] = pairs + ([single[w - 1]] if w % 2 else [])
        return out

    def predict(self, tables: dict[int, list[np.ndarray]], x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows."""
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for w in WIDTHS:
            value = np.take(tables[w][0], pair[:, :WINDOW], axis=0)
            for k, table in enumerate(tables[w][1:], 1):
                value += np.take(table, pair[:, 2 * k : 2 * k + WINDOW] if len(table) > 256 else x[:, 2 * k : 2 * k + WINDOW], axis=0)
            pooled.append(np.maximum(value.max(axis=1), 0))
        logits = np.concatenate(pooled, axis=1) @ self.p["out"] + self.p["bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        return prob / prob.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS) -> ByteNet | None:
    """A network learnt from text and lang of documents outside the held-out fold; None without any."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    n = F.greatest(F.ceil(F.octet_length("text") / WINDOW), F.lit(1)).alias("n")
    known = known.select("doc_id", "lang", "text").withColumn("h", F.xxhash64("doc_id"))
    first = known.select("h", "doc_id", n).orderBy("h", "doc_id").limit(sample_rows).collect()  # three numbers a row
    held, last = 0, None
    for row in first:
        if held >= sample_windows:
            break
        held, last = held + row["n"], row["h"]
    if last is None:
        return None
    size = WINDOW + _OVER

    def cut(batches):
        for batch in batches:
            ids, langs, parts = [], [], []
            for doc_id, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for part in windows(text.encode("utf-8", "surrogatepass")):
                    ids.append(doc_id)
                    langs.append(lang)
                    parts.append(part.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["doc_id", "lang", "part"])

    rows = known.where(F.col("h") <= last).select("doc_id", "lang", "text").limit(sample_rows).mapInArrow(cut, "doc_id long, lang string, part binary").toArrow().to_pylist()
    rows = sorted((r["doc_id"], r["lang"], r["part"]) for r in rows)
    classes = sorted({lang for _, lang, _ in rows})
    net, number = ByteNet(classes), {c: k for k, c in enumerate(classes)}
    x = np.frombuffer(b"".join(part for _, _, part in rows), np.uint8).reshape(-1, size)
    net.train(x, np.array([number[lang] for _, lang, _ in rows]))
    return net


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text). The network has a fixed size, some KB."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        tables = net.folded() if net else None
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            langs, scores, waiting, owner = [UNKNOWN] * len(texts), [0.0] * len(texts), [], []
            sums = np.zeros((len(texts), len(net.classes))) if net else None
            counts = np.zeros(len(texts))

            def flush():
                if waiting:
                    who = np.concatenate(owner)
                    np.add.at(sums, who, net.predict(tables, np.concatenate(waiting)))
                    np.add.at(counts, who, 1)
                    waiting.clear()
                    owner.clear()

            held = 0
            for k, text in enumerate(texts):
                if net is None or not text or not _LETTER.search(text):
                    continue
                x = windows(text.encode("utf-8", "surrogatepass"))
                for lo in range(0, len(x), BLOCK):
                    part = x[lo : lo + BLOCK]
                    waiting.append(part)
                    owner.append(np.full(len(part), k))
                    held += len(part)
                    if held >= BLOCK:
                        flush()
                        held = 0
            if net:
                flush()
                mean = sums / np.maximum(counts, 1)[:, None]
                for k in np.flatnonzero(counts).tolist():
                    best = int(mean[k].argmax())
                    langs[k], scores[k] = net.classes[best], float(mean[k][best])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(True)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` (doc_id, text, lang) and predict every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return predict(docs, fit(docs))
