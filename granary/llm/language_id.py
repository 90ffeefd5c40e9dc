"""Language identification by a byte convolutional network: multi-width filters, max pooling and softmax, in numpy.

A text's bytes are cut into windows of fixed length, all of them, to its end. Filters of widths 2, 3 and 4 run over the
one-hot bytes of a window, their maxima over the window go through tanh to a softmax layer, and the windows' log
probabilities, weighted by length, are averaged to the text's. As the input is one-hot, a filter's response is a sum of
rows of its weights; two bytes at a time, so a width-4 filter costs two table look-ups a position.

Defined cases: a null text, an empty one and one without a letter get `und` with score 0; null doc_id: held_out is
false (crc32 of null); repeated rows are predicted each; without labelled rows every text gets `und` with score 0; with
one label, that label with score 1. Columns other than text are passed through, never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import prepare
from granary.llm.quality_classifier import HELD_OUT, schema_with

WIDTHS = (2, 3, 4)
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageParams:
    """per_label bounds the rows learnt from (of each language), span the windows of one span that each of them gives;
    window: bytes a window. All languages are learnt."""

    per_label: int = 400
    window: int = 256
    span: int = 16
    filters: int = 8
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    taps: tuple[np.ndarray, ...]  # for each width: width x 256 x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    window: int


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """Rows of size bytes that hold all of data; the last is filled up with spaces."""
    n = max(1, -(-len(data) // size))
    full = np.full(n * size, 32, np.uint8)
    full[: len(data)] = data
    return full.reshape(n, size)


def train(texts: list[bytes], labels: list[str], params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Adam on the cross-entropy of one window of each text an epoch; seeded, so equal rows give an equal model."""
    names = tuple(sorted(set(labels)))
    rng = np.random.default_rng(5)
    taps = [rng.normal(0, 0.3, (w, 256, params.filters)).astype(np.float32) for w in WIDTHS]
    d, k, size = params.filters * len(WIDTHS), len(names), params.window
    weights = [*taps, np.zeros(d, np.float32), rng.normal(0, 0.1, (d, k)).astype(np.float32), np.zeros(k, np.float32)]
    if k < 2:
        return LanguageModel(names, tuple(taps), *weights[len(WIDTHS) :], size)
    cut = [windows(np.frombuffer(t, np.uint8), size) for t in texts]
    y = np.searchsorted(names, labels)
    moment, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(params.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), params.batch):
            rows = order[at : at + params.batch]
            x = np.stack([cut[i][rng.integers(len(cut[i]))] for i in rows])
            pooled, where = [], []
            for w, t in zip(WIDTHS, weights, strict=False):
                z = sum(t[j][x[:, j : size - w + 1 + j]] for j in range(w))
                where.append(z.argmax(1))
                pooled.append(z.max(1))
            h = np.tanh(np.concatenate(pooled, 1) + weights[-3])
            logits = h @ weights[-2] + weights[-1]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            dz = (p @ weights[-2].T) * (1 - h * h)
            grads = [np.zeros_like(t) for t in weights[: len(WIDTHS)]] + [dz.sum(0), h.T @ p, p.sum(0)]
            f = np.arange(params.filters)
            for i, w in enumerate(WIDTHS):
                own = dz[:, i * params.filters : (i + 1) * params.filters]
                for j in range(w):
                    np.add.at(grads[i][j], (np.take_along_axis(x, where[i] + j, 1), f[None]), own)
            step += 1
            for w, g, m, s in zip(weights, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= params.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return LanguageModel(names, tuple(weights[: len(WIDTHS)]), *weights[len(WIDTHS) :], size)


class Predictor:
    """A model with its tables for two bytes at once."""

    def __init__(self, model: LanguageModel):
        self.model = model
        pair = lambda a, b: (a[None, :, :] + b[:, None, :]).reshape(65536, -1)  # noqa: E731  first byte is the low one
        self.tables = [[pair(t[j], t[j + 1]) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in model.taps]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window, for each label."""
        size, x = x.shape[1], np.ascontiguousarray(x.T)  # positions first: the maxima then run over whole rows
        pairs = (x[:-1].astype(np.uint16) | (x[1:].astype(np.uint16) << 8)).astype(np.intp)
        pooled = []
        for w, tables in zip(WIDTHS, self.tables, strict=True):
            span = size - w + 1
            z = tables[0].take(pairs[:span], axis=0, mode="clip")
            for j, t in enumerate(tables[1:], 1):
                z += t.take((pairs if len(t) == 65536 else x)[2 * j : 2 * j + span], axis=0, mode="clip")
            pooled.append(z.max(0))
        m = self.model
        logits = np.tanh(np.concatenate(pooled, 1) + m.bias) @ m.out + m.out_bias
        top = logits.max(1, keepdims=True)
        return logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        names, size = self.model.labels, self.model.window
        rows = [i for i, t in enumerate(texts) if t and names and LETTER.search(t.decode("utf-8", "replace"))]
        if len(names) == 1:
            for i in rows:
                labels[i], scores[i] = names[0], 1.0
            return labels, scores
        for i0 in range(0, len(rows), 64):
            some = rows[i0 : i0 + 64]
            cut = [windows(np.frombuffer(texts[i], np.uint8), size) for i in some]
            owner = np.repeat(np.arange(len(some)), [len(c) for c in cut])
            weight = np.full(len(owner), size, float)
            weight[np.cumsum([len(c) for c in cut]) - 1] = [len(texts[i]) - size * (len(c) - 1) for i, c in zip(some, cut, strict=True)]
            x, sums = np.concatenate(cut), np.zeros((len(some), len(names)))
            for a in range(0, len(x), 24):  # bounded memory, however long a text is
                np.add.at(sums, owner[a : a + 24], self.log_probabilities(x[a : a + 24]) * weight[a : a + 24, None])
            mean = sums / np.bincount(owner, weight)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for j, i in enumerate(some):
                best = int(p[j].argmax())
                labels[i], scores[i] = names[best], float(p[j, best])
        return labels, scores


def fit(documents: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from at most per_label rows of each language (those first by a hash of doc_id), never from held-out rows."""
    known = documents.where("lang is not null and text is not null and doc_id is not null").where(f"not {HELD_OUT}")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select("doc_id", "lang", place.alias("place")).where(F.col("place") <= params.per_label).drop("place")
    n = params.window * params.span
    raw, size = F.encode("text", "utf-8"), F.octet_length("text")
    begin = F.when(size > n, F.pmod(F.xxhash64("text"), size - n) + 1).otherwise(1).cast("int")
    rows = known.select("doc_id", "text").join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id").select("doc_id", "lang", F.substring(raw, begin, F.lit(n)).alias("t")).toArrow().to_pydict()
    at = sorted((i for i in range(len(rows["t"])) if LETTER.search(rows["t"][i].decode("utf-8", "replace"))), key=lambda i: (rows["doc_id"][i], rows["t"][i]))
    return train([rows["t"][i] for i in at], [rows["lang"][i] for i in at], params)


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """documents with lang_pred and score, columns that replace any of those names."""
    spark = documents.sparkSession
    prepare(spark)
    kept = documents.select(*[c for c in documents.columns if c not in ("lang_pred", "score")])
    sent = spark.sparkContext.broadcast(model)  # (9 * 256 + languages) * filters numbers
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(sent.value)
        for b in batches:
            labels, scores = predictor.predict(b.column(names.index("text")).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema_with(kept, "lang_pred string, score double"))
