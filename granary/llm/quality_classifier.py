"""Quality classifier by compression: zstandard dictionaries built from good and from bad labelled text.

A text is compressed whole with either dictionary and without one. The normalised difference of the two sizes, with the
plain compression rate beside it, becomes a probability through a logistic calibration fitted on other labelled rows.

Defined cases: null and empty texts have equal sizes, so they score what the calibration gives for no evidence (the
prior of its intercept); null doc_id: held_out is false (crc32 of null) and it is scored like any row; repeated rows are
scored each; without labels of both kinds, every score is the share of good labels, or 0.5 without labels; labels
named twice with different values count for both. Columns of documents other than text are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import prepare

HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)"


@dataclass(frozen=True)
class QualityParams:
    """per_label bounds the labelled rows learnt from (of each label); texts over sample_bytes give one span of that size,
    at a place that their hash chooses. dict_bytes: size of either dictionary; level: of zstandard."""

    per_label: int = 1500
    sample_bytes: int = 16384
    dict_bytes: int = 65536
    level: int = 3
    threshold: float = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of 1 and the features
    level: int


class Scorer:
    """A model with its compressors, which are made once in a worker."""

    def __init__(self, model: QualityModel):
        self.model = model
        make = lambda d: zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_dict_id=False)
        self.plain, self.with_dict = make(None), []
        for raw in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO) if raw else None
            if d is not None:
                d.precompute_compress(level=model.level)
            self.with_dict.append(make(d))

    def features(self, text: bytes) -> tuple[float, ...]:
        if not text:
            return (0.0, 0.0, 0.0, 0.0)
        none, good, bad = len(self.plain.compress(text)), *(len(c.compress(text)) for c in self.with_dict)
        n = len(text)
        difference, rate = (bad - good) / max(bad, good), np.log(none / n)
        return (10 * difference, rate, rate * rate, np.log(n) * rate)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([(1.0, *self.features(t)) for t in texts]).reshape(len(texts), 5)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights), -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights of a logistic regression on standardised columns by damped Newton steps; the rows count by weight."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    penalty = np.array([0.0] + [ridge] * x.shape[1])
    w = np.zeros(z.shape[1])
    loss = lambda w: (weight * (np.logaddexp(0, z @ w) - y * (z @ w))).sum() + 0.5 * (penalty * w * w).sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return np.concatenate([[w[0] - (w[1:] * centre / scale).sum()], w[1:] / scale])


def train(texts: list[bytes], labels: np.ndarray, share_good: float, params: QualityParams) -> QualityModel:
    """Dictionaries from the even rows of either label, the calibration from the odd ones, weighted to the true shares."""
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        p = min(max(share_good, 1e-6), 1 - 1e-6) if len(labels) else 0.5
        return QualityModel(b"", b"", (float(np.log(p / (1 - p))), 0.0, 0.0, 0.0, 0.0), params.level)

    def dictionary(of: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(params.dict_bytes, of, level=params.level).as_bytes()
        except zstandard.ZstdError:  # too little text: the text itself is the dictionary
            return b"\n".join(of)[: params.dict_bytes]

    rows = {k: np.flatnonzero(labels == k) for k in (0, 1)}
    learn, fit = ({k: v[i::2] if len(v) > 1 else v for k, v in rows.items()} for i in (0, 1))
    base = QualityModel(*(dictionary([texts[i] for i in learn[k]]) for k in (1, 0)), (0.0,) * 5, params.level)
    scorer, both = Scorer(base), np.concatenate([fit[0], fit[1]])
    x, y = np.array([scorer.features(texts[i]) for i in both]), labels[both]
    weight = np.where(y == 1, share_good * len(y) / max(1, (y == 1).sum()), (1 - share_good) * len(y) / max(1, (y == 0).sum()))
    return QualityModel(base.good, base.bad, tuple(map(float, calibrate(x, y, weight))), params.level)


def fit(documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Learn from at most per_label rows of each label (those first by a hash of doc_id), never from held-out rows."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(f"not {HELD_OUT}").select("doc_id", "quality").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("quality = 0").orderBy(*order).limit(params.per_label).union(known.where("quality = 1").orderBy(*order).limit(params.per_label))
    n = params.sample_bytes
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    begin = F.when(F.octet_length("text") > n, F.pmod(F.xxhash64("text"), F.octet_length("text") - n) + 1).otherwise(1).cast("int")
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "quality", F.substring(raw, begin, F.lit(n)).alias("t")).toArrow().to_pydict()
    at = sorted(range(len(rows["t"])), key=lambda i: (rows["doc_id"][i], rows["t"][i]))
    total = sum(counts.values())
    return train([rows["t"][i] for i in at], np.array([rows["quality"][i] for i in at], int), counts.get(1, 0) / total if total else 0.5, params)


def score(documents: DataFrame, model: QualityModel, params: QualityParams = QualityParams()) -> DataFrame:
    """documents with score (0 to 1) and predicted (1 if score >= threshold), columns that replace any of those names."""
    spark = documents.sparkSession
    prepare(spark)
    kept = documents.select(*[c for c in documents.columns if c not in ("score", "predicted")])
    sent = spark.sparkContext.broadcast(model)  # two dictionaries and five numbers
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            texts = b.column(names.index("text")).cast(pa.binary()).to_pylist()
            s = scorer.scores([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= params.threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return kept.mapInArrow(run, schema_with(kept, "score double, predicted int"))


def schema_with(df: DataFrame, more: str):
    """The schema of df and further columns."""
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])
