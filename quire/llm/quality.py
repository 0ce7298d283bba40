"""Quality classifier: regularised quadratic discriminant analysis.

Every document becomes a vector of transformed statistics of its whole text.
Per class, mean and covariance are summed over all training rows in Spark
(raw moments of bounded transforms, one small row set per task); the driver
receives two sets of about 200 sums, shrinks the covariances and keeps their
Cholesky factors. The score is the logistic of the difference of the two
Mahalanobis log densities.

Defined results: a null text counts as empty; an empty text has a score like
any other; rows with a null or other label than 0 / 1 teach nothing; a null
``doc_id`` joins no label; repeated documents or labels count as often as
they occur; with a class missing from the training rows every score is the
smoothed share of label 1. Columns other than ``doc_id`` and ``text`` are
never read for a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, text_bytes

THRESHOLD = 0.7                  # predicted 1 from this score on
FEATURES = ("words", "word_length", "upper", "digit", "symbol", "stop", "shout", "high", "blank", "types", "adjacent",
            "top_word", "top_five", "line_types", "line_length", "entropy", "symbol_words", "short_words")
K = len(FEATURES)
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_STOP, _SHOUT = np.frombuffer(b".,;:", np.uint8), np.frombuffer(b"!?", np.uint8)
_SYMBOL = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~[]", np.uint8)
_BLANK = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_SYMBOLS = frozenset(_SYMBOL.tolist()) | frozenset(_SHOUT.tolist())


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text: logs of counts and of shares (with a floor of 0.001)."""
    n = len(text)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    words = text.split()
    w = len(words)
    lines = [x for x in text.split(b"\n") if x]
    counts = Counter(words)
    top = sorted(counts.values(), reverse=True)[:5]
    p = c[c > 0] / max(n, 1)
    share = [c[_UPPER].sum() / max(n, 1), c[_DIGIT].sum() / max(n, 1), c[_SYMBOL].sum() / max(n, 1),
             c[_STOP].sum() / max(n, 1), c[_SHOUT].sum() / max(n, 1), c[128:].sum() / max(n, 1),
             c[_BLANK].sum() / max(n, 1), len(counts) / max(w, 1),
             sum(map(bytes.__eq__, words, words[1:])) / max(w - 1, 1), (top[0] if top else 0) / max(w, 1),
             sum(top) / max(w, 1), len(set(lines)) / max(len(lines), 1)]
    ends = sum(1 for x in words if x[-1] in _SYMBOLS) / max(w, 1)
    short = sum(1 for x in words if len(x) <= 3) / max(w, 1)
    lg = np.log(np.asarray([*share, ends, short]) + 1e-3)
    return [np.log1p(w), np.log1p((n - c[_BLANK].sum()) / max(w, 1)), *lg[:12], np.log1p(w / max(len(lines), 1)),
            float(-(p * np.log(p)).sum()), lg[12], lg[13]]


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``x`` (array of :data:`FEATURES`) per row of ``docs``."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in text_bytes(b)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants per class; ``prior`` = log odds of label 1."""

    prior: float
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None       # inverse of the lower Cholesky factor
    logdet: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.mean is not None:
            for sign, m, f, d in zip((-1, 1), self.mean, self.factor, self.logdet, strict=True):
                z -= sign * 0.5 * ((((x - m) @ f.T) ** 2).sum(1) + d)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Class -> sum of (1, x) (1, x)^T over all rows (``y`` int, ``x`` array), as a (K+1, K+1) matrix."""
    size = (K + 1) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, K)
            y = np.asarray(b.column(0))
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in (0, 1):
                total[k] += (x[y == k].T @ x[y == k]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size), pa.int32()),
                                          pa.array(np.tile(np.arange(size), 2), pa.int32()),
                                          pa.array(total.ravel())], names=["y", "i", "v"])

    sums = (rows.select("y", "x").mapInArrow(run, "y int, i int, v double")
            .groupBy("y", "i").agg(F.sum("v").alias("v")).collect())
    out = {0: np.zeros(size), 1: np.zeros(size)}
    for r in sums:
        out[r.y][r.i] = r.v
    return {k: v.reshape(K + 1, K + 1) for k, v in out.items()}


def fit(rows: DataFrame, toward_pooled: float = 0.1, toward_identity: float = 0.01) -> Model:
    """Fit on all rows (``y`` 0 / 1, ``x``). Each class covariance is shrunk
    toward the pooled one, then toward a multiple of the identity on the
    scale of the pooled standard deviations."""
    m = moments(rows)
    n = np.array([m[0][0, 0], m[1][0, 0]])
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Model(prior)
    mean = np.stack([m[k][0, 1:] / n[k] for k in (0, 1)])
    scatter = [m[k][1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factor, logdet = [], []
    for k in (0, 1):
        s = ((1 - toward_pooled) * scatter[k] + toward_pooled * pooled) / np.outer(scale, scale)
        s = (1 - toward_identity) * s + toward_identity * max(np.trace(s) / K, 1e-6) * np.eye(K)
        low = np.linalg.cholesky(s)
        factor.append(np.linalg.inv(low) / scale)
        logdet.append(2 * (np.log(np.diag(low)).sum() + np.log(scale).sum()))
    return Model(prior, mean, np.stack(factor), np.array(logdet))


def training_rows(feats: DataFrame, labels: DataFrame, label: str = "quality", train=None) -> DataFrame:
    """``y``, ``x`` of every labelled row; ``train`` (a boolean column of ``doc_id``) keeps the training rows."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = feats.select("doc_id", "x")
    if train is not None:
        known, rows = known.where(train), rows.where(train)
    return rows.join(known, "doc_id").select("y", "x")


def score(feats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``feats`` with ``x`` replaced by ``score`` and ``predicted``."""
    schema = T.StructType([*(f for f in feats.schema.fields if f.name != "x"),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("x")
            s = model.score(np.asarray(b.column(i).flatten()).reshape(-1, K))
            rest = [c for j, c in enumerate(b.columns) if j != i]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=schema.names)

    return feats.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches ``threshold``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(np.array([statistics(t) for t in text_bytes(b)]))
                yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, train_fold) -> tuple[DataFrame, Model]:
    """The stored features of all ``docs`` and the model of their training rows."""
    feats = store(features(docs), "quality")
    return feats, fit(training_rows(feats, labels, train=train_fold))
