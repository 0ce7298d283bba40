"""A learned dense text encoder (M1): TF-IDF, then a distributed randomised SVD.

A text becomes the counts of its hashed tokens (:mod:`.encode`), each times the
inverse document frequency of its bucket, scaled to length one. The encoder
projects these rows on the leading right singular vectors of the corpus's
matrix A (texts x buckets).

The range finder starts from a random matrix W (buckets x rank + oversample).
A power pass replaces it by an orthonormal basis of A'(A W): one scan, a task
sums its rows' part and the parts go through a tree. The last scan gives, in
one go, the R of a tall-skinny QR of Y = A W (tasks reduce their rows to a
triangle, triangles are stacked and reduced again) and A'Y. With Q = Y R^-1 the
small matrix B = Q'A = R^-T (A'Y)' is decomposed on the driver; its right
singular vectors are those of A. What the driver and the tasks hold is
(buckets x columns) numbers, whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_if_null
from ..session import materialize
from . import encode, linear

DIM, RANK, OVERSAMPLE, POWER = 4096, 64, 10, 3
SUM_BYTES = 64 << 20                  # of the matrices that one task, or the driver, sums
CELLS = 1 << 16                       # non-zero cells multiplied at once
LOT = 250                             # texts whose cells are numbers in memory at once


def term_counts(text, dim: int = DIM) -> Column:
    """Bucket and count of every token bucket of a text."""
    return encode.sparse_terms(blank_if_null(text), dim)


def document_frequencies(docs: DataFrame, text: str, dim: int = DIM) -> DataFrame:
    """bucket, df: the number of texts with a token in the bucket, and ``idf`` = ln((1 + texts) / (1 + df)) + 1."""
    n = docs.count()
    found = docs.select(F.explode(term_counts(text, dim)).alias("c")).groupBy(F.col("c.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("df"))
    return found.withColumn("idf", F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + F.col("df"))) + 1.0)


def _rows(terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a batch of texts: bucket, scaled weight, and where each text's cells begin (one entry more than texts)."""
    size = np.diff(np.asarray(terms.offsets)) if len(terms) else np.zeros(0, np.int64)
    flat = terms.flatten()
    bucket = np.asarray(flat.field("bucket")).astype(np.int64)
    value = np.asarray(flat.field("tf")).astype(float) * idf[bucket]
    row = np.repeat(np.arange(len(size)), size)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(size)))
    return bucket, value / np.where(norm > 0, norm, 1.0)[row], np.concatenate([[0], np.cumsum(size)])


def _times(bucket: np.ndarray, value: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The rows times ``w``."""
    out = np.zeros((len(offsets) - 1, w.shape[1]))
    some = np.flatnonzero(np.diff(offsets))
    a = 0
    while a < len(some):
        z = max(a + 1, int(np.searchsorted(offsets[some], offsets[some[a]] + CELLS, "left")))
        lo, hi = offsets[some[a]], offsets[some[z - 1] + 1]
        out[some[a:z]] = np.add.reduceat(value[lo:hi, None] * w[bucket[lo:hi]], offsets[some[a:z]] - lo, axis=0)
        a = z
    return out


def _back(bucket: np.ndarray, value: np.ndarray, offsets: np.ndarray, y: np.ndarray, dim: int) -> np.ndarray:
    """The transposed rows times ``y``."""
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    return np.stack([np.bincount(bucket, weights=value * c[row], minlength=dim) for c in y.T], axis=1)


def projected(terms: pa.Array, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Texts times ``axes``; the cells of ``LOT`` texts are held at a time."""
    y = np.empty((len(terms), axes.shape[1]))
    for a in range(0, len(terms), LOT):
        y[a:a + LOT] = _times(*_rows(terms.slice(a, LOT), idf), axes)
    return y


@dataclass
class Encoder:
    """``idf`` of each bucket, ``axes`` (buckets x rank) and the singular values of the corpus."""

    idf: np.ndarray
    axes: np.ndarray
    values: np.ndarray

    def __call__(self, text, dim: int | None = None) -> Column:
        """A text as array<double> of the rank: an encoder for :func:`encode.embed_columns`."""
        idf, axes = self.idf, self.axes

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def project(terms: pa.Array) -> pa.Array:
            y = projected(terms, idf, axes)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * axes.shape[1], pa.int32()), pa.array(y.ravel()))

        return project.asNondeterministic()(term_counts(text, len(idf)))


def fit(docs: DataFrame, text: str, dim: int = DIM, rank: int = RANK, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = 14850) -> Encoder:
    """The encoder of a corpus. Fewer texts than ``rank`` leave the axes behind them zero."""
    spark = docs.sparkSession
    table = materialize(docs.select(term_counts(text, dim).alias("terms")), "terms", min_partition_bytes=linear.PARTITION_BYTES)
    n, idf = table.count(), np.ones(dim)
    found = table.select(F.explode("terms").alias("c")).groupBy(F.col("c.bucket").alias("b")).agg(F.count(F.lit(1)).alias("df")).collect()    # at most dim
    for r in found:
        idf[r.b] = np.log((1.0 + n) / (1.0 + r.df)) + 1.0
    columns = min(rank + oversample, dim)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, columns)))[0]
    tasks, fan = table.rdd.getNumPartitions(), max(2, min(linear.FAN_IN, SUM_BYTES // (8 * dim * columns)))

    def scan(w: np.ndarray, triangle: bool) -> DataFrame:
        """Per task: A'(A w), or with ``triangle`` also the R of its rows of A w, as rows (part, v, r)."""
        held = spark.sparkContext.broadcast((idf, w))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, w = held.value
            total, r = np.zeros(w.shape), np.zeros((0, w.shape[1]))
            for b in batches:
                for a in range(0, b.num_rows, LOT):
                    cells = _rows(b.column(0).slice(a, LOT), idf)
                    y = _times(*cells, w)
                    total += _back(*cells, y, len(idf))
                    if triangle:
                        r = np.linalg.qr(np.vstack([r, y]), mode="r")
                del b                                      # before the next batch is read
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary()),
                                              pa.array([r.tobytes()], pa.binary())], names=["part", "v", "r"])

        return table.mapInArrow(run, "part long, v binary, r binary")

    for _ in range(power):
        total = linear.tree_sum(scan(w, False).select("part", "v"), tasks, fan)
        if total is None:
            break
        w = np.linalg.qr(total.reshape(dim, columns))[0]
    last = materialize(scan(w, True), "products")          # two results of one scan
    total = linear.tree_sum(last.select("part", "v"), tasks, fan)
    if total is None:
        return Encoder(idf, np.zeros((dim, rank)), np.zeros(rank))
    r = _triangle(last.select("part", F.col("r").alias("v")), tasks, columns)
    b = np.linalg.pinv(r, rcond=1e-12).T @ total.reshape(dim, columns).T
    _, values, axes = np.linalg.svd(b, full_matrices=False)
    values, axes = np.where(values > 1e-10 * values.max(initial=0.0), values, 0.0), axes.T
    axes = axes * np.where(values > 0, np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]), 0.0)      # the largest entry is positive
    out = np.zeros((dim, rank)), np.zeros(rank)
    k = min(rank, axes.shape[1])
    out[0][:, :k], out[1][:k] = axes[:, :k], values[:k]
    return Encoder(idf, *out)


def _triangle(rows: DataFrame, tasks: int, columns: int) -> np.ndarray:
    """The R of all rows from the tasks' triangles."""
    def stacked(found: list[tuple[int, bytes]]) -> np.ndarray:
        return np.linalg.qr(np.vstack([np.frombuffer(v).reshape(-1, columns) for _, v in sorted(found, key=lambda x: x[0])]), mode="r")

    fan = linear.FAN_IN

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for part, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.setdefault(part // fan, []).append((part, v))
        for part, found in sorted(parts.items()):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([stacked(found).tobytes()], pa.binary())], names=["part", "v"])

    while tasks > fan:
        tasks = -(-tasks // fan)
        rows = rows.repartition(tasks, F.floor(F.col("part") / fan)).mapInArrow(reduce, "part long, v binary")
    return stacked([(r.part, r.v) for r in rows.collect()])                    # FAN_IN small triangles at most
