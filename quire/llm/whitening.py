"""Embedding whitening from a bit-sliced scatter matrix.

A component c of a vector counts as the whole number floor(scale * c). The fit
takes every distinct vector of whole numbers once. A task packs its vectors
bit plane by bit plane: each dimension is shifted by its smallest value in the
block, and bit ``a`` of a dimension becomes one bit per row in 64-bit words.
The sum of x_i * x_j over the rows is then the sum over pairs of planes of
2^(a+b) times the popcount of their AND, exact whatever the number of rows.
Sums leave the tasks as four limbs of 40 bits, so Spark's long sums stay exact
too; the driver gets d * (d + 1) / 2 of them for d dimensions, whatever the
input, centres them as integers (n * P - S * S') and only then divides.

Defined results: vectors that are null or hold null or non-finite components
are left out; a shorter vector counts with zeros behind (an empty one is all
zeros); numbers beyond a long saturate; repeated rows are returned each and
fitted once; a null vec_id is an id like any other. A component without
variance has a null ``whitened`` and takes no part in ``identity_error``; a
``deviation`` beyond a long is null. No usable vector, or none with a
component, gives no rows. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, store

SCALE, COMPONENTS = 256, 4
BLOCK = 1 << 14                       # rows whose bit planes are held at once
LIMB = 40


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of every component, null for a vector that takes no part."""
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))))


def usable_vectors(df: DataFrame, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """``keep`` columns and ``_x`` (whole numbers, zeros behind shorter vectors) of the rows that take part, and the dimensions."""
    rows = df.select(*keep, whole_numbers(F.col(vector), scale).alias("_x")).where(F.col("_x").isNotNull())
    d = rows.agg(F.max(F.size("_x"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("_x"))
    return rows.withColumn("_x", F.when(F.size("_x") < d, F.concat("_x", zeros)).otherwise(F.col("_x"))), d


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.asarray(column(batch, "_x").flatten()).astype(np.int64).reshape(-1, d)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of x_i * x_j and of x_i over the rows of ``x``, as Python integers, by AND and popcount of bit planes."""
    n, d = x.shape
    low = x.min(0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)                      # wraps to the right difference
    bits = [int(v).bit_length() for v in shifted.max(0)]
    dims = [i for i in range(d) if bits[i]]
    products, sums = np.zeros((d, d), object), np.zeros(d, object)
    if dims:
        of = np.repeat(dims, [bits[i] for i in dims])
        power = np.concatenate([np.arange(bits[i]) for i in dims])
        starts = np.cumsum([0] + [bits[i] for i in dims[:-1]])
        padded = np.zeros((len(of), -(-n // 64) * 64), np.uint8)
        for k, (i, a) in enumerate(zip(of, power, strict=True)):
            padded[k, :n] = (shifted[:, i] >> np.uint64(a)) & np.uint64(1)
        planes = np.packbits(padded, axis=1).view(np.uint64)
        counts = np.zeros((len(of), len(of)), np.int64)
        for k in range(len(of)):
            counts[k, k:] = np.bitwise_count(planes[k:] & planes[k]).sum(1, dtype=np.int64)
        counts = counts + np.triu(counts, 1).T
        kind = np.int64 if 2 * max(bits) + n.bit_length() < 62 else object     # weights beyond a long: Python integers
        weight = np.array([1 << int(a) for a in power], kind)
        rows = np.stack([(counts[s:s + bits[i]].astype(kind) * weight[s:s + bits[i], None]).sum(0)
                         for s, i in zip(starts, dims, strict=True)])
        products[np.ix_(dims, dims)] = np.add.reduceat(rows * weight, starts, axis=1).astype(object)
        sums[dims] = np.add.reduceat(np.diag(counts).astype(kind) * weight, starts).astype(object)
    low = np.array([int(v) for v in low], object)
    products = products + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return products, sums + n * low


def limbs(v: int) -> list[int]:
    """``v`` as three limbs of 40 bits and a signed rest."""
    return [v >> LIMB * k & (1 << LIMB) - 1 for k in range(3)] + [v >> 3 * LIMB]


def scatter(vectors: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and sums of products of the ``_x`` vectors; exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, products, sums = 0, np.zeros((d, d), object), np.zeros(d, object)
        for b in batches:
            x = matrix(b, d)
            for a in range(0, len(x), BLOCK):
                p, s = cross_products(x[a:a + BLOCK])
                products, sums, n = products + p, sums + s, n + len(x[a:a + BLOCK])
        if n:
            cells = [(i, j, *limbs(products[i, j])) for i in range(d) for j in range(i, d)]
            cells += [(-1, j, *limbs(sums[j])) for j in range(d)] + [(-1, -1, *limbs(n))]
            for a in range(0, len(cells), 100_000):
                part = list(zip(*cells[a:a + 100_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, [pa.int32()] * 2 + [pa.int64()] * 4, strict=True)],
                                                 names=["i", "j", "l0", "l1", "l2", "l3"])

    cells = vectors.select("_x").mapInArrow(run, "i int, j int, l0 long, l1 long, l2 long, l3 long")
    products, sums, n = np.zeros((d, d), object), np.zeros(d, object), 0
    for i, j, *parts in cells.groupBy("i", "j").agg(*[F.sum(f"l{k}") for k in range(4)]).collect():   # at most (d + 1)(d + 2) / 2
        v = sum(x << LIMB * k for k, x in enumerate(parts))
        if j < 0:
            n = v
        elif i < 0:
            sums[j] = v
        else:
            products[i, j] = products[j, i] = v
    return n, sums, products


@dataclass
class Whitening:
    n: int
    sums: np.ndarray                  # S, Python integers
    axes: np.ndarray                  # one unit eigenvector per column
    values: np.ndarray                # their eigenvalues, falling
    trace: float
    identity_error: float = 0.0

    @property
    def varies(self) -> np.ndarray:
        return self.values > len(self.axes) * np.finfo(float).eps * self.values.max(initial=0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they fit, else Python integers."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        fits = self.n * most + max(map(abs, self.sums), default=0) < 1 << 62
        return x * self.n - self.sums.astype(np.int64) if fits else x.astype(object) * self.n - self.sums

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Rows in whitened components; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred.astype(float) / self.n) @ self.axes / np.sqrt(np.maximum(self.values, 0))
        out[:, ~self.varies] = np.nan
        return out


def deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row, None beyond a long."""
    if not centred.size:
        return []
    if max(abs(int(centred.max())), abs(int(centred.min()))) ** 2 * centred.shape[1] < 1 << 63:
        return (centred.astype(np.int64) ** 2).sum(1).tolist()
    sums = [sum(v * v for v in row) for row in centred.tolist()]
    return [v if v < 1 << 63 else None for v in sums]


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``_x`` vectors, None when there are none."""
    distinct = store(vectors.select("_x").distinct(), "vectors")
    n, sums, products = scatter(distinct, d) if d else (0, None, None)
    if not n:
        return None
    centred = n * products - np.outer(sums, sums)                              # n^2 times the covariance, still integers
    covariance = np.array([[v / n ** 2 for v in row] for row in centred.tolist()])
    values, axes = np.linalg.eigh(covariance)
    w = Whitening(n, sums, axes[:, ::-1][:, :components].copy(), values[::-1][:components].copy(), float(np.trace(covariance)))
    k = int(w.varies.sum())
    names = [f"c{i}" for i in range(k)] + [f"c{i}_{j}" for i in range(k) for j in range(i, k)]
    if not k:
        return w
    held = distinct.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = held.value, np.zeros(len(names))
        for b in batches:
            y = w.project(w.centred(matrix(b, d)))[:, :k]
            total += np.concatenate([y.sum(0), (y.T @ y)[np.triu_indices(k)]])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=names)

    total = np.array(distinct.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()) / n
    measured = np.zeros((k, k))
    measured[np.triu_indices(k)] = total[k:]
    measured = np.triu(measured - np.outer(total[:k], total[:k]) - np.eye(k))
    w.identity_error = float(np.abs(measured).max())
    return w


def transform(rows: DataFrame, w: Whitening | None, d: int, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``keep``, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    fields = [T.StructField("deviation", T.LongType()), T.StructField("_w", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*rows.select(*keep).schema.fields, *fields])
    held = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for b in batches:
            if w is None or not b.num_rows:
                continue
            y = w.centred(matrix(b, d))
            z = w.project(y)
            white = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), white)
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in keep], pa.array(deviations(y), pa.int64()), white], names=schema.names)

    found = rows.select(*keep, "_x").mapInArrow(run, schema)
    found = found.select(*keep, "deviation", F.posexplode("_w").alias("_k", "whitened"))
    n, trace = (w.n, w.trace) if w else (0, 0.0)
    shares = [float(max(v, 0.0) / trace) if trace > 0 else 0.0 for v in w.values] if w else [0.0]
    return found.select(*keep, (F.col("_k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                        F.get(F.array(*[F.lit(s) for s in shares]), F.col("_k")).alias("explained"),
                        F.lit(w.identity_error if w else 0.0).alias("identity_error"))


def whiten(df: DataFrame, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """Fit on the distinct vectors of ``df`` and return every usable row in whitened components."""
    rows, d = usable_vectors(df, keep, vector, scale)
    return transform(rows, fit(rows, d, components), d, keep)
