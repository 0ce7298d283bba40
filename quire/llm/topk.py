"""Exact top-k inner products with vector-approximation files.

Vectors of whole numbers are quantised per dimension into 256 equal cells
between that dimension's smallest and largest value over all rows. The
approximation has one byte per component, made from the stored exact vectors
in each pass over them. A search scans the cells,
which bounds every score from both sides, keeps what can still be among the k
best, and then reads exact vectors in the order of their bounds until the kth
exact score is above every bound that is left.

The queries are taken in blocks of bounded size, each broadcast to all
partitions of the file; a partition returns at most k rows per query, and the
partitions' results are merged per query.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id; vectors with a whole number of more
than 28 bits have no cells: their bounds come from double precision, their
exact scores from Python integers, and a score beyond a long counts as the
largest (smallest) one; vectors meet only those of their own length; rows are
candidates each, so a repeated row
is listed repeatedly; rows that share the query's id are its own; a query id
on several different rows ranks the candidates of all of them together; ties
go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged_path
from .common import column, store

CELLS = 256
LARGEST = float(np.finfo(float).max)
BLOCK_QUERIES = 8192                  # queries in one broadcast block: 64 dimensions take 4 MB
ROWS = 4096                           # file rows compared at once
CHUNK = 512                           # queries compared at once
STEP = 32                             # exact vectors read at once for a query


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, and floor(scale * x) of each component of the rows that take part: as longs in ``v``, or
    as doubles in ``wide`` where one has more than 28 bits."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    part = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull() & part).select("vec_id", v.alias("x"))
    fits = F.forall("x", lambda x: F.abs(x) < (1 << 28) / scale)
    # a double of 2^53 or more is whole, so only numbers that fit a long need their floor; none reaches infinity
    wide = F.transform("x", lambda x: F.when(F.abs(x) < 2.0 ** 53, F.floor(F.when(F.abs(x) < 2.0 ** 53, x * scale).otherwise(0.0)).cast("double"))
                       .otherwise(F.greatest(F.least(x * scale, F.lit(LARGEST)), F.lit(-LARGEST))))
    return rows.select("vec_id", F.when(fits, F.transform("x", lambda x: F.floor(F.when(fits, x * scale).otherwise(0.0)))).alias("v"),
                       F.when(~fits, wide).alias("wide"))


def ranges(file: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> smallest and largest value of each dimension, over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for b in batches:
            for n, (_, x) in _by_length(b).items():
                low[n] = np.minimum(low[n], x.min(0)) if n in low else x.min(0)
                high[n] = np.maximum(high[n], x.max(0)) if n in high else x.max(0)
        for n in low:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, n), pa.int32()), pa.array(np.arange(n), pa.int32()),
                                              pa.array(low[n]), pa.array(high[n])], names=["n", "i", "low", "high"])

    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in (file.mapInArrow(run, "n int, i int, low long, high long").groupBy("n", "i")
              .agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()):
        low, high = out.setdefault(r.n, (np.zeros(r.n, np.int64), np.zeros(r.n, np.int64)))
        low[r.i], high[r.i] = r.low, r.high
    return out


def _by_length(b: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> row numbers and matrix of the batch's vectors ``v`` (those without are passed over)."""
    v = column(b, "v")
    if v.null_count:
        some = np.flatnonzero(np.asarray(v.is_valid()))
        return {n: (some[rows], x) for n, (rows, x) in _by_length(pa.RecordBatch.from_arrays([v.take(pa.array(some))], names=["v"])).items()}
    size = np.diff(np.asarray(v.offsets))
    if len(size) and (size == size[0]).all():
        return {int(size[0]): (np.arange(len(size)), np.asarray(v.flatten()).reshape(len(size), size[0]))}
    lists = v.to_pylist()
    return {int(n): (k := np.flatnonzero(size == n), np.array([lists[i] for i in k], np.int64).reshape(len(k), n))
            for n in np.unique(size)}


def approximate(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The cell of each component."""
    return ((x - low) * CELLS // (high - low + 1)).astype(np.uint8)


def cell_centres(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Width of a cell of each dimension, and the farthest a value can be from its cell's centre."""
    width = (high - low + 1) / CELLS
    return width, width / 2


def build_file(vectors: DataFrame, scale: int = 256) -> tuple[DataFrame, dict]:
    """The table vec_id, v, wide, cells (the approximation of v, made in each pass over the stored vectors) and its ranges."""
    whole = store(whole_numbers(vectors, scale), "vectors")
    held = ranges(whole)
    bounds = whole.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells: list = [b""] * b.num_rows
            for n, (rows, x) in _by_length(b).items():
                if n:
                    for i, c in zip(rows, approximate(x, *bounds.value[n]), strict=True):
                        cells[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.binary())], names=["vec_id", "v", "wide", "cells"])

    return whole.mapInArrow(run, "vec_id long, v array<long>, wide array<double>, cells binary"), held


LEAST = np.iinfo(np.int64).min + 1       # no score yet; can be negated


class _Best:
    """The k best (score, smaller id first) rows of each query so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.ids, self.q, self.k, self.low = ids, q, k, low
        self.width, half = cell_centres(low, high)
        self.q32 = q.astype(np.float32)
        # what a score can differ from that of the cells' centres, and what single precision can
        size = np.maximum(np.abs(low), np.abs(high)) + self.width
        self.slack = np.abs(q) @ half + 1 + (np.abs(q) @ size) * (len(low) + 4) * 2.0 ** -23
        self.score = np.full((len(ids), k), LEAST)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, vec: np.ndarray, cells: np.ndarray, exact: np.ndarray) -> None:
        centre = (self.low + (cells + 0.5) * self.width).astype(np.float32)
        place = self.k + int(np.unique(vec, return_counts=True)[1].max())     # a query's own rows don't count
        for a in range(0, len(self.ids), CHUNK):
            rows = slice(a, a + CHUNK)
            near = self.q32[rows] @ centre.T               # scores of the cells' centres
            kth = np.full(len(near), -np.inf)
            if near.shape[1] >= place:                     # the kth best lower bound
                kth = np.partition(near, -place, axis=1)[:, -place] - self.slack[rows]
            kth = np.maximum(kth, self.score[rows, -1])
            may = near + self.slack[rows, None] >= kth[:, None]
            for i in np.flatnonzero(may.any(1)):
                self._read(a + i, np.flatnonzero(may[i]), near[i], vec, exact)

    def _read(self, i: int, rows: np.ndarray, near: np.ndarray, vec: np.ndarray, exact: np.ndarray) -> None:
        """Exact vectors by falling upper bound, until no bound reaches the kth exact score."""
        rows = rows[vec[rows] != self.ids[i]]
        rows = rows[np.argsort(-near[rows], kind="stable")]
        step = STEP
        while len(rows):
            if near[rows[0]] + self.slack[i] < self.score[i, -1]:
                return
            now, rows = rows[:step], rows[step:]
            step *= 4
            s = np.concatenate([self.score[i], exact[now] @ self.q[i]])
            v = np.concatenate([self.vec[i], vec[now]])
            best = np.lexsort((v, -s))[:self.k]
            self.score[i], self.vec[i] = s[best], v[best]


MOST = np.iinfo(np.int64).max


class _Exact:
    """The k best rows of each query among pairs with a wide vector: double precision bounds, Python integers decide."""

    def __init__(self, ids: list[int], q: list[list], k: int):
        self.ids, self.k = ids, k
        self.whole = [[int(x) for x in v] for v in q]
        self.q = np.array(q, float).reshape(len(q), -1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]             # (-score, id), ascending

    def scan(self, vec: list[int], vectors: list[list]) -> None:
        x = np.array(vectors, float).reshape(len(vectors), -1)
        for a in range(0, len(self.ids), CHUNK):
            with np.errstate(over="ignore", invalid="ignore"):
                near = self.q[a:a + CHUNK] @ x.T
                slack = (np.abs(self.q[a:a + CHUNK]) @ np.abs(x.T)) * (x.shape[1] + 4) * 2.0 ** -52
                upper = near + slack
            for i in range(len(near)):
                self._read(a + i, np.where(np.isnan(upper[i]), np.inf, upper[i]), vec, vectors)

    def _read(self, i: int, upper: np.ndarray, vec: list[int], vectors: list[list]) -> None:
        for j in np.argsort(-upper, kind="stable").tolist():
            best = self.best[i]
            if len(best) == self.k and upper[j] < float(-best[-1][0]) * (1 - 2.0 ** -52 if best[-1][0] < 0 else 1 + 2.0 ** -52):
                return
            if vec[j] != self.ids[i]:
                score = sum(a * int(b) for a, b in zip(self.whole[i], vectors[j], strict=True))
                self.best[i] = sorted([*best, (-min(max(score, int(LEAST)), int(MOST)), vec[j])])[:self.k]


def search(file: DataFrame, bounds: dict, is_query: Column, k: int = 5,
           block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row of the
    file where ``is_query`` holds."""
    spark = file.sparkSession
    queries = store(file.where(is_query).select("vec_id", "v", "wide").distinct(), "queries")
    limits = spark.sparkContext.broadcast(bounds)
    held, folder, n = None, staged_path(spark, "nearest"), 0
    for rows in _blocks(queries, block_queries):
        if held is not None:                               # one of several blocks: stored before the next
            _nearest(file, held, limits, k).write.parquet(f"{folder}/block={n}")
            n += 1
        held = rows
    if held is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    last = _nearest(file, held, limits, k)
    if not n:
        return last
    last.write.parquet(f"{folder}/block={n}")
    found = spark.read.schema(last.schema).parquet(folder).select("query_id", "vec_id", "score")
    return _ranked(found, k)                                 # a query id on several rows may stand in two blocks


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _nearest(file: DataFrame, rows: tuple[dict, dict], limits, k: int) -> DataFrame:
    """The k best rows for one block of queries: k rows per query and partition, merged per query."""
    held = file.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow, wide = held.value
        best: dict[int, _Best] = {}
        exact: dict[tuple, _Exact] = {}

        def against(queries: dict, kind: str, n: int, vec: list[int], vectors: list[list]) -> None:
            """Pairs with a wide vector on one side at least; a few rows at a time."""
            if n in queries:
                if (kind, n) not in exact:
                    exact[kind, n] = _Exact([int(i) for i in queries[n][0]], [list(v) for v in queries[n][1]], k)
                for a in range(0, len(vec), ROWS):
                    exact[kind, n].scan(vec[a:a + ROWS], vectors[a:a + ROWS])

        for b in batches:
            ids = np.asarray(column(b, "vec_id"))
            cells = column(b, "cells").to_pylist()
            if column(b, "wide").null_count < b.num_rows:
                lists: dict[int, list] = {}
                for i, v in zip(ids.tolist(), column(b, "wide").to_pylist(), strict=True):
                    if v is not None:
                        lists.setdefault(len(v), []).append((i, v))
                for n, found in lists.items():
                    for kind, queries in (("narrow", narrow), ("wide", wide)):
                        against(queries, kind, n, [i for i, _ in found], [v for _, v in found])
            for n, (rows, x) in _by_length(b).items():
                if n in wide:
                    against(wide, "wide", n, ids[rows].tolist(), x.tolist())
                if n not in narrow:
                    continue
                if n not in best:
                    best[n] = _Best(*narrow[n], *limits.value.get(n, (np.zeros(0, np.int64),) * 2), k)
                for a in range(0, len(rows), ROWS):
                    at = rows[a:a + ROWS]
                    c = np.frombuffer(b"".join(cells[i] for i in at), np.uint8).reshape(len(at), n)
                    best[n].scan(ids[at], c, x[a:a + ROWS])
        for t in best.values():
            i, j = np.nonzero(t.score > LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(t.ids[i]), pa.array(t.vec[i, j]), pa.array(t.score[i, j])],
                                             names=["query_id", "vec_id", "score"])
        for e in exact.values():
            found = [(q, i, -s) for q, own in zip(e.ids, e.best, strict=True) for s, i in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return _ranked(file.mapInArrow(run, "query_id long, vec_id long, score long"), k)


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[dict, dict]]:
    """Length -> ids and matrix of longs, and of doubles (wide vectors), at most ``size`` queries at a time on the driver."""
    def grouped(rows: list) -> tuple[dict, dict]:
        out = []
        for name, kind in (("v", np.int64), ("wide", float)):
            by: dict[int, list] = {}
            for r in rows:
                if r[name] is not None:
                    by.setdefault(len(r[name]), []).append(r)
            out.append({n: (np.array([r.vec_id for r in x], np.int64), np.array([r[name] for r in x], kind).reshape(len(x), n)) for n, x in by.items()})
        return tuple(out)

    rows: list = []
    for r in queries.toLocalIterator(prefetchPartitions=False):
        rows.append(r)
        if len(rows) == size:
            yield grouped(rows)
            rows = []
    if rows:
        yield grouped(rows)
