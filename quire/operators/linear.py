"""One-vs-rest linear classifiers, all binary problems in one pass (M4, M7, M8).

A *problem* is one class of one feature set under one loss. The feature sets
are ranges of one stored vector column, so the weights of all problems are the
rows of one matrix: a task multiplies its block of rows with that matrix, takes
the derivatives of all losses at once and multiplies back. Each iteration is
one scan of the table and one sum over tasks, however many classes and feature
sets there are. Sums of many tasks go through a tree, so the driver gets a few
matrices of (problems x features) numbers.

:func:`fit_block` minimises the smooth losses by L-BFGS. Every problem keeps its own
search on the driver; the points that all of them ask for are one evaluation.

:func:`fit_sgd` is the stochastic solver, for all nine losses. Rows are dealt to
shards and mini-batches by a seeded hash of their key. In an epoch each shard
takes its mini-batches in order, a step of the mean subgradient of each, with
``eta0 / sqrt(1 + t / batches)`` as the step in its t-th update; at its end the
shards' weights are averaged, weighted by their rows. The result is the mean
over the later half of the epochs. Shards are a matter of the data, not of the
tasks: any number of tasks gives the same weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .ordering import seeded_hash

EPSILON = 0.1                         # fixed value: the tube of the huber and epsilon-insensitive losses
BLOCK_BYTES = 1 << 20                 # of a block of rows
PARTITION_BYTES = 4 << 20             # stored bytes per task of an iteration, at least
FAN_IN = 64                           # matrices that one task, or the driver, sums
NO_CLASS = -1e3                       # the margin of a code without training rows: probability 0


def _log(p, y):
    z = y * p
    return np.logaddexp(0.0, -z), -y / (1.0 + np.exp(np.minimum(z, 700.0)))


def _hinge(p, y):
    z = 1.0 - y * p
    return np.maximum(z, 0.0), np.where(z > 0, -y, 0.0)


def _perceptron(p, y):
    z = -y * p
    return np.maximum(z, 0.0), np.where(z >= 0, -y, 0.0)


def _squared_hinge(p, y):
    z = np.maximum(1.0 - y * p, 0.0)
    return z * z, -2.0 * y * z


def _modified_huber(p, y):
    z = y * p
    inner = np.maximum(1.0 - z, 0.0)
    return np.where(z >= -1.0, inner * inner, -4.0 * z), np.where(z >= -1.0, -2.0 * y * inner, -4.0 * y)


def _squared_error(p, y):
    r = p - y
    return 0.5 * r * r, r


def _huber(p, y):
    r = p - y
    a = np.abs(r)
    return np.where(a <= EPSILON, 0.5 * r * r, EPSILON * a - 0.5 * EPSILON ** 2), np.clip(r, -EPSILON, EPSILON)


def _tube(p, y):
    r = p - y
    z = np.maximum(np.abs(r) - EPSILON, 0.0)
    return z, np.where(z > 0, np.sign(r), 0.0)


def _squared_tube(p, y):
    r = p - y
    z = np.maximum(np.abs(r) - EPSILON, 0.0)
    return z * z, 2.0 * np.sign(r) * z


#: name -> (value and derivative by the score p for y in {-1, 1}, bound of the curvature (a step scale where it has none), smooth)
LOSSES: dict[str, tuple[Callable, float, bool]] = {
    "hinge": (_hinge, 0.25, False), "log_loss": (_log, 0.25, True), "modified_huber": (_modified_huber, 2.0, True),
    "squared_hinge": (_squared_hinge, 2.0, True), "perceptron": (_perceptron, 0.25, False),
    "squared_error": (_squared_error, 1.0, True), "huber": (_huber, 0.1, True),
    "epsilon_insensitive": (_tube, 0.25, False), "squared_epsilon_insensitive": (_squared_tube, 2.0, True),
}


def loss_name(name: str) -> str:
    name = {"log": "log_loss"}.get(name, name)
    if name not in LOSSES:
        raise ValueError(f"loss {name!r} is not one of {', '.join(LOSSES)}")
    return name


@dataclass
class LinearModel:
    """Weights of the classes ``codes`` of one feature set (a row each), and their intercepts."""

    codes: list[int]
    weights: np.ndarray
    intercepts: np.ndarray
    features: str = "features"
    rounds: int = 0                   # scans of the training table

    def scores(self, features=None) -> Column:
        """Margins by code, ``array<double>``; a code without training rows has ``NO_CLASS``."""
        w, b, codes, k = self.weights.T, self.intercepts, self.codes, max(self.codes) + 1

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def margins(x: pd.Series) -> pd.Series:
            out = np.full((len(x), k), NO_CLASS)
            if len(x):
                out[:, codes] = np.stack(list(x)) @ w + b
            return pd.Series(list(out), dtype=object)

        return margins(features if features is not None else vector_to_array(self.features))  # a column of its own: no lambda may hold it

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``rawPrediction`` (vector of margins) and ``prediction`` (the code of the largest, ties to the smaller code)."""
        out = df.withColumn("_raw", self.scores())
        best = (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector("_raw"), "prediction": best}).drop("_raw")


def training_rows(train: DataFrame, features: Column, label: Column, *more: Column) -> DataFrame:
    """``_x`` (array<double>) and ``_y`` (code) of the rows that have both."""
    rows = train.select(features.alias("_x"), label.cast("int").alias("_y"), *more)
    return rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())


def _blocks(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(batch.column(batch.schema.get_field_index("_x")).flatten()).astype(float).reshape(-1, width)
    return x, np.asarray(batch.column(batch.schema.get_field_index("_y"))).astype(np.int32)


def packed_rows(table: DataFrame, width: int) -> DataFrame:
    """``x``, ``y``: blocks of rows as the bytes of a matrix and of its codes, stored;
    iterations then read a cell per megabyte instead of a list per row."""
    size = max(1, BLOCK_BYTES // (8 * max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, size):
                x, y = _blocks(b.slice(a, size), width)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (x, y)], names=["x", "y"])

    return materialize(table.select("_x", "_y").mapInArrow(run, "x binary, y binary"), "blocks", min_partition_bytes=PARTITION_BYTES)


def tree_sum(rows: DataFrame, tasks: int, fan: int | None = None) -> np.ndarray | None:
    """The sum of the float64 vectors ``v`` (binary) that ``tasks`` tasks yield with their number ``part``, in that order."""
    fan = fan or FAN_IN

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for part, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.setdefault(part // fan, []).append((part, np.frombuffer(v)))
        for part, vs in sorted(total.items()):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([_ordered(vs).tobytes()], pa.binary())], names=["part", "v"])

    while tasks > fan:
        tasks = -(-tasks // fan)
        rows = rows.repartition(tasks, F.floor(F.col("part") / fan)).mapInArrow(add, "part long, v binary")
    got = [(r.part, np.frombuffer(r.v)) for r in rows.collect()]               # ``fan`` matrices at most
    return _ordered(got) if got else None


def _ordered(vs: list[tuple[int, np.ndarray]]) -> np.ndarray:
    return np.sum([v for _, v in sorted(vs, key=lambda x: x[0])], axis=0)


@dataclass
class Problems:
    """The binary problems of a fit: class code, loss and features (True where used) of each."""

    codes: np.ndarray
    losses: list[str]
    masks: np.ndarray

    def part(self, rows: np.ndarray) -> Problems:
        return Problems(self.codes[rows], [self.losses[i] for i in rows], self.masks[rows])

    def derivatives(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and derivatives of all losses for a block of rows, [row, problem]."""
        p = x @ w.T + b
        target = np.where(y[:, None] == self.codes[None, :], 1.0, -1.0)
        if len(set(self.losses)) == 1:
            return LOSSES[self.losses[0]][0](p, target)
        value, slope = np.empty_like(p), np.empty_like(p)
        for name in set(self.losses):
            own = [i for i, n in enumerate(self.losses) if n == name]
            value[:, own], slope[:, own] = LOSSES[name][0](p[:, own], target[:, own])
        return value, slope


def block_gradient(table: DataFrame, tasks: int, n: int, width: int, problems: Problems, w: np.ndarray, b: np.ndarray,
                   alpha: float, intercept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Objective (mean loss + alpha / 2 * |w|^2) of every problem with its gradients by weights and intercepts: one scan of packed rows."""
    held = table.sparkSession.sparkContext.broadcast((problems, w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        problems, w, b = held.value
        total = np.zeros((len(w), width + 2))
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = np.frombuffer(x).reshape(-1, width), np.frombuffer(y, np.int32)
                value, slope = problems.derivatives(x, y, w, b)
                total[:, 0] += value.sum(0)
                total[:, 1] += slope.sum(0)
                total[:, 2:] += slope.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    total = tree_sum(table.mapInArrow(run, "part long, v binary"), tasks)
    held.unpersist()
    total = total.reshape(len(w), width + 2) / max(n, 1)
    grad = np.where(problems.masks, total[:, 2:] + alpha * w, 0.0)
    return total[:, 0] + 0.5 * alpha * (w * w).sum(1), grad, total[:, 1] * intercept


def _search(x: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with backtracking: yields the points it needs, is sent (value, gradient) there, returns the best one."""
    f, g = yield x
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if not np.any(np.abs(g) > 1e-12):
            break
        d, held = -g, []
        for s, y, rho in reversed(steps):
            a = rho * (s @ d)
            d = d - a * y
            held.append(a)
        if steps:
            s, y, _ = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, rho), a in zip(steps, reversed(held), strict=True):
            d = d + (a - rho * (y @ d)) * s
        slope, step = g @ d, 1.0 if steps else min(1.0, 1.0 / np.linalg.norm(g))
        if slope >= 0:                                     # rounding has spoiled the memory: start anew
            steps, d, slope, step = [], -g, -(g @ g), min(1.0, 1.0 / np.linalg.norm(g))
        while True:
            new = x + step * d
            f_new, g_new = yield new
            if f_new <= f + 1e-4 * step * slope:
                break
            # the minimum of the parabola through what is known, within bounds
            step = min(max(-slope * step * step / (2 * (f_new - f - slope * step)), 0.1 * step), 0.5 * step)
            if step < 1e-12:
                return x
        s, y = new - x, g_new - g
        if s @ y > 1e-10 * (s @ s):
            steps = [*steps[1 - memory:], (s, y, 1.0 / (s @ y))]
        done = f - f_new <= tol * max(abs(f), abs(f_new), 1e-3)
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def _codes(table: DataFrame) -> tuple[list[int], int, int]:
    """Codes that occur, rows, and the width of the vectors; every row must have that width."""
    r = table.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("_x")).alias("a"), F.max(F.size("_x")).alias("z")).collect()   # one per class
    if not r:
        raise ValueError("no training rows")
    if len({x.a for x in r} | {x.z for x in r}) > 1:
        raise ValueError("feature vectors differ in length")
    return sorted(x._y for x in r), sum(x.n for x in r), r[0].a


def _problems(codes: list[int], width: int, losses: list[str], sets: dict[str, list[tuple[int, int]]]) -> Problems:
    masks = []
    for ranges in sets.values():
        m = np.zeros(width, bool)
        for a, z in ranges:
            m[a:z] = True
        masks.append(m)
    per = [(c, n, m) for n in losses for m in masks for c in codes]
    return Problems(np.array([c for c, _, _ in per]), [n for _, n, _ in per], np.array([m for _, _, m in per]))


def _models(codes, names, problems: Problems, w, b, features: str, rounds: int) -> dict[str, LinearModel]:
    k = len(codes)
    return {name: LinearModel(codes, np.where(problems.masks[i * k:(i + 1) * k], w[i * k:(i + 1) * k], 0.0), b[i * k:(i + 1) * k], features, rounds)
            for i, name in enumerate(names)}


def fit_block(table: DataFrame, loss: str = "log_loss", alpha: float = 1e-4, tol: float = 1e-6, max_iter: int = 50,
              fit_intercept: bool = True, sets: dict[str, list[tuple[int, int]]] | None = None, features: str = "features") -> dict[str, LinearModel]:
    """A model per feature set (name -> column ranges of ``_x``; all columns if not given), from the stored rows ``_x``, ``_y``."""
    loss = loss_name(loss)
    if not LOSSES[loss][2]:
        raise ValueError(f"{loss} has no gradient everywhere: use fit_sgd")
    codes, n, width = _codes(table)
    sets = sets or {"all": [(0, width)]}
    problems = _problems(codes, width, [loss], sets)
    blocks = packed_rows(table, width)
    tasks, rounds = blocks.rdd.getNumPartitions(), 0
    points = np.zeros((len(problems.codes), width + 1))
    searches = [_search(p, max_iter, tol) for p in points]
    asked = {i: next(s) for i, s in enumerate(searches)}
    while asked:
        own = np.array(sorted(asked))
        at = np.stack([asked[i] for i in own])
        value, grad, slope = block_gradient(blocks, tasks, n, width, problems.part(own), at[:, :-1], at[:, -1], alpha, fit_intercept)
        rounds += 1
        for i, f, g in zip(own.tolist(), value, np.hstack([grad, slope[:, None]]), strict=True):
            try:
                asked[i] = searches[i].send((f, g))
            except StopIteration as done:
                points[i] = done.value
                del asked[i]
    return _models(codes, sets, problems, points[:, :-1], points[:, -1], features, rounds)


def shard_rows(train: DataFrame, key: Column, features: Column, label: Column, shards: int, batches: int, seed: int) -> DataFrame:
    """``_x``, ``_y``, ``_shard`` and ``_batch`` by the seeded hash of the key, stored with each shard in the order of its batches."""
    h = seeded_hash(key, seed)
    digits = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    rows = training_rows(train, features, label, F.pmod(digits(1), F.lit(shards)).cast("int").alias("_shard"),
                         F.pmod(digits(9), F.lit(batches)).cast("int").alias("_batch"), h.alias("_h"))
    rows = rows.repartition(shards, "_shard").sortWithinPartitions("_shard", "_batch", "_h")
    return materialize(rows.drop("_h"), "shards")


def fit_sgd(train: DataFrame, key: Column, features: Column, label: Column, losses: list[str], alpha: float = 1e-4, tol: float = 1e-3,
            max_iter: int = 50, fit_intercept: bool = True, shards: int | None = None, batches: int | None = None, eta0: float | None = None,
            seed: int = 1234, patience: int = 5, name: str = "features") -> dict[str, LinearModel]:
    """A model per loss. ``key`` deals out the rows and should be nearly unique. Without numbers given,
    a shard has about 100,000 rows and a mini-batch about 64. Stops when no problem's running
    loss has improved by ``tol`` in ``patience`` epochs, or after ``max_iter`` of them."""
    losses = [loss_name(x) for x in losses]
    r = training_rows(train, features, label).agg(F.count(F.lit(1)).alias("n"), F.avg(F.aggregate("_x", F.lit(0.0), lambda a, x: a + x * x)).alias("sq")).first()
    shards = shards or max(1, math.ceil(r.n / 100_000))
    batches = batches or max(1, math.ceil(r.n / shards / 64))
    table = shard_rows(train, key, features, label, shards, batches, seed)
    codes, n, width = _codes(table)
    problems = _problems(codes, width, losses, {"all": [(0, width)]})
    p = len(problems.codes)
    first = np.array([eta0 or 0.5 / (LOSSES[x][1] * max(r.sq + fit_intercept, 1e-12)) for x in problems.losses])[:, None]
    w, tasks = np.zeros((p, width + 1)), table.rdd.getNumPartitions()
    kept, best, stale, rounds = [], np.full(p, np.inf), 0, 0
    for epoch in range(max_iter):
        held = table.sparkSession.sparkContext.broadcast((problems, w, first))

        def run(batches_: Iterator[pa.RecordBatch], epoch: int = epoch, held=held) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            problems, start, first = held.value
            total = np.zeros((p, width + 3))               # running loss, rows, weights times rows
            state: dict = {"at": None}

            def update() -> None:
                """The step of the mini-batch that has ended."""
                eta = first / math.sqrt(1 + (epoch * batches + state["at"][1]) / batches)
                grad = state["grad"] / state["m"]
                grad[:, :width] += alpha * state["w"][:, :width]
                state["w"] = state["w"] - eta * grad

            def finish() -> None:
                """The weights of the shard that has ended."""
                total[:, 1] += state["n"]
                total[:, 2:] += state["w"] * state["n"]

            for batch in batches_:
                shard = np.asarray(batch.column(batch.schema.get_field_index("_shard"))).astype(np.int64)
                which = np.asarray(batch.column(batch.schema.get_field_index("_batch"))).astype(np.int64)
                cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(which) != 0)) + 1
                x, y = _blocks(batch, width)
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True):
                    if a == z:
                        continue
                    at = int(shard[a]), int(which[a])
                    if at != state["at"]:
                        if state["at"] is not None:
                            update()
                        if state["at"] is None or state["at"][0] != at[0]:
                            if state["at"] is not None:
                                finish()
                            state |= {"w": start.copy(), "n": 0}
                        state |= {"at": at, "m": 0, "grad": np.zeros_like(start)}
                    value, slope = problems.derivatives(x[a:z], y[a:z], state["w"][:, :width], state["w"][:, width])
                    total[:, 0] += value.sum(0)
                    state["grad"] = state["grad"] + np.hstack([slope.T @ x[a:z], fit_intercept * slope.sum(0)[:, None]])
                    state["m"] += z - a
                    state["n"] += z - a
            if state["at"] is not None:
                update()
                finish()
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

        total = tree_sum(table.mapInArrow(run, "part long, v binary"), tasks).reshape(p, width + 3)
        held.unpersist()
        w = total[:, 2:] / total[:, 1:2]
        kept.append(w)
        rounds += 1
        loss = total[:, 0] / n + 0.5 * alpha * (w[:, :width] ** 2).sum(1)
        stale = 0 if np.any(loss < best - tol) else stale + 1
        best = np.minimum(best, loss)
        if stale >= patience:
            break
    w = np.mean(kept[len(kept) // 2:], axis=0)
    return _models(codes, losses, problems, w[:, :width], w[:, width], name, rounds)
