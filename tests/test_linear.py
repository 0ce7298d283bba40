"""M4, M7, M8: the block and the stochastic solver against fits in plain Python."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quire.operators import classify, linear
from quire.plans import ablation


def plain_loss(name, p, y):
    z, r = y * p, p - y
    a = abs(r)
    return {"hinge": max(0, 1 - z), "log_loss": math.log1p(math.exp(-z)) if z > -30 else -z, "perceptron": max(0, -z),
            "modified_huber": max(0, 1 - z) ** 2 if z >= -1 else -4 * z, "squared_hinge": max(0, 1 - z) ** 2, "squared_error": r * r / 2,
            "huber": r * r / 2 if a <= .1 else .1 * a - .005, "epsilon_insensitive": max(0, a - .1),
            "squared_epsilon_insensitive": max(0, a - .1) ** 2}[name]


@pytest.mark.parametrize("name", linear.LOSSES)
def test_losses_and_their_derivatives(name):
    f = linear.LOSSES[name][0]
    p = np.array([-3.3, -1.04, -0.97, -0.3, 0.04, 0.31, 0.93, 0.96, 1.07, 2.9])
    for y in (-1.0, 1.0):
        value, slope = f(p, np.full_like(p, y))
        assert np.allclose(value, [plain_loss(name, x, y) for x in p], atol=1e-12)
        assert np.allclose(slope, [(plain_loss(name, x + 1e-6, y) - plain_loss(name, x - 1e-6, y)) / 2e-6 for x in p], atol=1e-5)


def data(n=600, d=6, k=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 1.2
    y = rng.integers(0, k, n)
    return centres[y] + rng.normal(size=(n, d)), y


def frame(spark, x, y, parts=3):
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, code long").repartition(parts)


def objective(name, x, t, w, b, alpha):
    return float(np.mean([plain_loss(name, p, c) for p, c in zip(x @ w + b, t, strict=True)]) + alpha / 2 * w @ w)


def plain_descent(name, x, t, alpha, steps=4000):
    """The lowest objective of a long full-batch subgradient descent, best point kept."""
    w, b, best = np.zeros(x.shape[1]), 0.0, math.inf
    for k in range(steps):
        value, slope = linear.LOSSES[name][0](x @ w + b, t)
        best = min(best, float(value.mean() + alpha / 2 * w @ w))
        eta = 0.2 / linear.LOSSES[name][1] / math.sqrt(1 + k / 20)
        w, b = w - eta * (slope @ x / len(x) + alpha * w), b - eta * slope.mean()
    return best


@pytest.mark.parametrize("name", [n for n in linear.LOSSES if n != "perceptron"])
def test_stochastic_solver_reaches_the_minimum(spark, name):
    """Within 3 % (0.004 where the minimum is small) of what a single machine reaches by full batches."""
    x, y = data()
    m = linear.fit_sgd(frame(spark, x, y), F.col("id"), F.col("x"), F.col("code"), [name], alpha=1e-3, tol=0.0, max_iter=60, shards=3, batches=20)[name]
    assert m.codes == [0, 1, 2, 3] and m.rounds == 60
    for c in m.codes:
        t = np.where(y == c, 1.0, -1.0)
        least = plain_descent(name, x, t, 1e-3)
        assert objective(name, x, t, m.weights[c], m.intercepts[c], 1e-3) <= 1.03 * least + 0.004, (c, least)


def test_perceptron_separates_what_can_be_separated(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    x = np.eye(3)[y] * 6 + rng.normal(size=(300, 3)) * 0.5
    m = linear.fit_sgd(frame(spark, x, y), F.col("id"), F.col("x"), F.col("code"), ["perceptron"], alpha=0.0, max_iter=20)["perceptron"]
    assert (np.argmax(x @ m.weights.T + m.intercepts, axis=1) == y).mean() > 0.97


def plain_shards(ids, x, y, name, shards, batches, epochs, eta0, alpha, seed):
    """The stochastic solver, a class at a time, in plain loops."""
    import hashlib
    h = [hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in ids]
    place = [(int(v[:8], 16) % shards, int(v[8:16], 16) % batches) for v in h]
    out, kept = {}, {c: [] for c in set(y)}
    for c in kept:
        t, start = np.where(y == c, 1.0, -1.0), np.zeros(x.shape[1] + 1)
        for epoch in range(epochs):
            total, rows = 0, 0
            for s in range(shards):
                w = start.copy()
                for b in range(batches):
                    own = [i for i, p in enumerate(place) if p == (s, b)]
                    if own:
                        z = np.hstack([x[own], np.ones((len(own), 1))])
                        slope = linear.LOSSES[name][0](z @ w, t[own])[1]
                        w = w - eta0 / math.sqrt(1 + (epoch * batches + b) / batches) * (slope @ z / len(own) + alpha * np.append(w[:-1], 0))
                n = sum(p[0] == s for p in place)
                total, rows = total + n * w, rows + n
            start = total / rows
            kept[c].append(start)
        out[c] = np.mean(kept[c][epochs // 2:], axis=0)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_stochastic_steps_do_not_depend_on_tasks(spark, parts):
    x, y = data(200, 4, 3, seed=5)
    m = linear.fit_sgd(frame(spark, x, y, parts), F.col("id"), F.col("x"), F.col("code"), ["hinge", "huber"], alpha=1e-2, tol=0.0, max_iter=4,
                       shards=4, batches=30, eta0=0.3, seed=7)
    for name in ("hinge", "huber"):
        want = plain_shards(range(200), x, y, name, 4, 30, 4, 0.3, 1e-2, 7)
        for c in m[name].codes:
            assert np.allclose(np.append(m[name].weights[c], m[name].intercepts[c]), want[c], atol=1e-10)


SMOOTH = [n for n, (_, _, smooth) in linear.LOSSES.items() if smooth]


@pytest.mark.parametrize("name", SMOOTH)
def test_all_classes_at_once_equal_separate_fits(spark, name):
    x, y = data()
    table = linear.training_rows(frame(spark, x, y), F.col("x"), F.col("code"))
    sets = {"all": [(0, 6)], "ends": [(0, 2), (5, 6)]}
    together = linear.fit_block(table, name, alpha=1e-2, tol=1e-14, max_iter=200, sets=sets)
    for set_name, ranges in sets.items():
        m = together[set_name]
        outside = [j for j in range(6) if not any(a <= j < z for a, z in ranges)]
        assert not m.weights[:, outside].any()
        for c in range(4):
            t = np.where(y == c, 1.0, -1.0)
            two = linear.training_rows(frame(spark, x, (y == c).astype(int)), F.col("x"), F.col("code")) if c == 1 else None
            if two is not None:                            # one binary problem alone
                alone = linear.fit_block(two, name, alpha=1e-2, tol=1e-14, max_iter=200, sets={set_name: ranges})[set_name]
                assert np.abs(alone.weights[1] - m.weights[c]).max() < 1e-6 and abs(alone.intercepts[1] - m.intercepts[c]) < 1e-6
            value, slope = linear.LOSSES[name][0](x @ m.weights[c] + m.intercepts[c], t)
            grad = slope @ x / len(x) + 1e-2 * m.weights[c]
            grad[outside] = 0
            assert np.abs(grad).max() < 1e-5 and abs(slope.mean()) < 1e-5     # the minimum, by its gradient
    with pytest.raises(ValueError):
        linear.fit_block(table, "hinge")


def test_block_fit_agrees_with_spark_ml(spark):
    x, y = data()
    df = frame(spark, x, y)
    m = linear.fit_block(linear.training_rows(df, F.col("x"), F.col("code")), "log", alpha=1e-2, tol=1e-12, max_iter=200)["all"]
    for c in (0, 3):
        two = df.select(array_to_vector("x").alias("features"), (F.col("code") == c).cast("int").alias("label"))
        lr = LogisticRegression(regParam=1e-2, tol=1e-12, maxIter=200, standardization=False).fit(two)
        assert np.abs(lr.coefficients.toArray() - m.weights[c]).max() < 1e-4 and abs(lr.intercept - m.intercepts[c]) < 1e-4


def test_jobs_do_not_grow_with_classes(spark):
    sc, jobs, rounds = spark.sparkContext, [], []
    for k in (2, 12):
        x, y = data(400, 5, k, seed=3)
        table = linear.training_rows(frame(spark, x, y), F.col("x"), F.col("code"))
        table.count()
        sc.setJobGroup(f"fit-{k}", "fit")
        m = linear.fit_block(table, "squared_error", alpha=0.1, tol=1e-10, max_iter=30)["all"]
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"fit-{k}")))
        rounds.append(m.rounds)
        assert len(m.codes) == k
    sc.setJobGroup("", "")
    per_round = [(j - 4) / r for j, r in zip(jobs, rounds, strict=True)]
    assert max(per_round) <= 2 and abs(per_round[0] - per_round[1]) < 0.5, (jobs, rounds)


def test_many_tasks_go_through_a_tree(spark, monkeypatch):
    x, y = data(300)
    few = linear.fit_block(linear.training_rows(frame(spark, x, y, 1), F.col("x"), F.col("code")), alpha=1e-2, tol=1e-12)["all"]
    monkeypatch.setattr(linear, "FAN_IN", 3)
    many = linear.fit_block(linear.training_rows(frame(spark, x, y, 12), F.col("x"), F.col("code")), alpha=1e-2, tol=1e-12)["all"]
    assert np.allclose(few.weights, many.weights, atol=1e-7)


def test_odd_training_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 2), (3, [0.1, 1.0], 2), (4, None, 0), (5, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, code long")
    m = linear.fit_block(linear.training_rows(df, F.col("x"), F.col("code")), alpha=1e-2)["all"]
    got = df.where("x is not null").select("id", m.scores(F.col("x")).alias("s")).collect()
    assert m.codes == [0, 2] and all(len(r.s) == 3 and r.s[1] == linear.NO_CLASS for r in got)
    assert [int(np.argmax(r.s)) for r in got if r.id < 4] == [0, 2, 2]
    with pytest.raises(ValueError, match="no training rows"):
        linear.fit_block(linear.training_rows(df.limit(0), F.col("x"), F.col("code")))
    with pytest.raises(ValueError, match="differ"):
        linear.fit_block(linear.training_rows(df.union(spark.createDataFrame([(9, [1.0], 1)], df.schema)), F.col("x"), F.col("code")))
    with pytest.raises(ValueError, match="not one of"):
        classify.ClassifierSpec(loss="cosine").one_vs_rest_solver()


def test_ablation_scores_equal_single_fits(spark):
    x, y = data(300)
    df = frame(spark, x, y).select("id", F.slice("x", 1, 2).alias("a"), F.slice("x", 3, 4).alias("b"), "code",
                                   F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    spec = classify.ClassifierSpec(alpha=1e-2, tol=1e-12, max_iter=100)
    got = {r.feature_set: r for r in ablation.run_ablation(df, {"a": ["a"], "both": ["b", "a"]}, spec).collect()}
    for name, blocks in (("a", ["a"]), ("both", ["b", "a"])):
        v = df.withColumn("features", array_to_vector(F.concat(*blocks)))
        want = classify.train_test(v.where("split = 'train'"), v.where("split = 'test'"), classify.ClassifierSpec(alpha=1e-2, tol=1e-12, max_iter=100, solver="ml")).first()
        assert (got[name].n, got[name].n_unseen) == (75, 0) and got[name].top1 == pytest.approx(want.top1, abs=0.02)
        assert got[name].loglikelihood == pytest.approx(want.loglikelihood, rel=1e-3)
