"""Operator 12 against exact sums in Python integers."""

import math

import numpy as np
import pytest

from quire.llm import queries, whitening


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def check(rows, got, components=4):
    rows = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if usable(v)]
    d = max(len(x) for _, x in rows)
    rows = [(i, x + [0] * (d - len(x))) for i, x in rows]
    distinct = sorted({tuple(x) for _, x in rows})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    cov = np.array([[sum((n * a[i] - sums[i]) * (n * a[j] - sums[j]) for a in distinct) / n ** 3 for j in range(d)] for i in range(d)])
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    k = min(components, d)
    assert len(got) == len(rows) * k
    by_vector = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-4
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-6, abs=1e-9)
        by_vector.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened))
    want = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in rows)
    for c, found in by_vector.items():
        assert sorted((str(i), v) for i, v, _ in found) == want
    white = {}
    for r in got:
        white.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    return n, d, values, white


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op12_whitening(spark, sf).collect()
    check(rows, got)
    # projections: the covariance over the distinct vectors is the identity, and equals numpy's up to the sign
    x = {i: np.array([math.floor(256 * float(c)) for c in v], float) for i, v in rows}
    m = np.unique(np.stack(list(x.values())), axis=0)
    values, axes = np.linalg.eigh(np.cov(m.T, bias=True))
    for r in got[::7]:
        own = (x[r.vec_id] - m.mean(0)) @ axes[:, -r.component] / math.sqrt(values[-r.component])
        assert abs(abs(own) - abs(r.whitened)) < 1e-8


@pytest.mark.parametrize("large", [1, 3e4, 1e12])
def test_bit_planes_are_exact(large):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(130, 5)) * large * 100).astype(np.int64)
    x[:, 3] = -7
    x[0, 0], x[1, 0] = -(1 << 62), 1 << 62
    products, sums = whitening.cross_products(x)
    rows = x.tolist()
    assert [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)] == products.tolist()
    assert [sum(c) for c in zip(*rows, strict=True)] == sums.tolist()
    v = products[0, 0]
    assert sum(p << whitening.LIMB * k for k, p in enumerate(whitening.limbs(-v))) == -v


def run(spark, rows, parts=3, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component int, n string").repartition(parts)
    return whitening.whiten(df).collect()


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=6).round(2).tolist()) for i in range(90)]
    rows += [(100, [0.5] * 6)] * 40 + [(100, [-0.0, 0.001, 0.0, 0.0, 0.0, -0.001]), (None, [1.0] * 6), (None, None)]
    rows += [(7, [None] * 6), (7, [float("nan")] * 6), (8, [float("inf")] + [0.0] * 5), (9, []), (9, [0.25, 3.0])]
    got = run(spark, [(*r, 1, "x") for r in rows])
    n, d, values, white = check(rows, got)
    assert d == 6
    odd = [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 5.0])]
    got = run(spark, [(*r, 1, "x") for r in odd])
    assert len(got) == 6 and {r.deviation for r in got if r.vec_id == 1} == {None}


def test_no_variance_and_empty_tables(spark):
    got = run(spark, [(1, [2.0, 3.0], 1, "x"), (2, [2.0, 3.0], 1, "x")])
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)}
    line = run(spark, [(i, [float(i), 2.0 * i], 1, "x") for i in range(5)])   # one direction only
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert run(spark, []) == [] and run(spark, [(1, None, 1, "x"), (2, [], 1, "x")]) == []
    assert len(run(spark, [(1, [1.0], 1, "x"), (2, [3.0], 1, "x")], kind="float")) == 2
