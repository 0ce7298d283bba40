"""Operator 5 against all exact products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import queries, topk


def plain(rows, k, every):
    """(query, rank, id, score) by integer products held within longs, rows that share the id left out, ties to the smaller id."""
    most = (1 << 63) - 1
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        found = []
        for vec in {tuple(v) for i, v in usable if i == q}:
            found += [(max(-most, min(most, -sum(a * b for a, b in zip(vec, v, strict=True)))), i) for i, v in usable if i != q and len(v) == len(vec)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def run(spark, rows, k=5, every=50, parts=3, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    file, bounds = topk.build_file(df)
    got = topk.search(file, bounds, F.col("vec_id") % every == 0, k, **more)
    return sorted(tuple(r) for r in got.collect())


def test_query(spark, sf_middle):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_middle}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op5_topk(spark, sf_middle).collect()) == plain(rows, 5, 50)


@pytest.mark.parametrize("block", [topk.BLOCK_QUERIES, 3])
def test_ties_repeats_and_odd_vectors(spark, block):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=8).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]                      # one very common vector
    rows += [(2000, [0.5] * 8), (2000, [0.5] * 8), (2000, [1.0] * 8), (2001, [1.0] * 8), (2001, [1.0] * 8)]
    rows += [(3000, None), (3050, [None] * 8), (3100, [float("nan")] * 8), (3150, [float("inf")] + [0.0] * 7), (None, [9.0] * 8),
             (3200, [1.0, 2.0]), (3201, [0.5, 0.5]), (3250, [1e30] * 8), (3300, []), (3301, []), (3350, [1.0] * 3)]
    assert run(spark, rows, block_queries=block) == plain(rows, 5, 50)


def test_large_values_take_part(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * float(rng.choice([1, 1e3, 3e6, 1e7]))).tolist()) for i in range(500)]
    rows += [(501, [2.0 ** 21, 0.0, 0.0, 0.0]), (550, [2.0 ** 29, 0.5, 0.0, -1.0]), (551, [2.0 ** 29, 0.5, 0.0, -1.0]), (600, [1e300] * 4), (601, [-1e300] * 4),
             (602, [2.0 ** 53 + 2, 0.1, -0.1, 2.0 ** 20 - 0.001])]
    got = run(spark, rows)
    assert got == plain(rows, 5, 50)


def test_wide_cells_stay_exact(spark):
    """Values spread over a million: many whole numbers share a cell, so bounds are loose and exact vectors decide."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_t(1.5, size=6) * 300).clip(-4000, 4000).tolist()) for i in range(3000)]
    assert run(spark, rows, k=7) == plain(rows, 7, 50)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 2.0]), (2, [-3.0, 1.0])]
    assert run(spark, rows) == plain(rows, 5, 50)
    assert run(spark, [(0, [1.0])]) == []
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    file, bounds = topk.build_file(df)
    assert topk.search(file, bounds, F.col("vec_id") % 50 == 0).count() == 0
