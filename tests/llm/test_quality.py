"""Operator 1: moments, factors and held-out accuracy; odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import quality, queries


def test_statistics_of_odd_texts():
    for t in (b"", b" ", b"\n\n", b"x", "é".encode() * 10, b"a " * 200_000, b"\x00\xff"):
        x = quality.statistics(t)
        assert len(x) == quality.K and np.isfinite(x).all()


def gaussian_scores(x, y, at, toward_pooled=0.1, toward_identity=0.01):
    """The same model with numpy's covariance and determinant."""
    s = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    n = [(y == k).sum() for k in (0, 1)]
    pooled = (n[0] * s[0] + n[1] * s[1]) / len(y)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    z = np.full(len(at), np.log((n[1] + 1) / (n[0] + 1)))
    for k, sign in ((0, -1), (1, 1)):
        c = ((1 - toward_pooled) * s[k] + toward_pooled * pooled) / np.outer(scale, scale)
        c = (1 - toward_identity) * c + toward_identity * np.trace(c) / len(c) * np.eye(len(c))
        c = c * np.outer(scale, scale)
        d = at - x[y == k].mean(0)
        z += sign * -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def test_query_equals_plain_model_and_is_accurate(spark, sf_middle):
    docs = spark.read.parquet(f"{sf_middle}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_middle}/labels.parquet").collect()}
    x = np.array([quality.statistics((r.text or "").encode()) for r in docs])
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs])
    train = np.array([not h and r.doc_id in labels for r, h in zip(docs, held, strict=True)])
    y = np.array([labels.get(r.doc_id, -1) for r in docs])
    want = gaussian_scores(x[train], y[train], x)
    got = {r.doc_id: r for r in queries.op1_quality(spark, sf_middle).collect()}
    assert len(got) == len(docs)
    for r, s, h in zip(docs, want, held, strict=True):
        g = got[r.doc_id]
        assert g.held_out == h and abs(g.score - s) < 1e-6 and g.predicted == int(g.score >= 0.7)
    test = held & (y >= 0)
    assert np.mean([got[r.doc_id].predicted == v for r, v, t in zip(docs, y, test, strict=True) if t]) > 0.95


def test_odd_rows(spark):
    good, bad = "Plain words stand here in a row, and they end. ", "BUY!! NOW!! ### $$$ "
    rows = [(k, (good if k % 3 else bad) * (k % 7 + 1), 1.0) for k in range(60)] + [(60, None, 1.0), (61, "", 1.0), (None, good, 1.0),
                                                                                     (3, good, 1.0), (62, good * 20_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = [(k, int(k % 3 != 0)) for k in range(60)] + [(1, None), (2, 7), (None, 1), (4, 1), (999, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    feats, model = quality.train(docs, labels, F.lit(True))
    got = quality.score(feats, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 60]) > 0.9
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and 30 < kept.count() < 60
    assert quality.keep_good(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("marks, low, high", [([], 0.5, 0.5), ([(1, 1), (2, 1), (3, 1)], 0.7, 0.9)])
def test_missing_class_gives_the_prior(spark, marks, low, high):
    docs = spark.createDataFrame([(1, "a"), (2, "b c"), (3, None)], "doc_id long, text string")
    feats, model = quality.train(docs, spark.createDataFrame(marks, "doc_id long, quality int"), F.lit(True))
    assert all(low <= r.score <= high for r in quality.score(feats, model).collect())
