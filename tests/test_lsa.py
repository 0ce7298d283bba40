"""M1, learned encoder: the distributed randomised SVD against numpy's of the whole matrix."""

import hashlib
import math

import numpy as np
import pytest

from quire.operators import encode, linear, lsa
from quire.plans import registry
import quire.plans.catalogue  # noqa: F401


def plain_matrix(texts, dim):
    counts = np.zeros((len(texts), dim))
    for k, t in enumerate(texts):
        for w in (t or "").split():
            counts[k, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    df = (counts > 0).sum(0)
    a = counts * np.where(df > 0, np.log((1 + len(texts)) / (1 + df)) + 1, 1.0)
    norm = np.sqrt((a * a).sum(1, keepdims=True))
    return a / np.where(norm > 0, norm, 1)


def topics(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [[f"t{t}w{k}" for k in range(30)] for t in range(6)]
    return [" ".join(str(rng.choice(words[k % 6])) for _ in range(int(rng.integers(5, 60)))) + " common" for k in range(n)]


def frame(spark, texts, parts=5):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(parts)


@pytest.mark.parametrize("fan", [64, 2])
def test_axes_equal_the_singular_vectors(spark, fan, monkeypatch):
    monkeypatch.setattr(linear, "FAN_IN", fan)             # 2: sums and triangles go through a tree
    texts = topics(200) + [None, "", "  "]
    a = plain_matrix(texts, 64)
    _, values, v = np.linalg.svd(a, full_matrices=False)
    e = lsa.fit(frame(spark, texts), "text", dim=64, rank=6, power=8)
    assert np.allclose(e.values, values[:6], rtol=1e-6)
    assert np.allclose(e.axes.T @ e.axes, np.eye(6), atol=1e-9)
    assert np.abs(e.axes @ e.axes.T - v[:6].T @ v[:6]).max() < 1e-5            # the same subspace
    rows = frame(spark, texts).select("id", e("text").alias("x")).collect()
    for r in rows:
        assert np.allclose(r.x, a[r.id] @ e.axes, atol=1e-9)
    assert not any(any(r.x) for r in rows if r.id >= 200)


def test_few_texts_and_an_empty_table(spark):
    texts = ["a b c", "a b d", None]
    e = lsa.fit(frame(spark, texts), "text", dim=32, rank=5)
    a = plain_matrix(texts, 32)
    assert np.allclose(e.values[:2], np.linalg.svd(a)[1][:2]) and not e.values[2:].any() and not e.axes[:, 2:].any()
    empty = lsa.fit(frame(spark, texts).limit(0), "text", dim=32, rank=5)
    assert empty.axes.shape == (32, 5) and not empty.axes.any()
    assert frame(spark, texts).limit(0).select(empty("text").alias("x")).count() == 0


def test_topics_lie_together(spark):
    texts = topics(240, seed=3)
    df = frame(spark, texts)
    e = lsa.fit(df, "text", dim=512, rank=8)
    out = encode.embed_columns(df, "id", ["text"], encoder=e).orderBy("id").collect()
    x = np.array([r.text_emb for r in out])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T - 2 * np.eye(len(x))
    assert np.mean(near.argmax(1) % 6 == np.arange(len(x)) % 6) > 0.98


def test_query_covers_all_documents(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r.embedding for r in registry.QUERIES["lsa_embed"](spark, d).collect()}
    a = plain_matrix([t for _, t in docs], 1024)
    values = np.linalg.svd(a)[1]
    x = np.array([got[i] for i, _ in docs])
    # a flat spectrum: the random range holds all but a hundredth of what the best 32 axes could
    assert x.shape == (len(docs), 32) and math.isclose((x * x).sum(), (values[:32] ** 2).sum(), rel_tol=1e-2)
