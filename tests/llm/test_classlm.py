"""Operator 7: counts and base scores by hand, the exchange, and that probabilities sum to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import classlm, queries


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def base(texts, train):
    c = Counter()
    for t in train:
        c.update(words(t) + [None])
    n, v = sum(c.values()), len(c)
    return n, [(len(x := [*words(t), None]), sum(c[w] > 0 for w in x), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
               for t in texts]


def test_query(spark, sf_middle):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_middle}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    n, want = base(docs.values(), [t for i, t in docs.items() if not held[i]])
    want = dict(zip(docs, want, strict=True))
    got = queries.op7_classlm(spark, sf_middle).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.held_out, r.train_tokens) == (held[r.doc_id], n)
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2]
        assert abs(r.base_score - want[r.doc_id][2]) < 1e-6 * max(1, abs(r.base_score))
        assert abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def likelihood(b, cls, c):
    one = np.eye(c + 2)[np.append(cls, [c, c + 1])]
    g = one.T @ b @ one
    return classlm._h(g).sum() - classlm._h(g.sum(0)).sum() - classlm._h(g.sum(1)).sum()


def test_exchange_raises_the_likelihood_and_ends_in_an_optimum():
    rng = np.random.default_rng(0)
    n, c = 24, 3
    kind = rng.integers(0, c, n)
    b = rng.poisson(np.where((kind[:, None] + 1) % c == kind[None, :], 20.0, 0.5)).astype(float)
    b = np.pad(b, (0, 2), constant_values=1.0)
    cls = classlm.exchange(b, n, c, sweeps=50)
    best = likelihood(b, cls, c)
    assert best > likelihood(b, np.arange(n) % c, c)
    for w in range(n):                                     # no single move is better
        for k in range(c):
            other = cls.copy()
            other[w] = k
            assert likelihood(b, other, c) <= best + 1e-6
    assert len({(k, x) for k, x in zip(kind, cls, strict=True)}) == c         # the classes it was made from


@pytest.mark.parametrize("clustered, listed", [(5, 8), (8, 8), (4, 4), (100, 1000)])
def test_probabilities_sum_to_one_and_rare_words_count_exactly(spark, clustered, listed):
    texts = ["a b c d e f", "a b a b c", "g h i a", "a a b", "j k a b", None, "", "E F  g\tH"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model, vocabulary = classlm.train(df, n_classes=3, clustered=clustered, listed=listed)
    counts = Counter(w for t in texts for w in words(t))
    assert {r.word: r.c for r in vocabulary.collect()} == {**counts, "": len(texts)}
    # after any class: all known words, the end, and one unseen word
    every = [*counts, "never seen before"[:5]]
    one = spark.createDataFrame([(w,) for w in every], "text string")
    rows = classlm.score(one, model, vocabulary, keep=("text",)).collect()
    end = len(model.classes) - 1
    for r in rows:                                         # P(w | start) P(end | w): divide by the second factor
        listed = model.listed.to_pylist()
        cls = model.classes[listed.index(r.text) if r.text in listed else end - 1]
        r_end = model.transitions[cls, model.classes[end]] + model.emission[end]
        every[every.index(r.text)] = 10 ** (r.score - r_end)
    total = sum(every) + 10 ** (model.transitions[model.classes[end], model.classes[end]] + model.emission[end])
    assert abs(total - 1) < 1e-9
    n, want = base(texts, texts)
    got = sorted(classlm.score(df, model, vocabulary).collect(), key=lambda r: r.doc_id)
    for r, (tokens, known, score) in zip(got, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and abs(r.base_score - score) < 1e-9


@pytest.mark.parametrize("held", [5, 6])
def test_repeated_words_have_classes_however_few_the_tasks_hold(spark, held):
    texts = ["a b c d e f", "a b a b c g", "g h i a", "a a b h g h", "j k a b e f e", None, "", "E F  g\tH"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    all_held, v1 = classlm.train(df, n_classes=3, clustered=4)
    some_held, v2 = classlm.train(df, n_classes=3, clustered=4, held=held)
    assert len(some_held.listed) == held < len(all_held.listed)
    classes = dict(zip(some_held.listed.to_pylist(), some_held.classes.tolist(), strict=False))
    classes |= {r.word: r.cls for r in v2.collect() if r.cls is not None}
    assert set(classes) == set(all_held.listed.to_pylist())                    # every word seen twice
    # the model by hand: bigrams of classes, then each text's probabilities
    c, end, counts = 5, 4, Counter(w for t in texts for w in words(t))
    seqs = [[end, *(classes.get(w, 3) for w in words(t)), end] for t in texts]
    g = np.zeros((c, c))
    for x in seqs:
        np.add.at(g, (x[:-1], x[1:]), 1)
    trans, size = classlm._transitions(g), Counter(x for s in seqs for x in s[1:])
    once = [w for w in counts if w not in classes]
    for r in classlm.score(df, some_held, v2).collect():
        t, s = words(texts[r.doc_id]), seqs[r.doc_id]
        want = sum(math.log10(trans[a, b]) for a, b in zip(s[:-1], s[1:], strict=True))
        want += sum(math.log10(counts[w] / size[classes[w]] if w in classes else 2 / (2 * len(once) + 1)) for w in t)
        want += math.log10(len(texts) / size[end])
        assert abs(r.score - want) < 1e-9 and r.n_known == r.n_tokens


def test_classes_and_scores_do_not_depend_on_how_many_words_tasks_hold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")

    def run(held):
        model, vocabulary = classlm.train(docs, n_classes=16, clustered=100, held=held)
        classes = dict(zip(model.listed.to_pylist(), model.classes.tolist(), strict=False))
        classes |= {r.word: r.cls for r in vocabulary.where("cls is not null").collect()}
        return len(model.listed), classes, {r.doc_id: (r.n_known, r.base_score, r.score) for r in classlm.score(docs, model, vocabulary).collect()}

    n, classes, scores = run(classlm.HELD)
    assert n == len(classes) > 3000
    for held in (100, 500, 2500):
        k, other, found = run(held)
        assert k == held and other == classes
        for i, (known, base, score) in scores.items():
            assert found[i][0] == known and abs(found[i][1] - base) < 1e-7 and abs(found[i][2] - score) < 1e-9 * abs(score)


def test_odd_rows(spark):
    rows = [(1, "a b", 1), (1, "a b", 1), (None, "c", 2), (2, None, 3), (3, "w " * 100_000, 4), (3, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    model, vocabulary = classlm.train(df.limit(0))
    got = classlm.score(df, model, vocabulary).collect()
    assert len(got) == 6 and {r.n_known for r in got} == {0} and all(math.isfinite(r.score) for r in got)
    model, vocabulary = classlm.train(df)
    got = classlm.score(df, model, vocabulary).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 3, 100_001] and all(r.n_known == r.n_tokens for r in got)
    assert classlm.score(df.limit(0), model, vocabulary).count() == 0
