"""O4, T1, T2, A6-A11, O5, J5 against brute force on small fixtures."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import cocitation, metrics, ordering


def _h(seed, k):
    return hashlib.md5(f"{seed}:{k}".encode()).hexdigest()


def test_dense_position_equals_global_order(spark):
    keys = list(range(3000))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.position for r in ordering.dense_position(df, "k", seed=7, digits=2).collect()}
    order = sorted(keys, key=lambda k: (_h(7, k), k))
    assert got == {k: i + 1 for i, k in enumerate(order)}


def test_positional_split(spark):
    df = spark.createDataFrame([(k,) for k in range(500)], "k long")
    got = ordering.positional_split(df, "k", 123, seed=14850).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 123, "test": 377}
    order = sorted(range(500), key=lambda k: (_h(14850, k), k))
    for size, digits in ((0, 4), (1, 2), (250, 1), (499, 4), (500, 4), (9999, 2)):
        rows = ordering.positional_split(df, "k", size, seed=14850, digits=digits).collect()
        assert {r.k for r in rows if r.split == "train"} == set(order[:size])


def _quotas(counts, test_size=0.2):
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    fl = {c: k * n_train // n for c, k in counts.items()}
    short = n_train - sum(fl.values())
    rank = sorted(counts, key=lambda c: (-(counts[c] * n_train % n), c))
    for c in rank[:short]:
        fl[c] += 1
    return fl


def test_stratified_split_sizes(spark):
    rng = random.Random(3)
    labels = [c for c, k in {"a": 2, "b": 3, "c": 7, "d": 50, "e": 11}.items() for _ in range(k)]
    rng.shuffle(labels)
    df = spark.createDataFrame(list(enumerate(labels)), "k long, y string")
    out = ordering.stratified_split(df, "k", "y", 0.2, seed=42).collect()
    train = Counter(r.y for r in out if r.split == "train")
    want = _quotas(Counter(labels))
    assert dict(train) == {c: v for c, v in want.items() if v}
    assert sum(1 for r in out if r.split == "test") == math.ceil(0.2 * len(labels))
    # rows are taken in seeded hash order inside each class
    for c in "abcde":
        ks = sorted((k for k, y in enumerate(labels) if y == c), key=lambda k: (_h(42, k), k))
        assert {r.k for r in out if r.y == c and r.split == "train"} == set(ks[:want[c]])


def test_stratified_split_raises_for_singleton(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k long, y string")
    with pytest.raises(ValueError):
        ordering.stratified_split(df, "k", "y", check=True)


def _in_top_n(p, t, n):
    return t in sorted(range(len(p)), key=lambda i: p[i])[-n:]


SCORES = [([0.1, 0.4, 0.4, 0.1], 1), ([0.1, 0.4, 0.4, 0.1], 2), ([0.25, 0.25, 0.25, 0.25], 0),
          ([0.0, 0.5, 0.5, 0.0], 0), ([0.7, 0.1, 0.1, 0.1], 0), ([0.2, 0.2, 0.3, 0.3], 3)]


def test_top_n_ties_and_ll(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(SCORES)], "i int, p array<double>, t int")
    got = df.select("i", *[metrics.in_top_n("p", "t", n).alias(f"n{n}") for n in (1, 2, 3)],
                    metrics.log_true_prob("p", "t").alias("ll")).orderBy("i").collect()
    for r, (p, t) in zip(got, SCORES):
        for n in (1, 2, 3):
            assert r[f"n{n}"] == _in_top_n(p, t, n)
        assert r.ll == (math.log(p[t]) if p[t] > 0 else float("-inf"))
    tab = metrics.score_table(df, "p", "t").first()
    assert tab.loglikelihood == float("-inf") and tab.perplexity == float("inf")
    best = df.select(ordering.top_labels("p", 2).alias("b")).collect()
    for r, (p, _) in zip(best, SCORES):
        assert r.b == sorted(range(len(p)), key=lambda i: p[i])[-2:][::-1]


def test_confusion_tables(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "z"), ("c", "a"), ("a", "a")]
    df = metrics.pair_counts(spark.createDataFrame(pairs, "y string, p string"), "y", "p")
    union = {(r.actual, r.predicted): r.cnt for r in metrics.confusion_dense(df).collect()}
    labs = sorted({x for pr in pairs for x in pr})
    assert union == {(a, b): sum(1 for pr in pairs if pr == (a, b)) for a in labs for b in labs}
    truth = {(r.actual, r.predicted): r.cnt for r in metrics.confusion_dense(df, "truth").collect()}
    tl = sorted({a for a, _ in pairs})
    assert set(truth) == {(a, b) for a in tl for b in tl}
    cube = {(r.actual, r.predicted): r.cnt for r in metrics.confusion_cube(df).collect()}
    assert cube[("All", "All")] == 6 and cube[("a", "All")] == 3 and cube[("All", "z")] == 1
    pct = {(r.actual, r.predicted): r.cell for r in
           metrics.confusion_percent(metrics.confusion_dense(df, "truth")).collect()}
    assert pct[("a", "a")] == "%.1f%%\n%d/%d" % (200 / 3, 2, 3)
    assert pct[("a", "c")] == ""
    assert pct[("a", "b")] == "%.1f%%\n%d" % (100 / 3, 1)
    with pytest.raises(ValueError):
        metrics.confusion_dense(df, max_labels=2)


def test_labels_the_probabilities_are_not_for(spark):
    rows = [([1.0, 0.0, 0.0, 0.0], 7), ([0.5, 0.5], 5), ([0.5, 0.5], None), ([0.2, 0.8], -1), ([0.2, 0.8], 0)]
    df = spark.createDataFrame(rows, "p array<double>, t int")
    got = [r[0] for r in df.select(metrics.in_top_n("p", "t", 3)).collect()]
    assert got == [False, False, False, False, True]
    seen = F.array(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))
    df = spark.createDataFrame([([0.2, 0.6, 0.2], 1), ([0.2, 0.6, 0.2], 2)], "p array<double>, t int")
    r = df.select(metrics.mask_unseen("p", seen).alias("p"), "t").select("p", metrics.in_top_n("p", "t", 3, seen).alias("n"),
                                                                         metrics.log_true_prob("p", "t").alias("l")).collect()
    assert r[0].p == pytest.approx([0.5, 0.0, 0.5]) and (r[0].n, r[1].n) == (False, True)
    assert r[0].l == float("-inf") and r[1].l == pytest.approx(math.log(0.5))


def test_unseen_class_in_the_middle(spark):
    from quire.operators import classify
    rows = [(k, [float(k % 2), 1.0 - k % 2, 0.1 * (k % 3)], 2 * (k % 2)) for k in range(40)]
    x = classify.to_vector(spark.createDataFrame(rows, "k long, f array<double>, code long"), "f")
    test = classify.to_vector(spark.createDataFrame(rows[:8] + [(90, [0.5, 0.5, 0.0], 1)], "k long, f array<double>, code long"), "f")
    m = classify.train_test(x, test, classify.ClassifierSpec(max_iter=20)).first()
    assert m.n == 9 and m.n_unseen == 1 and m.loglikelihood == float("-inf")
    assert m.top1 == m.top3 == m.top5 == pytest.approx(8 / 9)


def test_percent_text_rounds_like_python(spark):
    # 1/16 = 6.25% is an exact binary tie: Python prints 6.2
    rows = [("a", "b", 1)] + [("a", "a", 15)]
    df = spark.createDataFrame(rows, "actual string, predicted string, cnt long")
    cells = {r.predicted: r.cell for r in metrics.confusion_percent(df).collect()}
    assert cells["b"] == "%.1f%%\n%d" % (6.25, 1)


EDGES = [("s1", "a"), ("s1", "b"), ("s1", "c"), ("s1", "a"),      # duplicate edge
         ("s2", "a"), ("s2", "d"), ("s3", "e"),                     # paper e: no co-citation
         ("s4", "b"), ("s4", "b2"), ("s4", "t"),                    # t: test-only neighbour
         ("hub", "a"), ("hub", "b"), ("hub", "c"), ("hub", "d"), ("hub", "b2"),
         ("x", "x"), ("x", "c")]                                    # self pair
TRAIN = {"a": "cs", "b": "math", "c": "cs", "d": "ph", "b2": "math", "x": "ph"}


def test_cocitation_equals_pairwise(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    tr = spark.createDataFrame(list(TRAIN.items()), "id string, cat string")
    got = {(r.paper, r.cat): (r.cnt, round(r.share, 9)) for r in cocitation.cocitation_counts(e, tr).collect()}
    edges = set(EDGES)
    cnt = Counter()
    for s1, x in edges:
        for s2, y in edges:
            if s1 == s2 and x != y and y in TRAIN:
                cnt[(x, TRAIN[y])] += 1
    tot = Counter()
    for (x, _), v in cnt.items():
        tot[x] += v
    assert got == {k: (v, round(v / tot[k[0]], 9)) for k, v in cnt.items()}
    vec = {r.paper: r.cocitation for r in cocitation.cocitation_vectors(
        cocitation.cocitation_counts(e, tr), tr).collect()}
    assert vec["t"] == [got.get(("t", c), (0, 0.0))[1] for c in ["cs", "math", "ph"]]


def test_softmax_and_ovr(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "r array<double>")
    r = df.select(metrics.softmax("r").alias("s"), metrics.ovr_probability("r").alias("o")).first()
    ex = [math.exp(x) for x in (1, 2, 3)]
    assert r.s == pytest.approx([x / sum(ex) for x in ex])
    sg = [1 / (1 + math.exp(-x)) for x in (1, 2, 3)]
    assert r.o == pytest.approx([x / sum(sg) for x in sg])
    assert max(range(3), key=lambda i: r.o[i]) == 2
