"""Operators 2 and 8 against brute force, on the driver's tables and on odd rows."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import decontaminate, queries, simhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def hits(docs, bench):
    """Per document: n_words, n_hit, sorted items; windows compared as word lists."""
    windows = {}
    for item, text in bench:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for _, text in docs:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= x
        out.append((len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return out


def check_report(spark, docs, bench, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.report(d, b, **more).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(
        (i or -1, *x) for (i, _), x in zip(docs, hits(docs, bench), strict=True))
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    return got


def odd_rows():
    rng = np.random.default_rng(5)
    vocabulary = ["a", "b", "ça", "D", "e5", "f", "naïve", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    bench = [(k, text(n)) for k, n in enumerate([13, 14, 40, 200, 12, 5, 1, 13])]
    bench += [(8, ""), (9, None), (None, text(20)), (2, bench[2][1]), (10, bench[3][1]), (11, "q w e r t")]
    docs = [(100 + k, text(int(n))) for k, n in enumerate(rng.integers(0, 300, 40))]
    docs += [(200 + k, f"{text(30)}! {b} -- {text(9)}\t{(b or '')[: len(b or '') // 2]}") for k, (_, b) in enumerate(bench)]
    docs += [(300, None), (301, ""), (302, "  ... "), (300, None), (None, bench[2][1]), (303, "Q,w.E\x00r\x7ft"),
             (304, (bench[3][1] + " ") * 300)]
    return docs, bench


@pytest.mark.parametrize("max_words", [decontaminate.MAX_WORDS, 60])
def test_decontaminate_odd_rows(spark, max_words):
    docs, bench = odd_rows()
    got = check_report(spark, docs, bench, max_words=max_words)
    assert sum(r.contaminated for r in got) > 20


def test_decontaminate_random_long_items_in_segments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 7)
    docs, bench = odd_rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert len(list(decontaminate.blocks(b, 30))) > 5
    got = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in decontaminate.report(d, b).collect()}
    assert got == {(i, x[1], tuple(x[2])) for (i, _), x in zip(docs, hits(docs, bench), strict=True)}


def test_decontaminate_empty_tables(spark):
    docs, bench = odd_rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontaminate.report(d, b.limit(0)).collect()} == {0}


def test_decontaminate_query(spark, sf_middle):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_middle}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_middle}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i: x for (i, _), x in zip(docs, hits(docs, bench), strict=True)}
    got = queries.op2_decontaminate(spark, sf_middle).collect()
    assert len(got) == len(docs)
    for r in got:
        n, h, items = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, h, len(items))
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()
        assert r.contaminated == (h > 0 and 20 * h >= n)
    assert any(r.contaminated for r in got)


def test_keep_clean_keeps_columns(spark):
    docs, bench = odd_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {"_hit_bits": F.lit(1), "items": F.lit("x"), "n_words": F.lit(2.5)})
    b = spark.createDataFrame(bench, "item_id long, text string")
    for size in (decontaminate.MAX_WORDS, 60):
        kept = decontaminate.keep_clean(d, b, max_words=size)
        assert kept.schema == d.schema
        want = [i for (i, _), (n, h, _) in zip(docs, hits(docs, bench), strict=True) if not (h and 20 * h >= n)]
        assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i in want)


def plain_fingerprint(text, size=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0
    shingles = [" ".join(w[k:k + size]) for k in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, bits=3):
    """doc index -> set of indices linked, by all pairs."""
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    seen, out = np.full(len(x), -1), 0
    for k in range(len(x)):
        if seen[k] < 0:
            todo = [k]
            seen[k] = out
            while todo:
                new = np.flatnonzero(near[todo.pop()] & (seen < 0))
                seen[new] = out
                todo += new.tolist()
            out += 1
    return seen


def test_simhash_query(spark, sf_middle):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_middle}/documents.parquet").select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in docs]
    group = plain_components(fps)
    least = {}
    for (i, _), g in zip(docs, group, strict=True):
        least[g] = min(i, least.get(g, i))
    want = sorted((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(docs, fps, group, strict=True))
    assert sorted(tuple(r) for r in queries.op8_simhash(spark, sf_middle).collect()) == want
    assert len(least) < len(docs)


@pytest.mark.parametrize("n, chunk", [(3, 2048), (3, 20), (10 ** 9, 20), (10 ** 13, 5)])
def test_links_find_every_component(spark, n, chunk):
    """Chains and dense clouds of fingerprints; each number of bytes per list, with and without dealt chunks."""
    rng = np.random.default_rng(1)
    fps = set(rng.integers(0, 1 << 63, 150).tolist()) | {0, (1 << 64) - 1}
    for start in list(fps)[:12]:
        x = start
        for _ in range(20):                                # a chain: each three bits from the last
            for b in rng.choice(64, 3, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    centre = int(rng.integers(0, 1 << 63))
    for _ in range(150):                                   # a cloud in two bytes: every list of it is long
        fps.add(centre ^ int(rng.integers(0, 1 << 9)))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), n, chunk=chunk)
    rows = edges.collect()
    assert all(bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= 3 for r in rows)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    group, by_root, by_group = plain_components(fps), {}, {}
    for x, g in zip(signed, group, strict=True):
        by_group.setdefault(g, set()).add(x)
        by_root.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_group.values()))
    assert all(r == min(x) for r, x in by_root.items())


def test_simhash_odd_rows(spark):
    text = "one two three four five six seven eight nine ten " * 30
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, text), (2, text.upper()), (2, text.upper()), (None, text), (None, "only null"),
            (7, "x"), (8, "x y"), (6, "x\ty"), (1, "É é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([(5, 3), (3, 3), (9, 3), (4, 2), (2, 2), (2, 2), (-1, 2), (-1, -1), (7, 7), (8, 6), (6, 6), (1, 1)])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one(spark):
    text = "one two three four five six seven eight nine ten " * 30
    rows = [(4, text, "b", 1.0), (2, text, "b", 1.0), (2, text, "b", 1.0), (2, text, "a", None), (None, text, "c", 1.0),
            (None, "alone", "c", 1.0), (7, "other", "c", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id double")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r.doc_id or -1, r.text[:5]) for r in got) == [(-1, "alone"), (2, "one t"), (7, "other")]


def test_keep_one_of_components_that_share_an_id(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(None, "alone"), (None, "another text"), (5, one), (9, one), (5, two), (7, two)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(-1, "alone"), (-1, "another text"), (5, one), (5, two)])


def test_long_text_fingerprint():
    rng = np.random.default_rng(3)
    text = " ".join(map(str, rng.integers(0, 50, 5000)))
    x = simhash.fingerprint(text.encode())
    assert x & (2 ** 64 - 1) == plain_fingerprint(text)
