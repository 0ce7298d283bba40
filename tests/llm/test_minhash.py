"""Operator 11 against sets of shingles made one by one."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import minhash, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """(doc_id, text, edited, next text) in the order of the ids, and the components of all links."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    rows = sorted([(i, t or "") for i, t in rows], key=key)
    out = [(i, t, t[:len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][:len(t) // 2], rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]
    sets = [shingle_set(t) for _, t in rows]
    distinct = list({frozenset(s) for s in sets})
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if a and b and jaccard(a, b) >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        r = root(frozenset(s))
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return out, [least[root(frozenset(s))] for s in sets]


def check(rows, got, sigmas=5.5):
    want, groups = plain(rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    none = lambda x: (x is not None, x or 0)
    expected = sorted(((i, len(t), digest(e), g) for (i, t, e, _), g in zip(want, groups, strict=True)), key=lambda r: (none(r[0]), r[1:3]))
    assert sorted(((r.doc_id, r.n_chars, bytes(r.edited_sha256).hex(), r.component_id) for r in got), key=lambda r: (none(r[0]), r[1:3])) == expected
    near = {(i, digest(e)): (jaccard(shingle_set(t), shingle_set(e)), jaccard(shingle_set(t), shingle_set(x)), t) for i, t, e, x in want}
    by_set = {}
    for r in got:
        edited, following, text = near[r.doc_id, bytes(r.edited_sha256).hex()]
        for value, true in ((r.near_edited, edited), (r.near_next, following)):
            assert 0 <= value <= 1 and abs(value - true) <= sigmas * np.sqrt(true * (1 - true) / 128) + 0.05 and (true < 1 or value == 1)
        assert by_set.setdefault(frozenset(shingle_set(text)), bytes(r.fp)) == bytes(r.fp) and len(r.fp) == len(r.edited_fp) == 128


def run(spark, rows, parts=5, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars int, fp string").repartition(parts)
    return minhash.near_duplicates(df, minhash.fingerprints(df), **more).collect()


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op11_minhash(spark, sf)
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = [r.asDict() for r in got.collect()]
    check(docs, [type("R", (), {**r, "fp": bytes.fromhex(r["fingerprint"]), "edited_fp": bytes.fromhex(r["edited_fingerprint"]),
                                "edited_sha256": bytes.fromhex(r["edited_sha256"])}) for r in rows])


def words(rng, n, of=3000):
    return [f"w{int(k)}" for k in rng.integers(0, of, n)]


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 400])
def test_groups_of_copies_ties_and_odd_rows(spark, chunk):
    rng = np.random.default_rng(4)
    base = words(rng, 200)
    rows = [(k, " ".join(words(rng, int(rng.integers(1, 90))))) for k in range(60)]
    for k in range(40):                                    # near copies of one text, some only linked through it
        near = list(base)
        for p in rng.integers(0, 200, int(rng.integers(0, 5))):
            near[int(p)] = f"x{k}"
        rows.append((100 + k, " ".join(near)))
    rows += [(200, "A b  C\td e F"), (201, "a B c d E f"), (202, "a b c"), (202, "a b c"), (203, "A B C"), (None, "a b c"), (None, None), (5, ""),
             (204, None), (205, " \n\t "), (206, "é " * 30_000 + "ü"), (207, "x" * 200_000), (300, "one"), (300, "two"), (301, "\U0001f600 abc d")]
    rows += [(400, "the very same text of this one document")] * 50
    check(rows, run(spark, rows, chunk=chunk))


def test_few_rows_and_empty_table(spark):
    assert run(spark, []) == []
    check([(1, "one two three four five six")], run(spark, [(1, "one two three four five six")]))
    check([(1, None), (2, None)], run(spark, [(1, None), (2, None)]))
    check([(7, "a b"), (3, "c d e")], run(spark, [(7, "a b"), (3, "c d e")]))


@given(st.lists(st.text(alphabet="ab \t\x0b\x1cÉ\U0001f600", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_shingles_are_those_of_each_text(texts):
    values, offsets = minhash.shingles(texts)
    sets = [set(values[a:z].tolist()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
    want = [shingle_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for a, x in zip(sets, want, strict=True):
        for b, y in zip(sets, want, strict=True):
            assert len(a & b) == len(x & y)
