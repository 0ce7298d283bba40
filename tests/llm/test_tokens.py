"""Operators 4 and 6 and the shared encoder, against the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing, queries, tokenfile
from quire.llm.encode import Encoder

BYTE, WORD = (public_tokenizers.path(x) for x in (queries.BYTE_BPE, queries.WORD_BPE))
ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n", "a\nb", "a\n\nb", "a\n b", "\ta\tb", "I'm we'll 'tis", "x\x00y", "é́ é ́",
       "ΣΑΣ İI ſ ﬁ", "a b  c \x1c d\x85e", "<|endoftext|> a<|endoftext|>", "<|startoftext|>x", "12 345 6", "...!!! ,a", "日本語 テキスト",
       "😀 👩‍👩 x", "w" * 3000, "a " * 500, "don't\nI've"]


@pytest.mark.parametrize("path, dtype", [(BYTE, "<u4"), (WORD, "<u2")])
def test_encoder_equals_library(path, dtype):
    enc, plain = Encoder(path, dtype), Tokenizer.from_file(path)

    def same(text):
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.ids(text), dtype).tolist() == want, repr(text)

    for t in ODD + [x + y for x in ODD[:24] for y in ODD[:24]]:
        same(t)

    @given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6), st.sampled_from(list(" \n\t'.!1a")))).map("".join))
    @settings(max_examples=400, deadline=None)
    def more(text):
        same(text)

    more()


def test_cut():
    assert packing.cut(3, 10) == [(0, 3)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def best_fit(counts, capacity):
    """Sequences that plain best fit by falling size takes, piece by piece."""
    room = [0] * (capacity + 1)
    n = 0
    for s in range(capacity, 0, -1):
        for _ in range(counts[s]):
            free = next((f for f in range(s, capacity + 1) if room[f]), None)
            if free is None:
                n, free = n + 1, capacity
            else:
                room[free] -= 1
            room[free - s] += 1
    return n


@pytest.mark.parametrize("capacity", [6, 10, 31, 100])
def test_plan_places_everything(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(30):
        counts = np.zeros(capacity + 1, int)
        for s in rng.integers(1, capacity + 1, rng.integers(1, 30)):
            counts[s] += rng.integers(1, 300)
        contents, times = packing.plan(counts, capacity)
        placed = np.zeros_like(counts)
        for c, n in zip(contents, times, strict=True):
            assert n > 0 and sum(s * k for s, k in c.items()) <= capacity
            assert sum(k for s, k in c.items() if s > capacity // 3) <= 2
            for s, k in c.items():
                placed[s] += n * k
        assert (placed == counts).all()
        least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
        assert least <= sum(times) <= 1.05 * best_fit(counts, capacity) + 1
        assert len(times) < 20 * capacity                  # does not grow with the counts


def check_pack(rows, docs, plain, capacity, with_ids=False):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, texts in docs.items():
        want = []
        for t in texts:
            ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
            for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
                want.append((k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()), ids[s:s + n] if with_ids else None))
        got = [(r.piece, r.start, r.length, r.ids_crc32, list(r.ids) if with_ids else None) for r in by_doc[i]]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(map(len, by_doc.values())) == len(rows)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_pack_query(spark, sf):
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_packing(spark, sf).collect()
    n = check_pack(rows, docs, Tokenizer.from_file(BYTE), 1024)
    assert n <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_pack_odd_rows(spark):
    docs = [(k % 20, t) for k, t in enumerate(ODD + [None, None, "", "long " * 5000])] + [(None, "no id")]
    by = defaultdict(list)
    for i, t in docs:
        by[i].append(t)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = packing.pack(df, BYTE, 16, with_ids=True).collect()
    check_pack(rows, by, Tokenizer.from_file(BYTE), 16, with_ids=True)
    assert packing.pack(df.limit(0), BYTE).count() == 0


def test_token_files_query(spark, sf_middle):
    plain = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{sf_middle}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op6_tokenfile(spark, sf_middle).collect()}
    assert len(got) == len(docs)
    start = 0
    for r in docs:
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_token_files_odd_rows(spark, dtype):
    plain = Tokenizer.from_file(WORD)
    docs = [(k // 2, t) for k, t in enumerate(ODD + [None, "word " * 20_000])] + [(None, "no id"), (3, ODD[3]), (3, ODD[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    folder = tokenfile.write(df, WORD, dtype)
    rows = sorted(tokenfile.read(spark, folder, dtype, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in rows] == sorted(i if i is not None else -1 for i, _ in docs)
    at, want = 0, defaultdict(list)
    for i, t in docs:
        want[i].append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    have = defaultdict(list)
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        have[r.doc_id].append(list(r.ids))
    assert {i: sorted(x) for i, x in have.items()} == {i: sorted(x) for i, x in want.items()}
    short = tokenfile.read_document(spark, folder, 5, dtype)
    assert sorted(x.tolist() for x in short) == sorted(want[5])
    assert tokenfile.read_document(spark, folder, 12345, dtype) == []


def test_token_files_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.read(spark, tokenfile.write(df, WORD)).count() == 0


def test_token_files_refuse_a_wrong_dictionary(spark, sf):
    from quire.llm.common import open_fs
    folder = tokenfile.write(spark.read.parquet(f"{sf}/documents.parquet"), WORD)
    fs, path = open_fs(folder)
    with fs.open_output_stream(f"{path}/dictionary") as f:
        f.write(b"another")
    with pytest.raises(Exception, match="dictionary"):
        tokenfile.read(spark, folder).collect()
