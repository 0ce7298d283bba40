"""Benchmark decontamination by winnowing.

Texts become sequences of lower-cased words. Of every ``WINDOW`` consecutive
hashes of ``GRAM``-word sequences, those equal to the smallest are the
fingerprints, so two texts that share ``GRAM + WINDOW - 1`` = 13 consecutive
words share a fingerprint inside them. Fingerprints of the benchmark are
joined with those of the documents map-side; every match is extended to the
13-word windows around it, which are compared word by word.

The benchmark reaches the tasks in blocks of at most ``max_words`` words; the
documents pass each block in turn, their hits kept in a stored table between
passes. An item of fewer than 13 words (below winnowing's guarantee) is one
window; it is found by the hash of its whole length.

Defined results: a null or empty text has no words and is never contaminated;
a null ``item_id`` gives hits but is never listed; repeated items count once;
repeated documents are judged each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, column, lots, store, text_bytes

SPAN, GRAM = 13, 8
WINDOW = SPAN - GRAM + 1
SEGMENT = 4096                        # words of an item handled as one row; neighbours overlap by SPAN - 1
MAX_WORDS = 1_000_000                 # words of the benchmark in one broadcast block
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SPAN - 1, BASE)]), dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values (wrapping 64-bit polynomial)."""
    m = max(0, len(values) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += values[j:j + m] * _POWERS[j]
    return out


def chosen(h: np.ndarray) -> np.ndarray:
    """True where a hash is the smallest (ties included) of a run of ``WINDOW``
    hashes that holds it; runs cut by either end count too."""
    n = len(h)
    if not n:
        return np.zeros(0, bool)
    top = np.full(WINDOW - 1, np.iinfo(np.uint64).max, np.uint64)
    p = np.concatenate([top, h, top])
    low = p[:n + WINDOW - 1].copy()                       # low[i]: smallest of the run that starts at i - WINDOW + 1
    for j in range(1, WINDOW):
        np.minimum(low, p[j:j + n + WINDOW - 1], out=low)
    out = low[:n] == h
    for j in range(1, WINDOW):
        out |= low[j:j + n] == h
    return out


def member(sorted_values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``h``: is it in ``sorted_values``, and where."""
    if not len(sorted_values):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)
    return sorted_values[at] == h, at


class Index:
    """Fingerprints and distinct windows of one block of the benchmark."""

    def __init__(self, segments: list[tuple[str | None, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        named = sorted({i for i, _ in segments if i is not None})
        number = {i: k for k, i in enumerate(named)}
        self.names = np.array(named, dtype=object)
        ids, owner = [], []
        for item, joined in segments:
            w = joined.split(b" ")
            ids.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int32))
            owner.append(number.get(item, -1))
        # value of a word: from its bytes, so all blocks and tasks agree; 0 stands for any word of no item
        self.value = np.array([0, *(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                                    for w in self.vocabulary)], np.uint64)
        grams, windows = [], {}
        for s, o in zip(ids, owner, strict=True):
            n = min(len(s), SPAN)
            if n == SPAN:
                h = rolling(self.value[s], GRAM)
                grams.append(h[chosen(h)])
            h = rolling(self.value[s], n)
            for x, k in zip(h.tolist(), range(len(h)), strict=True):
                windows.setdefault((n, x), (s[k:k + n], set()))[1].add(o)
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.lengths = {}                                  # length -> sorted hashes, words, owners, first words
        for n in sorted({n for n, _ in windows}):
            keys = sorted(x for m, x in windows if m == n)
            own = [windows[n, x] for x in keys]
            seq = np.stack([w for w, _ in own])
            first = np.zeros(len(self.value), bool)
            first[seq[:, 0]] = True
            self.lengths[n] = (np.array(keys, np.uint64), seq,
                               [np.array(sorted(o - {-1}), np.int64) for _, o in own], first)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
        """Hit words of a sequence of word numbers, and (starts, window, length) of what was found."""
        hit, found = np.zeros(len(ids) + 1, np.int32), []
        value = self.value[ids]
        for n, (keys, seq, _, first) in self.lengths.items():
            if n == SPAN:
                h = rolling(value, GRAM)
                at = np.flatnonzero(chosen(h))
                at = at[member(self.grams, h[at])[0]]
                near = (at[:, None] - np.arange(WINDOW)[None, :]).ravel()
            else:
                near = np.flatnonzero(first[ids])
            near = np.unique(near[(near >= 0) & (near <= len(ids) - n)])
            if not len(near):
                continue
            around = ids[near[:, None] + np.arange(n)[None, :]]
            ok, k = member(keys, (self.value[around] * _POWERS[:n]).sum(1, dtype=np.uint64))
            ok &= (seq[k] == around).all(1)                # word by word
            if ok.any():
                start = near[ok]
                np.add.at(hit, start, 1)
                np.add.at(hit, start + n, -1)
                found.append((start, k[ok], n))
        return np.cumsum(hit[:-1]) > 0, found


def blocks(bench: DataFrame, max_words: int = MAX_WORDS) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items, cut into segments that keep every window whole, in lists of
    at most ``max_words`` words (or one segment); one list is held at a time."""
    rows = bench.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(column(b, "item").to_pylist(), text_bytes(b), strict=True):
                w = words_of(text)
                for k in range(0, max(len(w) - SPAN + 1, min(len(w), 1)), SEGMENT):
                    s = w[k:k + SEGMENT + SPAN - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()),
                                                      pa.array([b" ".join(s)], pa.binary())], names=["item", "words"])

    out, n = [], 0
    for r in rows.mapInArrow(run, "item string, words binary").toLocalIterator(prefetchPartitions=False):
        w = bytes(r.words)
        m = w.count(b" ") + 1
        if out and n + m > max_words:
            yield out
            out, n = [], 0
        out.append((r.item, w))
        n += m
    yield out


HITS, ITEMS = "_hit_bits", "_hit_items"


def _pass(docs: DataFrame, segments: list, hits: str, items: str, stateful: bool, finish) -> DataFrame:
    """One block over all documents. ``finish`` (or None between passes) gives
    the schema and the function from (batch, words, hits, item names) to a batch."""
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(Index(segments))
    plain = [f for f in docs.schema.fields if f.name not in (hits, items)]
    schema = finish[0] if finish else T.StructType([*plain, T.StructField(hits, T.BinaryType()),
                                                    T.StructField(items, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        known = ix.vocabulary.get
        for b in (x for y in batches for x in lots(y)):
            docs_ids, sizes = [], []
            gap = np.zeros(SPAN, np.int32)                 # keeps neighbours apart
            for t in text_bytes(b):
                w = words_of(t)
                sizes.append(len(w))
                docs_ids += [np.fromiter((known(x, 0) for x in w), np.int32, len(w)), gap]
            ids = np.concatenate(docs_ids)
            sizes = np.array(sizes)
            start = np.concatenate([[0], np.cumsum(sizes + SPAN)[:-1]])
            hit, found = ix.find(ids)
            names: list[set] = [set() for _ in sizes]
            for at, k, n in found:
                for d, w in set(zip((np.searchsorted(start, at, "right") - 1).tolist(), k.tolist(), strict=True)):
                    names[d].update(ix.names[ix.lengths[n][2][w]].tolist())
            each = [hit[s:s + n] for s, n in zip(start, sizes, strict=True)]
            if stateful:
                for d, (old, more) in enumerate(zip(column(b, hits).to_pylist(), column(b, items).to_pylist(),
                                                    strict=True)):
                    if old:
                        each[d] = each[d] | np.unpackbits(np.frombuffer(old, np.uint8),
                                                          count=len(each[d])).astype(bool)
                    names[d].update(more)
            rest = b.select([f.name for f in plain]) if stateful else b
            if finish:
                yield finish[1](rest, sizes, np.array([int(x.sum()) for x in each]), names)
            else:
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array([np.packbits(x).tobytes() if x.any() else b"" for x in each], pa.binary()),
                     pa.array([sorted(x) for x in names], pa.list_(pa.string()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _over_blocks(docs: DataFrame, bench: DataFrame, finish, max_words: int) -> DataFrame:
    own = uuid.uuid4().hex                                 # no clash with a column of the caller
    hits, items, stateful, held = f"{HITS}_{own}", f"{ITEMS}_{own}", False, None
    for segments in blocks(bench, max_words):
        if held is not None:
            docs, stateful = store(_pass(docs, held, hits, items, stateful, None), "decontaminate"), True
        held = segments
    return _pass(docs, held, hits, items, stateful, finish)


def is_contaminated(n_words: np.ndarray, n_hit: np.ndarray) -> np.ndarray:
    """At least one hit word, and hits on a twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, bench: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (names of the items
    with an occurring window, sorted), contaminated."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_hit", T.LongType()),
                           T.StructField("items", T.ArrayType(T.StringType())),
                           T.StructField("contaminated", T.BooleanType())])

    def finish(b, sizes, n_hit, names):
        return pa.RecordBatch.from_arrays(
            [column(b, "doc_id"), pa.array(sizes.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
             pa.array([sorted(x) for x in names], pa.list_(pa.string())),
             pa.array(is_contaminated(sizes, n_hit))], names=schema.names)

    return _over_blocks(docs, bench, (schema, finish), max_words)


def keep_clean(docs: DataFrame, bench: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not contaminated."""
    def finish(b, sizes, n_hit, names):
        return b.filter(pa.array(~is_contaminated(sizes, n_hit)))

    return _over_blocks(docs, bench, (docs.schema, finish), max_words)
