"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions. Two fingerprints
that differ in at most three bits differ in at most three bytes, so they share
at least five of the eight positional bytes, and at least ``m`` of the first
``3 + m``. The inverted index lists the distinct fingerprints under ``m``
positional bytes together, for every choice of ``m`` among the first ``3 + m``
positions: every linked pair meets in a list, and lists stay short because
``m`` bytes make 256^m of them. Pairs that meet are tallied over all eight
positions; those that reach the guaranteed five are verified by their bits.

Exact copies collapse to one fingerprint before the index. A list longer than
``chunk`` is dealt as pairs of chunks, so no task holds a whole hot list, and
a task returns only a spanning forest of the links it has verified: the
components are those of all links, but links inside a large group are not
written pair by pair. Components come from alternating large-star and
small-star steps over stored edge tables.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; ties need no rule (a component is named by its smallest doc_id);
a null doc_id never names a component unless all ids in it are null; repeated
rows are returned each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from .common import ASCII_LOWER, column, store, text_bytes

SHINGLE, SEED, BITS, BYTES = 3, 42, 3, 8
SHARED = BYTES - BITS                 # positional bytes that a linked pair shares at least
CHUNK = 2048                          # fingerprints of one list compared at once
HELD = 500_000                        # edges whose nodes' smallest neighbours (at most two numbers for each of two nodes) are broadcast


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, as a signed number."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(joined, SEED), "big", signed=True)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    hashes = b"".join([xxh64_digest(joined[a:b], SEED)
                       for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=False)])
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for a in range(0, n, 200):        # few enough that a byte holds their sum
        ones += np.unpackbits(rows[a:a + 200], axis=1).sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (long) per row."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t, shingle) for t in text_bytes(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=schema.names)

    return rows.mapInArrow(run, schema)


def masks(m: int) -> list[int]:
    """The bytes kept by each choice of ``m`` among the first ``BITS + m`` positions, as signed masks."""
    out = []
    for chosen in combinations(range(BITS + m), m):
        x = sum(0xFF << (56 - 8 * p) for p in chosen)
        out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


def bytes_per_list(n: int) -> int:
    """``m`` for ``n`` distinct fingerprints: at least 3, and lists of random
    fingerprints hold fewer than four. Every choice finds the same links."""
    m = 3
    while m < SHARED and 256 ** m < n / 4:
        m += 1
    return m


def verify(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Count filter, then distance: do the fingerprints share enough positional bytes, and differ in few enough bits?"""
    x = np.bitwise_xor(a, b).view(np.uint64)               # signed numbers would be counted without their sign
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)
    ok = shared >= BYTES - bits
    ok[ok] = np.bitwise_count(x[ok]) <= bits
    return ok


def forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links inside ``left``, or between ``left`` and ``right``."""
    both = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(both), bool)
    side[len(left):] = True
    todo, out = np.arange(len(both)), []
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            v = queue.pop()
            new = verify(both[todo], both[v], bits)
            if right is not None:
                new &= side[todo] != side[v]
            if new.any():
                reached, todo = todo[new], todo[~new]
                out += [(int(both[v]), int(both[w])) for w in reached]
                queue += reached.tolist()
    return out


def links(distinct: DataFrame, n: int, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """a, b: edges with the components of all links among the distinct ``fp``."""
    if bits != BITS:
        raise ValueError(f"the index is laid out for a distance of {BITS} bits")
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(x)).alias("bytes"))
                     for k, x in enumerate(masks(bytes_per_list(n)))])
    listed = distinct.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.bytes", "fp")
    sizes = listed.groupBy("choice", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = store(listed.join(sizes, ["choice", "bytes"]), "lists")        # lists of one are gone
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1),
                        lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi"), own.alias("own")))
    dealt = (listed.select("choice", "bytes", "fp", F.explode(pairs).alias("c"))
             .select("choice", "bytes", "c.lo", "c.hi", "c.own", "fp"))
    by = ["choice", "bytes", "lo", "hi"]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None                                        # the last list of a batch may go on in the next
        for b in batches:
            key = np.stack([np.asarray(column(b, k)).astype(np.int64) for k in by])
            now = np.vstack([key, np.asarray(column(b, "own")).astype(np.int64)[None], np.asarray(column(b, "fp"))[None]])
            now = now if rest is None else np.hstack([rest, now])
            ends = np.flatnonzero((now[:4, 1:] != now[:4, :-1]).any(0)) + 1
            last = ends[-1] if len(ends) else 0
            yield from edges(now[:, :last], ends[:-1] if len(ends) else ends)
            rest = now[:, last:]
        if rest is not None:
            yield from edges(rest, np.zeros(0, np.int64))

    def edges(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        starts = np.concatenate([[0], cuts])
        size = np.diff(np.concatenate([starts, [rows.shape[1]]]))
        lo, hi, own, fp = rows[2], rows[3], rows[4], rows[5]
        a, z = [], []
        small = np.repeat((size <= 16) & (lo[starts] == hi[starts]), size)
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, 16):                             # short lists: all their pairs, side by side
            i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if len(group) > d else []
            if not len(i):
                break
            i = i[verify(fp[i], fp[i + d], bits)]
            a += fp[i].tolist()
            z += fp[i + d].tolist()
        for s, n in zip(starts, size, strict=True):
            if not small[s]:
                f = fp[s:s + n]
                found = (forest(f, None, bits) if lo[s] == hi[s]
                         else forest(f[own[s:s + n] == lo[s]], f[own[s:s + n] == hi[s]], bits))
                a += [x for x, _ in found]
                z += [y for _, y in found]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the smallest node
    it can reach. Alternates large-star and small-star steps (each a
    groupBy-min and a join) until the stored edges no longer change. The
    smallest neighbours of up to ``held`` edges' nodes are broadcast, so that a
    round of a small table has three shuffles, not six; more are joined by shuffles."""
    def star(e: DataFrame, large: bool, small: bool) -> DataFrame:
        # e: a > b. Large: every larger neighbour of a node goes to its smallest; small: every smaller one.
        low = F.broadcast if small else lambda x: x
        if large:
            both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
            least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
            # a node that is its own smallest keeps the edges its larger neighbours give
            return both.where("b > a").join(low(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        out = e.join(low(least), "a").select(F.explode(pairs).alias("e")).select("e.*")
        return out.where("a <> b").distinct()              # of as many edges at most as twice those before

    def summary(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = summary(e)
    while last[0]:
        small = last[0] <= held
        e = store(star(star(e, True, small), False, small), "edges")
        now = summary(e)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))     # a star per component


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS,
                    keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``fp``, ``root`` (the smallest fingerprint of the
    component, which tells components apart) and ``component_id`` (the smallest
    doc_id reachable over links, its own included) per row of ``docs``."""
    rows = store(fingerprints(docs, shingle, keep), "fingerprints")
    distinct = store(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    linked = components(links(distinct, distinct.count(), bits))
    roots = linked.select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = store(named.join(least, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of ``docs`` (all columns) per component: the one with the
    smallest doc_id, and among rows of that id the one whose row hash is
    smallest. Rows with a null doc_id are kept if their whole component has none."""
    names = docs.columns
    marked = docs.select(*[f"`{c}`" for c in names])
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])
    tag = "_row"
    while tag in names:
        tag += "_"
    marked = marked.withColumn(tag, row)
    found = near_duplicates(marked.select("doc_id", "text", F.col(tag).alias("row_hash")), shingle, bits,
                            ("doc_id", "row_hash"))
    least = (found.groupBy("root")                         # components can share a component_id, null included
             .agg(F.min(F.struct(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).cast("int").alias("k") * -1,
                                 "doc_id", "row_hash")).alias("x")))
    # one key column, so that the join and the removal of repeated rows share one shuffle of the texts;
    # concat_ws leaves a null id out, and an id is always followed by its colon
    key = "_key"
    while key in (*names, tag):
        key += "_"
    least = least.select(F.concat_ws(":", F.col("x.doc_id").cast("string"), F.col("x.row_hash").cast("string")).alias(key))
    marked = marked.withColumn(key, F.concat_ws(":", F.col("doc_id").cast("string"), F.col(tag).cast("string")))
    kept = marked.join(least, key, "left_semi").dropDuplicates([key])
    return kept.select(*[f"`{c}`" for c in names])
