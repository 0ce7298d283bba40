"""Best-fit packing with large-item matching.

Documents become pieces of at most ``capacity`` tokens; only longer documents
are cut, and then the first piece is the shorter one. Sizes are whole numbers
up to the capacity, so the whole problem is a histogram of ``capacity``
counts, whatever the number of documents. The plan is made on that histogram:
pieces above one third of the capacity fit at most twice into a sequence and
are paired greedily, the largest with the largest that still fits; smaller
pieces, by falling size, go to the fullest sequence that holds them (best
fit). All sequences of a plan step have the same content, so the plan has a
few thousand rows at most. Spark numbers the pieces of each size and reads
their place from the plan.

Defined results: a null text counts as empty and is a piece of one token (the
end id); repeated documents are placed each; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, store
from .encode import encoder

CAPACITY = 1024


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def plan(counts: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], list[int]]:
    """Sequences for ``counts[size]`` pieces of each size: a list of contents
    {size: pieces} and how many sequences have each."""
    left = [int(c) for c in counts]
    runs: list[list] = []                                  # [number of sequences, free space, content]
    small = capacity // 3
    for a in range(capacity, small, -1):                   # pairs: the largest with the largest that fits
        b = min(a, capacity - a)
        while left[a]:
            while b > small and not left[b]:
                b -= 1
            if b <= small:
                runs.append([left[a], capacity - a, {a: 1}])
                left[a] = 0
            elif a == b:
                pairs, odd = divmod(left[a], 2)
                if pairs:
                    runs.append([pairs, capacity - 2 * a, {a: 2}])
                left[a] = odd
                b -= 1
            else:
                n = min(left[a], left[b])
                runs.append([n, capacity - a - b, {a: 1, b: 1}])
                left[a] -= n
                left[b] -= n
    free: dict[int, list] = {}                             # free space -> its runs
    for r in runs:
        free.setdefault(r[1], []).append(r)
    order = sorted(free)

    def put(r: list) -> None:
        if r[1] not in free:
            bisect.insort(order, r[1])
        free.setdefault(r[1], []).append(r)

    for s in range(small, 0, -1):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at == len(order):                           # no room anywhere: new sequences, filled with this size
                each = min(capacity // s, left[s])
                n = left[s] // each
                r = [n, capacity - each * s, {s: each}]
                left[s] -= n * each
                runs.append(r)
                put(r)
                continue
            space = order[at]
            r = free[space].pop()
            if not free[space]:
                del free[space]
                order.pop(at)
            each = min(space // s, left[s])
            n = min(r[0], left[s] // each)
            if n < r[0]:
                rest = [r[0] - n, space, dict(r[2])]
                runs.append(rest)
                put(rest)
            r[0] = n
            r[1] -= n and each * s
            r[2][s] = r[2].get(s, 0) + each
            left[s] -= n * each
            put(r)
    return [r[2] for r in runs], [r[0] for r in runs]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 per piece, and ``task`` and
    ``nth``: the number of the writing task, and how many pieces of the same
    length it made before. ``with_ids`` adds the ids as an array."""
    docs = docs.select("doc_id", "text")
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
              T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, made = encoder(vocabulary, "<u4"), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            at, out, ids = [], [], []
            for i, x in enumerate(enc.many(column(b, "text"))):
                packed = np.concatenate([x, enc.end]).tobytes()
                for k, (s, n) in enumerate(cut(len(packed) // 4, capacity)):
                    x = packed[4 * s:4 * (s + n)]
                    at.append(i)
                    out.append((k, s, n, zlib.crc32(x), task, made[n]))
                    made[n] += 1
                    if with_ids:
                        ids.append(np.frombuffer(x, "<u4").astype(np.int32))
            if at:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                cols = [column(b, "doc_id").take(pa.array(at)),
                        *(pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True))]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids),
    sequence_id, offset (its place in the sequence)."""
    spark = docs.sparkSession
    made = store(pieces(docs, vocabulary, capacity, with_ids), "pieces")
    per_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():      # at most `capacity` rows
        counts[r.length] = r.n
    contents, times = plan(counts, capacity)
    # per size: first piece number of each plan step, its first sequence, offset, pieces per sequence
    slots: dict[int, list] = {}
    taken, seq = [0] * (capacity + 1), 0
    for content, n in zip(contents, times, strict=True):
        offset = 0
        for size, each in sorted(content.items(), reverse=True):
            slots.setdefault(size, []).append((taken[size], seq, offset, each))
            taken[size] += n * each
            offset += size * each
        seq += n
    table = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in slots.items()})
    before = per_task.withColumn("first", F.expr(
        "sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding)"))
    numbered = made.join(before.select("length", "task", F.coalesce("first", F.lit(0)).alias("first")),
                         ["length", "task"])
    out = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
                          (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, nth = np.asarray(column(b, "length")), np.asarray(column(b, "sequence_id"))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                first, sequence, offset, each = table.value[int(s)]
                k = np.searchsorted(first, nth[rows], "right") - 1
                j, slot = np.divmod(nth[rows] - first[k], each[k])
                seq[rows], off[rows] = sequence[k] + j, offset[k] + slot * s
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols |= {"sequence_id": pa.array(seq), "offset": pa.array(off)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return out.mapInArrow(run, out.schema)
