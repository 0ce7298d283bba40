"""MinHash fingerprints of documents, and the near-duplicates they find.

A text is the set of its shingles: five consecutive words `[^\\x20\\x09-\\x0D]+`
after A-Z became a-z (a text of fewer words is one shingle, one without words
none). Shingles are 64-bit hashes; ``PERMUTATIONS`` random permutations
``a * x + b`` of the 64-bit numbers (odd ``a``) each name the smallest, and a
fingerprint keeps one byte of each. The likeness of two fingerprints is the
share of equal bytes, less the 1 in 256 that are equal by chance.

:func:`fingerprints` also describes the *edited* text of each document: its
last half replaced by the beginning of the next document, ascending doc_id
(texts of one id by their MD5). Texts meet their successor in one shuffle of
compressed texts by range; the rows at the ends of partitions are joined to
the next partition's first row, so no task sees more than its range.

:func:`near_duplicates` joins signature bands in Spark: texts of equal shingle
sets are one class, ``BANDS`` bands of five bytes list the classes that may be
alike, and a star per list gives candidate groups without their pairs. A
group's texts then meet in one task (or, beyond ``CHUNK`` bytes, in one task
per pair of chunks), the Jaccard similarity of their sets is computed exactly,
and the links with at least ``THRESHOLD`` make the components. Two texts of
similarity 0.8 share a band with a probability of 0.99995, alike ones more.

Defined results: a null or empty text has no shingles, fingerprint zero and an
empty edited text; texts without words are one class; repeated rows are
returned each, a row's next document may be its own copy; a null doc_id comes
first in the order and names a component only if all its ids are null; the
next document of a single row is the row itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest, xxh128_digest

from ..operators.lookup import small_side
from .classlm import split
from .common import column, lots, store
from .simhash import components

SHINGLE, THRESHOLD = 5, 0.8
PERMUTATIONS, BANDS, BAND = 128, 25, 5                    # 25 bands of five bytes; three bytes more sharpen the likeness
EQUAL = 80                            # equal bytes below which no similarity of 0.8 is expected (one in five million)
CHUNK = 16 << 20                      # compressed bytes of a group's texts compared at once
LOT = 1 << 20                         # compressed bytes of text handled at once (or one text)
_RANDOM = np.random.default_rng(20_11)
_A = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and where each text's begin (one entry more than texts)."""
    words, row = split(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"]))
    known = np.array([xxh64_intdigest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    h = known[np.asarray(words.indices)] if len(row) else np.zeros(0, np.uint64)
    n = np.bincount(row, minlength=len(texts))
    place = np.arange(len(h))
    at = place - (np.cumsum(n) - n)[row]
    left = n[row] - at                                     # words from here to the text's end
    value = np.zeros(len(h), np.uint64)
    for k in range(size):
        value = np.where(left > k, value * _ODD + h[np.minimum(place + k, len(h) - 1)], value) if len(h) else value
    some = (left >= size) | (at == 0)                      # a text of fewer words is one shingle
    return _mixed(value[some]), np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=len(texts)))])


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A byte of the smallest permuted shingle for each text and permutation; zeros for a text without shingles."""
    out = np.zeros((len(offsets) - 1, PERMUTATIONS), np.uint8)
    some = np.flatnonzero(np.diff(offsets))
    starts, ends = offsets[some], offsets[some + 1]
    a = 0
    while a < len(some):                                   # so many texts that their numbers stay in the cache
        z = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 15), "right")))
        x, cuts = values[starts[a]:ends[z - 1]], starts[a:z] - starts[a]
        least, held = np.empty((PERMUTATIONS, z - a), np.uint64), np.empty_like(x)
        for k in range(PERMUTATIONS):
            np.multiply(x, _A[k], out=held)
            np.add(held, _B[k], out=held)
            np.minimum.reduceat(held, cuts, out=least[k])
        out[some[a:z]] = (_mixed(least) >> np.uint64(56)).astype(np.uint8).T
        a = z
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the texts behind rows of signatures."""
    return np.maximum(((a == b).mean(1) - 1 / 256) / (1 - 1 / 256), 0.0)


def set_digests(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits for each set of shingles, the same for equal sets."""
    return [xxh128_digest(np.unique(values[a:z]).tobytes()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]


def _unpacked(packed: pa.Array) -> list[str]:
    inflate = zstandard.ZstdDecompressor()
    return [inflate.decompress(z).decode("utf-8", "replace") for z in packed.to_pylist()]


def _packed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``z``, the compressed ``text``: shuffles move a third of its bytes."""
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=3)
        for b in (x for y in batches for x in lots(y)):
            texts = pc.fill_null(column(b, "text").cast(pa.large_binary()), b"").to_pylist()
            z = pa.array([deflate.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in keep], z], names=schema.names)

    return rows.select(*keep, "text").mapInArrow(run, schema)


def _text_key():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_chars, edited_sha256, fp, edited_fp (bytes), near_edited, near_next, and what
    :func:`near_duplicates` needs (``set_id``, ``text_id``) per row of ``docs``; stored."""
    spark = docs.sparkSession
    names = list(dict.fromkeys(["doc_id", *keep]))
    rows = docs.select(*names, _text_key().alias("text_id"), F.monotonically_increasing_id().alias("_nth"), "text")
    order = ["doc_id", "text_id", "_nth"]                  # the last deals out copies of one row
    rows = _packed(rows, [*names, "text_id", "_nth"]).repartitionByRange(*order).sortWithinPartitions(*order)
    own = [*rows.select(*names, "text_id").schema.fields, T.StructField("fp", T.BinaryType()), T.StructField("set_id", T.BinaryType()),
           T.StructField("z", T.BinaryType())]
    made = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.BinaryType()), T.StructField("edited_fp", T.BinaryType()),
            T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    result = T.StructType([*own[:-1], *made])
    schema = T.StructType([*own, *made, T.StructField("part", T.LongType()), T.StructField("role", T.IntegerType())])
    own_names = [f.name for f in own]
    arrow = {"n_chars": pa.int64(), "edited_sha256": pa.binary(), "edited_fp": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def described(b: pa.RecordBatch) -> tuple[pa.RecordBatch, list[str], np.ndarray]:
        """The own columns of sorted rows, their texts and signatures."""
        texts = _unpacked(column(b, "z"))
        found = shingles(texts, shingle)
        sigs = signatures(*found)
        fp = pa.array([s.tobytes() for s in sigs], pa.binary())
        cols = [*[column(b, c) for c in [*names, "text_id"]], fp, pa.array(set_digests(*found), pa.binary()), column(b, "z")]
        return pa.RecordBatch.from_arrays(cols, names=own_names), texts, sigs

    def finished(b: pa.RecordBatch, texts: list[str], sigs: np.ndarray, next_texts: list[str], next_sigs: np.ndarray) -> list[pa.Array]:
        """The columns made of rows and of the rows behind them."""
        edited = [t[:len(t) - len(t) // 2] + x[:len(t) // 2] for t, x in zip(texts, next_texts, strict=True)]
        edited_sigs = signatures(*shingles(edited, shingle))
        values = ([len(t) for t in texts], [hashlib.sha256(t.encode()).digest() for t in edited], [s.tobytes() for s in edited_sigs],
                  likeness(sigs, edited_sigs), likeness(sigs, next_sigs))
        return [pa.array(v, t) for v, t in zip(values, arrow.values(), strict=True)]

    def rest(b: pa.RecordBatch, part: int, role: int, made: list[pa.Array] | None = None) -> pa.RecordBatch:
        made = made or [pa.nulls(b.num_rows, t) for t in arrow.values()]
        return pa.RecordBatch.from_arrays([*b.columns, *made, pa.array([part] * b.num_rows, pa.int64()), pa.array([role] * b.num_rows, pa.int32())],
                                          names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for x in (x for y in batches for x in lots(y, "z", LOT)):
            b, texts, sigs = described(x)
            if last is None:
                yield rest(b.slice(0, 1), part, 1)         # for the partition before
            else:
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([p, q]) for p, q in zip(last[0].columns, b.columns, strict=True)], names=own_names)
                texts, sigs = last[1] + texts, np.concatenate([last[2], sigs])
            done = b.slice(0, b.num_rows - 1)
            if done.num_rows:
                found = finished(done, texts[:-1], sigs[:-1], texts[1:], sigs[1:])
                done = pa.RecordBatch.from_arrays([*done.columns[:-1], pa.nulls(done.num_rows, pa.binary())], names=own_names)
                yield rest(done, part, 0, found)
            last = b.slice(b.num_rows - 1, 1), texts[-1:], sigs[-1:]
        if last is not None:
            yield rest(last[0], part, 2)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for y in batches for x in lots(y, "z", LOT)):
            sig = [np.frombuffer(b"".join(column(x, c).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for c in ("fp", "next_fp")]
            found = finished(x, _unpacked(column(x, "z")), sig[0], _unpacked(column(x, "next_z")), sig[1])
            yield pa.RecordBatch.from_arrays([*[column(x, c) for c in own_names[:-1]], *found], names=result.names)

    found = store(rows.mapInArrow(run, schema), "fingerprints")
    heads = found.where("role = 1")
    parts = sorted(r.part for r in heads.select("part").collect())             # one number per task
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, next long")
    heads = small_side(heads.select(F.col("part").alias("next"), F.col("z").alias("next_z"), F.col("fp").alias("next_fp")))
    ends = found.where("role = 2").select("part", *own_names).join(F.broadcast(follows), "part").join(heads, "next").mapInArrow(across, result)
    return found.where("role = 0").select(*result.names).unionByName(store(ends, "ends"))      # a row per task; read again for each result


def _jaccard(sets: list[np.ndarray], v: int, others: np.ndarray) -> np.ndarray:
    """Similarity of set ``v`` and each of ``others``, none of which is empty."""
    size = np.array([len(sets[o]) for o in others])
    flat = np.concatenate([sets[o] for o in others])
    at = np.searchsorted(sets[v], flat)
    at[at == len(sets[v])] = 0
    both = np.add.reduceat((sets[v][at] == flat).astype(np.int64), np.cumsum(size) - size)
    return both / (size + len(sets[v]) - both)


def _forest(sets: list[np.ndarray], sigs: np.ndarray, side: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between the sets (between the two sides, if given)."""
    full = np.array([len(s) > 0 for s in sets])
    todo, out = np.flatnonzero(full), []
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            v = queue.pop()
            near = (sigs[todo] == sigs[v]).sum(1) >= EQUAL
            if side is not None:
                near &= side[todo] != side[v]
            if near.any():
                near[near] = _jaccard(sets, v, todo[near]) >= threshold - 1e-12
                reached, todo = todo[near], todo[~near]
                out += [(v, w) for w in reached]
                queue += reached.tolist()
    return out


def links(docs: DataFrame, classes: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """a, b: edges with the components of all links among ``classes`` (``cid``, ``fp``, ``text_id`` of one of their texts)."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("fp", BAND * k + 1, BAND)) for k in range(BANDS)])
    listed = classes.where(F.col("fp") != F.lit(bytes(PERMUTATIONS))).select("cid", F.explode(keys).alias("key"))
    lists = listed.groupBy("key").agg(F.min("cid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = listed.join(lists, "key").where("cid <> first").select(F.col("cid").alias("a"), F.col("first").alias("b"))
    groups = components(stars).select(F.col("node").alias("cid"), F.col("root").alias("grp"))
    groups = groups.unionByName(groups.select(F.col("grp").alias("cid"), "grp").distinct())      # a root is no node of its own
    members = store(classes.join(groups, "cid"), "members")
    # one text of each class: copies that pass the join are reduced where they stand
    texts = (docs.select(_text_key().alias("text_id"), "text").join(small_side(members.select("text_id", "cid")), "text_id"))
    texts = _packed(texts, ["cid"]).groupBy("cid").agg(F.any_value("z").alias("z"))
    texts = store(members.select("grp", "cid", "fp").join(texts, "cid"), "texts")
    sizes = texts.groupBy("grp").agg(F.ceil(F.sum(F.octet_length("z")) / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                        lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi"), own.alias("own")))
    by = ["grp", "lo", "hi"]
    dealt = (texts.join(sizes, "grp").select("grp", "cid", "fp", "z", F.explode(pairs).alias("c"))
             .select("grp", "c.lo", "c.hi", "c.own", "cid", "fp", "z").repartition(*by).sortWithinPartitions(*by))

    def edges(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        cid, sides = np.asarray(t["cid"]), np.asarray(t["own"])
        values, offsets = shingles(_unpacked(t["z"]), shingle)
        sets = [np.unique(values[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        sigs = np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)
        found = _forest(sets, sigs, sides if t["lo"][0] != t["hi"][0] else None, threshold)
        return pa.RecordBatch.from_arrays([pa.array([cid[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None                              # the rows of one pair of chunks
        for b in batches:
            key = np.stack([np.asarray(column(b, k)).astype(np.int64) for k in by])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z == a:
                    continue
                if held and last != key[:, a].tolist():
                    yield edges(held)
                    held = []
                held.append(b.slice(a, z - a))
                last = key[:, a].tolist()
        if held:
            yield edges(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, rows: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """``rows`` of :func:`fingerprints` of ``docs`` with ``component_id``: the smallest doc_id
    that links of a Jaccard similarity of at least ``threshold`` reach, the own included."""
    classes = rows.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("text_id").alias("text_id"), F.any_value("fp").alias("fp"))
    classes = store(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = components(links(docs, classes, shingle, threshold, chunk)).select(F.col("node").alias("cid"), "root")
    named = classes.select("set_id", "doc_id", "cid").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = store(named.join(least, "root").select("set_id", "component_id"), "named")
    return rows.join(named, "set_id").drop("set_id", "text_id")
