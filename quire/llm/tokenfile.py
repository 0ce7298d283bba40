"""Token-id files with a shared zstandard dictionary.

A dictionary is trained on the serialised id arrays of 2,000 documents (those
with the smallest hashes of their id and text), of each array at most its first
4,194 bytes (``TRAINING_BYTES / TRAINING_DOCUMENTS``). Documents are ordered
by doc_id over range partitions; every task encodes its documents, compresses
each separately with the dictionary and writes one data file:

    8 bytes  b"QTOKENS1"
    32 bytes SHA-256 of the dictionary
    frames   one zstandard frame per document, its ids as little-endian unsigned 16- or 32-bit numbers

The offset index is a Parquet table (doc_id, file, first byte, bytes, start,
n_tokens) beside the data files, so one short document is read with one ranged
read and one decompression. A task writes under a name of its own attempt and
only committed index rows name files, so a lost executor leaves no trace.

Defined results: a null or empty text is a document of one id, the end id;
equal doc_ids stand together, ordered by a hash of their texts; a null doc_id
comes first; an empty table gives a file set without documents.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, new_folder, open_fs
from .encode import encoder

MAGIC = b"QTOKENS1"
TRAINING_DOCUMENTS, TRAINING_BYTES = 2000, 8 << 20          # bounds of the dictionary's sample
DICTIONARY_BYTES, LEVEL = 64 << 10, 3


def train_dictionary(docs: DataFrame, vocabulary: str, dtype: str, size: int = DICTIONARY_BYTES) -> bytes:
    """The dictionary, or b"" where the sample is too small to train one.

    A threshold on the hash lets about twice the wanted documents through; they
    are encoded and cut where they stand, and only their cut arrays meet in one
    task, which keeps those with the smallest hashes."""
    h = F.xxhash64("doc_id", "text")
    picked, share = docs.select("text", h.alias("h")), 2 * TRAINING_DOCUMENTS / max(1, docs.count())
    if share < 1:
        picked = picked.where(F.col("h") < int(share * 2 ** 64) - 2 ** 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, dtype)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [column(b, "h"), pa.array([np.concatenate([x, enc.end]).tobytes()[:TRAINING_BYTES // TRAINING_DOCUMENTS]
                                           for x in enc.many(column(b, "text"))], pa.binary())], names=["h", "ids"])

    least = picked.mapInArrow(run, "h long, ids binary").orderBy("h", "ids").limit(TRAINING_DOCUMENTS)
    samples = [bytes(r.ids) for r in least.collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=True),
            zstandard.ZstdDecompressor(dict_data=d))


def write(docs: DataFrame, vocabulary: str, dtype: str = "<u2", folder: str | None = None) -> str:
    """Write the file set of all ``docs``; returns its folder. ``dtype``: "<u2" for vocabularies up to 65,536 ids, or "<u4"."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, vocabulary, dtype)
    digest = hashlib.sha256(dictionary).digest()
    fs, path = open_fs(folder)
    with fs.open_output_stream(f"{path}/dictionary") as f:
        f.write(dictionary)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("file", T.StringType()),
                           T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()),
                           T.StructField("at", T.LongType()), T.StructField("bytes", T.LongType()),
                           T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType())])
    held = spark.sparkContext.broadcast(dictionary)        # at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, enc = TaskContext.get().partitionId(), encoder(vocabulary, dtype)
        width, (packer, _) = enc.dtype.itemsize, _codec(held.value)
        out, name, nth, at, before = None, f"part-{part:06d}-{uuid.uuid4().hex}.qtk", 0, 0, 0
        for b in batches:
            rows = []
            for x in enc.many(column(b, "text")):
                if out is None:
                    files, top = open_fs(folder)
                    out = files.open_output_stream(f"{top}/{name}")
                    out.write(MAGIC + digest)
                    at = len(MAGIC) + len(digest)
                ids = np.concatenate([x, enc.end]).tobytes()
                frame = packer.compress(ids)
                out.write(frame)
                rows.append((nth, at, len(frame), before, len(ids) // width))
                nth, at, before = nth + 1, at + len(frame), before + len(ids) // width
            if rows:
                nums = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [column(b, "doc_id"), pa.array([name] * len(rows)), pa.array([part] * len(rows), pa.int32()), *nums],
                    names=schema.names)
        if out is not None:
            out.close()

    tie = F.xxhash64("text")
    ordered = (docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie, F.monotonically_increasing_id())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie))
    local = f"{folder}/local-index"
    ordered.mapInArrow(run, schema).write.parquet(local)
    local = spark.read.schema(schema).parquet(local)
    # tokens before each part: one row per part
    totals = local.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    first = totals.select("file", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    index = local.join(F.broadcast(first), "file")         # a row per data file
    index.select("doc_id", "file", "part", "nth", F.col("at"), "bytes",
                 (F.col("first") + F.col("before")).alias("start"), "n_tokens").write.parquet(f"{folder}/index")
    return folder


def read(spark: SparkSession, folder: str, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit numbers) per document, from the files; ``with_ids`` adds the ids."""
    index = spark.read.parquet(f"{folder}/index")
    fields = [index.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        with fs.open_input_stream(f"{path}/dictionary") as f:
            dictionary = f.read()
        digest, unpacker, name, data = hashlib.sha256(dictionary).digest(), _codec(dictionary)[1], None, None
        for b in batches:
            crc, ids = [], []
            for file, at, size, n in zip(*(column(b, k).to_pylist() for k in ("file", "at", "bytes", "n_tokens")), strict=True):
                if file != name:
                    if data is not None:
                        data.close()
                    name, data = file, fs.open_input_file(f"{path}/{file}")
                    if data.read_at(len(MAGIC) + len(digest), 0) != MAGIC + digest:
                        raise ValueError(f"{file} was not written with this dictionary")
                x = np.frombuffer(unpacker.decompress(data.read_at(size, at)), dtype)
                if len(x) != n:
                    raise ValueError(f"{file}: {len(x)} ids at byte {at}, the index says {n}")
                crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                if with_ids:
                    ids.append(x.astype(np.int32))
            cols = [column(b, "doc_id"), column(b, "start"), column(b, "n_tokens"), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        if data is not None:
            data.close()

    return index.mapInArrow(run, schema)


def read_document(spark: SparkSession, folder: str, doc_id: int, dtype: str = "<u2") -> list[np.ndarray]:
    """The ids of one document (of each, where the id is repeated), by the index: one short read each."""
    fs, path = open_fs(folder)
    with fs.open_input_stream(f"{path}/dictionary") as f:
        unpacker = _codec(f.read())[1]
    out = []
    for r in spark.read.parquet(f"{folder}/index").where(F.col("doc_id") == doc_id).orderBy("start").collect():
        with fs.open_input_file(f"{path}/{r.file}") as f:
            out.append(np.frombuffer(unpacker.decompress(f.read_at(r.bytes, r.at)), dtype))
    return out
