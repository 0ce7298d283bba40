"""Point lookups in a snapshot by place (J1, S2): a directory of line offsets.

:func:`build_offsets` scans the newline-delimited JSON files in byte ranges and
stores, per id, where its first and its last record stand: (file, byte offset,
bytes). :func:`lookup_offsets` finds the requested ids in the directory and reads only
the bytes of their lines from the snapshot.

* The scan is cut by bytes (``CHUNK``), not by files: a line belongs to the range
  it starts in, so a file of any size has many tasks and a line of any length is read whole.
* A repeated id is reduced on the map side to its first and last place, so an
  id that holds a third of all lines is one row per task.
* The directory is partitioned by a hash of the id; a lookup reads only the
  partitions its ids fall in, then only the lines' bytes. Near places are read by one task.

Defined results: lines end at a line feed (a carriage return before it is
blank); undecodable lines and lines without an id have no entry; files are
ordered naturally (``part-10`` after ``part-9``) and "last" is the last line of
the last file; an empty snapshot gives an empty directory; an unknown id gives
no row; compressed files raise, as they have no byte offsets. A snapshot that
was changed after its directory was built raises when another record stands at a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import natural_order
from ..operators.lookup import small_side
from ..session import is_complete, store
from .snapshot import INDEX_COLUMNS, POSITION, SNAPSHOT_SCHEMA, index_rows
from .storage import open_fs

CHUNK = 16 << 20                      # bytes of a snapshot file per row of work
BYTES_PER_BUCKET = 1 << 28            # snapshot bytes per partition of the directory
MAX_BUCKETS = 4096
_PLACE = 1 << 40                      # a place as one number: file number * 2^40 + byte offset
_COMPRESSED = r"(?i)\.(gz|bz2|zst|lz4|snappy|xz|deflate)$"


def _files(spark: SparkSession, src) -> DataFrame:
    """path, size and natural number of each file (the content column is not read)."""
    f = spark.read.format("binaryFile").load(src).select(F.col("path"), F.col("length").alias("size"))
    f = f.withColumn("path", F.when(F.col("path").rlike(_COMPRESSED), F.raise_error(
        F.concat(F.lit("a compressed file has no byte offsets: "), "path"))).otherwise(F.col("path")))
    return f.withColumn("file_no", F.row_number().over(Window.orderBy(natural_order("path"), "path")).cast("long"))


def _line_starts(f, begin: int, end: int, size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes from ``begin - 1`` on, and first and last byte (in them) of every line that starts in [begin, end)."""
    at = max(begin - 1, 0)
    data = f.read_at(end - at, at)
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    first = feeds + 1 if begin else np.concatenate([[0], feeds + 1])
    first = first[first < len(data)]
    more, upto = [], at + len(data)
    if len(first) and data[-1:] != b"\n":                 # the last line goes on behind the range
        while upto < size:
            piece = f.read_at(min(1 << 20, size - upto), upto)
            cut = piece.find(b"\n")
            more.append(piece if cut < 0 else piece[:cut])
            upto += len(piece)
            if cut >= 0:
                break
    data = b"".join([data, *more]) if more else data
    last = feeds[np.searchsorted(feeds, first)[np.searchsorted(feeds, first) < len(feeds)]]
    return data, first, np.concatenate([last, [len(data)]])[:len(first)]


def scan_offsets(spark: SparkSession, src, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lines, files): base_id, place, bytes of every record, and the files' numbers."""
    files, _ = store(_files(spark, src), "snapshot-files")
    spans = files.select("path", "size", "file_no", F.explode(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk).cast("long"))).alias("begin"))
    spans = spans.where("size > 0").repartition(F.col("file_no"), F.col("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = open_fs(r["path"])
                with fs.open_input_file(path) as f:
                    begin = r["begin"]
                    data, first, last = _line_starts(f, begin, min(begin + chunk, r["size"]), r["size"])
                at = max(begin - 1, 0)
                for a in range(0, len(first), 4096):      # a few lines a batch
                    x, y = first[a:a + 4096], last[a:a + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r["file_no"] * _PLACE + at + x, pa.int64()), pa.array(y - x, pa.int64()),
                         pa.array([data[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)], pa.binary())],
                        names=["place", "bytes", "line"])

    lines = spans.mapInArrow(run, "place long, bytes long, line binary")
    record = F.from_json(F.col("line").cast("string"), "id string", {"mode": "PERMISSIVE"})
    return lines.select(record.getField("id").alias("base_id"), "place", "bytes").where("base_id <> ''"), files


def build_offsets(spark: SparkSession, src, dest: str, overwrite: bool = False, chunk: int = CHUNK,
                  buckets: int | None = None) -> str:
    """Store the directory of the snapshot ``src`` at ``dest``; a finished one is kept unless ``overwrite``."""
    if not overwrite and is_complete(spark, f"{dest}/ids"):
        return dest
    lines, files = scan_offsets(spark, src, chunk)
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = buckets or min(MAX_BUCKETS, max(8, total // BYTES_PER_BUCKET))
    files.write.mode("overwrite").parquet(f"{dest}/files")
    spark.range(1).select(F.lit(n).cast("int").alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{dest}/layout")
    ids = lines.groupBy("base_id").agg(
        F.min("place").alias("first_place"), F.min_by("bytes", "place").alias("first_bytes"),
        F.max("place").alias("last_place"), F.max_by("bytes", "place").alias("last_bytes"))
    ids = ids.withColumn("bucket", _bucket(n)).repartition(n, "bucket")
    ids.write.mode("overwrite").partitionBy("bucket").parquet(f"{dest}/ids")
    return dest


def _bucket(n: int):
    return F.pmod(F.xxhash64("base_id"), F.lit(n)).cast("int")


def _places(spark: SparkSession, directory: str, ids: DataFrame, keep: str) -> DataFrame:
    """base_id, path, at, bytes of the requested ids, from the partitions they fall in."""
    n = spark.read.parquet(f"{directory}/layout").first()[0]
    wanted, _ = store(ids.select(F.col("base_id").cast("string")).where("base_id IS NOT NULL").distinct()
                      .withColumn("bucket", _bucket(n)), "wanted")
    used = [r.bucket for r in wanted.select("bucket").distinct().collect()]     # at most MAX_BUCKETS numbers
    known = spark.read.schema("base_id string, first_place long, first_bytes long, last_place long, last_bytes long, bucket int") \
        .parquet(f"{directory}/ids").where(F.col("bucket").isin(used))
    found = known.join(small_side(wanted), ["bucket", "base_id"], "left_semi")
    found = found.select("base_id", F.shiftright(f"{keep}_place", 40).alias("file_no"),
                         (F.col(f"{keep}_place") % _PLACE).alias("at"), F.col(f"{keep}_bytes").alias("bytes"))
    return found.join(small_side(spark.read.parquet(f"{directory}/files").select("file_no", "path")), "file_no")


def lookup_offsets(spark: SparkSession, directory: str, ids: DataFrame, keep: str = "last", with_bytes: bool = False) -> DataFrame:
    """J1 by place: ``base_id`` and the index columns of the requested ids (the
    last record of a repeated one, or the ``first``). ``with_bytes`` adds how
    many bytes of the snapshot were read for the row."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    places = _places(spark, directory, ids, keep)
    near = places.repartition(F.col("file_no"), F.floor(F.col("at") / CHUNK)).sortWithinPartitions("file_no", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                lines = []
                for r in part.select(["path", "at", "bytes"]).to_pylist():
                    if r["path"] != name:
                        if f is not None:
                            f.close()
                        fs, path = open_fs(r["path"])
                        name, f = r["path"], fs.open_input_file(path)
                    lines.append(f.read_at(r["bytes"], r["at"]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in ("base_id", "path", "at")),
                     pa.array([len(x) for x in lines], pa.int64()), pa.array(lines, pa.binary())],
                    names=["base_id", "path", "at", "bytes", "line"])
        if f is not None:
            f.close()

    lines = near.mapInArrow(run, "base_id string, path string, at long, bytes long, line binary")
    record = F.from_json(F.col("line").cast("string"), SNAPSHOT_SCHEMA, {"mode": "PERMISSIVE"})
    position = F.struct(F.col("path").alias("file"), F.col("at").alias("block"), F.col("bytes").alias("row"))
    rows = index_rows(lines.select(record.alias("record"), position.alias(POSITION), F.col("base_id").alias("_asked"))
                      .withColumn("record", F.when(F.col("record.id") == F.col("_asked"), F.col("record"))
                                  .otherwise(F.raise_error(F.lit("the snapshot was changed after its directory was built")))),
                      with_metadata=False)
    more = [F.col(f"{POSITION}.row").alias("bytes_read")] if with_bytes else []
    return rows.select("base_id", *INDEX_COLUMNS, *more)
