"""Metadata snapshot (newline-delimited JSON) -> keyed Parquet index.

The snapshot is read with the text source, so it splits into block-sized
tasks like any line file, and each line is parsed with ``from_json`` against a
fixed schema (no inference pass over the data). Undecodable lines and lines
without an ``id`` drop out. Every row keeps its source position
``(file, block, row)`` so that "first record wins" and "last record wins"
are exact after any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import rfc2822_date
from ..functions.text import blank_if_null, natural_order  # noqa: F401  (part of this module's interface)
from ..operators.dedup import dedup_by_key
from ..session import is_complete, stored_bytes

VERSION = T.StructType([T.StructField("version", T.StringType()),
                        T.StructField("created", T.StringType())])

# Fields of one snapshot record (the public metadata snapshot layout).
SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("submitter", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("comments", T.StringType()),
    T.StructField("journal-ref", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("report-no", T.StringType()),
    T.StructField("categories", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("versions", T.ArrayType(VERSION)),
    T.StructField("update_date", T.StringType()),
    T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType()))),
])

INDEX_COLUMNS = ("categories", "created", "authors", "title", "abstract")
# NDJSON input per output file of the date-sorted index (about 300 MB of Parquet)
SORTED_INPUT_BYTES_PER_FILE = 1 << 30
COMPACT_COLUMNS = ("categories", "created", "authors", "title")
POSITION = "_pos"


def source_position() -> Column:
    """The place of a row in its source: file, block, row. Take it in the scan;
    it keeps the order of lines over any shuffle (files in natural order, see
    :func:`..operators.dedup.with_position_number`)."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row")).alias(POSITION)


def scan_snapshot(spark: SparkSession, path, schema: T.StructType = SNAPSHOT_SCHEMA) -> DataFrame:
    """One row per decodable line with a non-empty ``id``: the parsed
    ``record`` struct and the line's position ``_pos``."""
    raw = spark.read.text(path)
    rec = F.from_json(F.col("value"), schema, {"mode": "PERMISSIVE"}).alias("record")
    parsed = raw.select(rec, source_position())
    return parsed.where(F.col("record.id").isNotNull() & (F.col("record.id") != ""))


def first_version_created(record: Column) -> Column:
    """``versions[0].created``, NULL when there is no version."""
    return F.get(record.getField("versions"), 0).getField("created")


def index_rows(scan: DataFrame, with_metadata: bool = True) -> DataFrame:
    """S2 projection: ``base_id``, categories, created (P1 over P4), authors,
    title, abstract (missing -> ``''``, P3), the full record, the position."""
    r = F.col("record")
    cols = [r.getField("id").alias("base_id"),
            blank_if_null(r.getField("categories")).alias("categories"),
            rfc2822_date(first_version_created(r)).alias("created"),
            blank_if_null(r.getField("authors")).alias("authors"),
            blank_if_null(r.getField("title")).alias("title"),
            blank_if_null(r.getField("abstract")).alias("abstract")]
    if with_metadata:
        cols.append(r.alias("metadata"))
    return scan.select(*cols, POSITION)


def build_index(spark: SparkSession, src, dest: str, overwrite: bool = False,
                layout: str = "none", partitions: int | None = None) -> str:
    """Snapshot -> Parquet index (duplicates kept). ``overwrite=False`` and
    a finished index at ``dest`` -> nothing is done; what an interrupted build
    left there is replaced.

    ``layout='sorted'`` range-partitions by (created, base_id) so each output
    file covers a narrow date range and date filters skip whole files and row
    groups; it costs one shuffle at build time. The number of ranges follows
    the snapshot's size (about ``SORTED_INPUT_BYTES_PER_FILE`` of NDJSON per
    output file), never fewer than the cluster's cores.
    """
    if not overwrite and is_complete(spark, dest):
        return dest
    rows = index_rows(scan_snapshot(spark, src))
    if layout == "sorted":
        n = partitions or max(spark.sparkContext.defaultParallelism,
                              -(-input_bytes(spark, src) // SORTED_INPUT_BYTES_PER_FILE))
        rows = rows.repartitionByRange(n, "created", "base_id").sortWithinPartitions("created", "base_id")
    rows.write.mode("overwrite").parquet(dest)
    return dest


def input_bytes(spark: SparkSession, src) -> int:
    """Total size of the snapshot path(s) (one file-system call per path)."""
    return sum(stored_bytes(spark, p) for p in ([src] if isinstance(src, str) else list(src)))


def build_compact_index(spark: SparkSession, src, dest: str, overwrite: bool = False) -> str:
    """S3: first record per id wins; categories, created, authors, title."""
    if not overwrite and is_complete(spark, dest):
        return dest
    rows = index_rows(scan_snapshot(spark, src), with_metadata=False)
    rows = rows.select("base_id", *COMPACT_COLUMNS, POSITION)
    first = dedup_by_key(rows, "base_id", POSITION, keep="first")
    first.write.mode("overwrite").parquet(dest)
    return dest


def load_index(spark: SparkSession, path: str, cols=None, dedup: str | None = "last") -> DataFrame:
    """``base_id`` + chosen columns (all of :data:`INDEX_COLUMNS` by
    default); a name the index does not have raises. ``dedup='last'`` keeps
    the last record of a repeated id (the reference's dict rule), ``'first'``
    the first, ``None`` keeps duplicates."""
    cols = list(INDEX_COLUMNS) if cols is None else list(cols)
    for c in cols:
        if c != "metadata" and c not in INDEX_COLUMNS:
            raise ValueError(f"the index has no column {c!r}")
    df = spark.read.parquet(path)
    if dedup is None or POSITION not in df.columns:
        return df.select("base_id", *cols)
    return dedup_by_key(df.select("base_id", *cols, POSITION), "base_id", POSITION, keep=dedup) \
        .select("base_id", *cols)


def load_compact(spark: SparkSession, path: str) -> DataFrame:
    """The whole first-wins index."""
    return spark.read.parquet(path).select("base_id", *COMPACT_COLUMNS)


def refresh_index(spark: SparkSession, src, dest_root: str, version: str) -> str:
    """Rebuild into a new versioned path (never overwrite a path being read)."""
    dest = f"{dest_root.rstrip('/')}/v={version}"
    return build_index(spark, src, dest, overwrite=True)


def write_snapshot(df: DataFrame, dest: str) -> str:
    """Write rows as a newline-delimited JSON snapshot (one object per line)."""
    df.write.mode("overwrite").option("compression", "none").json(dest)
    return dest
