"""An index of hash buckets in versions: a drop of new records rewrites only the buckets it touches.

The index holds one row per id, the newest one, in ``buckets`` partitions by a
hash of the id. A version is a manifest that names the folder of every bucket;
a merge writes the touched buckets anew into a folder of its own and then
publishes the next manifest, so

* a read lists files and scans them: no shuffle, no aggregate, no dedup;
* a merge reads and writes the touched buckets only, and moves their rows once;
* a merge that was stopped leaves no manifest: the old version stays whole and
  readable, and the merge can be run again;
* a version that is being read is never overwritten.

Defined results: in a drop the last record of a repeated id counts (the source
position decides), and it replaces the row of an older drop; records without an
id drop out; an empty drop gives a version with the same rows. A merge given a
``batch`` number does nothing when the index has that batch already, so a
replayed micro-batch counts once. Merges into one index go one after another: a
version number that is taken raises.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import dedup_by_key
from ..operators.lookup import small_side
from ..session import hadoop_path, path_exists, store
from .snapshot import POSITION, index_rows, input_bytes, scan_snapshot

BYTES_PER_BUCKET = 1 << 28            # snapshot bytes per bucket
MAX_BUCKETS = 4096


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("base_id"), F.lit(n)).cast("int")


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/manifests/{version:010d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions, oldest first."""
    if not path_exists(spark, f"{root}/manifests"):
        return []
    fs, p = hadoop_path(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """version, buckets, batch, schema and the folder of every bucket of a version (by default the newest)."""
    if version is None:
        found = versions(spark, root)
        if not found:
            raise ValueError(f"no index at {root}")
        version = found[-1]
    return json.loads(spark.read.text(_manifest_path(root, version), wholetext=True).first()[0])


def _publish(spark: SparkSession, root: str, m: dict) -> None:
    """Make a version readable: its manifest is written aside and renamed when whole."""
    fs, path = hadoop_path(spark, _manifest_path(root, m["version"]))
    if fs.exists(path):
        raise RuntimeError(f"version {m['version']} of {root} was published by another merge")
    _, aside = hadoop_path(spark, f"{root}/manifests/{uuid.uuid4().hex}.tmp")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(m).encode()))
    out.close()
    if not fs.rename(aside, path):
        raise RuntimeError(f"version {m['version']} of {root} was published by another merge")


def newest_rows(rows: DataFrame) -> DataFrame:
    """Index rows with a position, one per id: the last; stored, so that they are parsed once."""
    parsed, _ = store(rows, "drop")
    return dedup_by_key(parsed, "base_id", POSITION, keep="last").drop(POSITION)


def _write(rows: DataFrame, root: str, n: int) -> str:
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn("bucket", _bucket(n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}")
    return folder


def _touched(rows: DataFrame, n: int) -> list[int]:
    return [r.bucket for r in rows.select(_bucket(n).alias("bucket")).distinct().collect()]    # at most MAX_BUCKETS numbers


def _read(spark: SparkSession, root: str, m: dict, buckets=None) -> DataFrame:
    schema = T.StructType.fromJson(m["schema"])
    paths = [f"{root}/{folder}/bucket={b}" for b, folder in m["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def create(spark: SparkSession, src, root: str, buckets: int | None = None) -> int:
    """Version 1 from a snapshot; an index that exists already raises."""
    if versions(spark, root):
        raise ValueError(f"there is an index at {root}: merge into it")
    n = buckets or min(MAX_BUCKETS, max(8, input_bytes(spark, src) // BYTES_PER_BUCKET))
    return create_rows(index_rows(scan_snapshot(spark, src)), root, n)


def create_rows(rows: DataFrame, root: str, buckets: int, batch: int = -1) -> int:
    """:func:`create` from index rows with a position."""
    spark = rows.sparkSession
    fresh, _ = store(newest_rows(rows), "newest")
    folder = _write(fresh, root, buckets)
    _publish(spark, root, {"version": 1, "buckets": buckets, "batch": batch, "schema": fresh.schema.jsonValue(),
                           "folders": {str(b): folder for b in _touched(fresh, buckets)}})
    return 1


def merge(spark: SparkSession, src, root: str) -> int:
    """Merge a drop (a snapshot of new and changed records); returns the new version."""
    return merge_rows(index_rows(scan_snapshot(spark, src)), root)


def merge_rows(rows: DataFrame, root: str, batch: int | None = None) -> int:
    """:func:`merge` of index rows with a position; a ``batch`` that was merged before is passed over."""
    spark = rows.sparkSession
    m = manifest(spark, root)
    if batch is not None and batch <= m["batch"]:
        return m["version"]
    fresh, _ = store(newest_rows(rows), "newest")
    touched = _touched(fresh, m["buckets"])
    old = _read(spark, root, m, set(touched)).join(small_side(fresh.select("base_id")), "base_id", "left_anti")
    folder = _write(old.unionByName(fresh), root, m["buckets"])
    m |= {"version": m["version"] + 1, "batch": m["batch"] if batch is None else batch,
          "folders": m["folders"] | {str(b): folder for b in touched}}
    _publish(spark, root, m)
    return m["version"]


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version (by default the newest), one per id, as stored."""
    return _read(spark, root, manifest(spark, root, version))


def lookup(spark: SparkSession, root: str, ids: DataFrame, version: int | None = None) -> DataFrame:
    """The rows of the requested ids, from the buckets they fall in; unknown ids give no row."""
    m = manifest(spark, root, version)
    wanted, _ = store(ids.select(F.col("base_id").cast("string")).where("base_id IS NOT NULL").distinct(), "wanted")
    return _read(spark, root, m, set(_touched(wanted, m["buckets"]))).join(small_side(wanted), "base_id", "left_semi")
