"""Incremental index build: new snapshot files dropped into a folder are
appended to the Parquet index (S2 / S16 as a Structured Streaming job).

This is the streaming form of the reference's "refresh the local index"
step: the file source remembers which files it has read (in the checkpoint)
and a restarted job continues where it stopped. ``availableNow`` processes
what is there and stops, which suits a scheduled refresh.

Each micro-batch is written by ``foreachBatch`` to its own folder
``batch=<id>`` with overwrite, so a batch replayed after a failure replaces
its own output (exactly once). Inside a micro-batch the rows form a batch
DataFrame, so every record gets an exact source position ``(batch, file,
block, row)``: the "first wins" / "last wins" rules of the batch index hold
for records inside one dropped file and across drops.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import merged
from ..sources.snapshot import POSITION, SNAPSHOT_SCHEMA, index_rows


def snapshot_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of NDJSON snapshot files: parsed records with an ``id``
    and their file and block (the row ordinal is added per micro-batch)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.load(src_dir)
    rec = F.from_json(F.col("value"), SNAPSHOT_SCHEMA, {"mode": "PERMISSIVE"}).alias("record")
    parsed = raw.select(rec, F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_block"))
    return parsed.where(F.col("record.id").isNotNull() & (F.col("record.id") != ""))


def _batch_rows(batch: DataFrame, batch_id: int) -> DataFrame:
    pos = F.struct(F.lit(batch_id).cast("long").alias("batch"), F.col("_file").alias("file"),
                   F.col("_block").alias("block"), F.monotonically_increasing_id().alias("row"))
    return index_rows(batch.select("record", pos.alias(POSITION)))


def _write_batch(dest: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _batch_rows(batch, batch_id)
        rows.write.mode("overwrite").parquet(f"{dest.rstrip('/')}/batch={batch_id}")
    return write


def start_index_ingest(spark: SparkSession, src_dir: str, dest: str, checkpoint: str | None = None,
                       available_now: bool = True, processing_time: str | None = None,
                       max_files_per_trigger: int | None = None):
    """Start the ingest query; returns the ``StreamingQuery``.

    The checkpoint goes under the session's shared checkpoint folder unless
    given. ``available_now=False`` with ``processing_time`` keeps it running;
    ``max_files_per_trigger`` cuts a first run over many files into micro-batches.
    Read the result with ``snapshot.load_index(spark, dest)`` (duplicates are
    resolved by the stored positions).
    """
    return _start(spark, src_dir, dest, _write_batch(dest), checkpoint, available_now, processing_time, max_files_per_trigger)


def start_merged_ingest(spark: SparkSession, src_dir: str, root: str, checkpoint: str | None = None, buckets: int = 64,
                        available_now: bool = True, processing_time: str | None = None,
                        max_files_per_trigger: int | None = None):
    """The same, but every micro-batch is merged into the bucketed index at
    ``root`` (see :mod:`..sources.merged`; made with ``buckets`` by the first
    one): only touched buckets are rewritten and readers need no dedup. The
    manifest names the last merged batch, so a replayed one counts once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _batch_rows(batch, batch_id)
        if merged.versions(batch.sparkSession, root):
            merged.merge_rows(rows, root, batch_id)
        else:
            merged.create_rows(rows, root, buckets, batch_id)

    return _start(spark, src_dir, root, write, checkpoint, available_now, processing_time, max_files_per_trigger)


def _start(spark: SparkSession, src_dir: str, dest: str, write, checkpoint: str | None, available_now: bool,
           processing_time: str | None, max_files_per_trigger: int | None):
    cp = checkpoint or os.path.join(checkpoint_dir(spark), "ingest-" + os.path.basename(dest.rstrip("/")))
    w = (snapshot_stream(spark, src_dir, max_files_per_trigger).writeStream.foreachBatch(write)
         .option("checkpointLocation", cp))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
