"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any scale: AQE re-plans joins and coalesces shuffle
# output at runtime, skew-join splits hot partitions, UTC keeps date maths
# independent of the machine.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "quire",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster leave ``master`` unset so spark-submit decides, and let the
    cluster's own ``spark.sql.shuffle.partitions`` stand unless given here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset
    and the driver is the single executor (master ``local`` or ``local[..]``,
    as in tests) a scratch folder is made and registered; with executors of
    their own an unset folder is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


# Stages stored by the run this thread is in; None outside of :func:`stored_stages`.
_RUN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("quire-run", default=None)


@contextlib.contextmanager
def stored_stages(spark: SparkSession) -> Iterator[list[str]]:
    """One run: the stages and staged files written inside the ``with`` block
    are deleted at its end, so write the results before. Every run has its own
    list; other threads, sessions and nested runs are not touched. Stages
    stored outside of a run stay in the checkpoint folder, whose clean-up is
    the cluster's."""
    token = _RUN.set([])
    try:
        yield _RUN.get()
    finally:
        paths = _RUN.get()
        _RUN.reset(token)
        for p in paths:
            delete_path(spark, p)


def materialize(df: DataFrame, name: str = "stage", min_partition_bytes: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` once as a Parquet table in the shared
    checkpoint folder and read it back.

    One pass computes and stores the plan (``Dataset.checkpoint`` would compute
    it twice: once to count, once to write, unless it is cached first). The
    stored table survives lost executors. Read back, it carries file-size
    statistics for the join planner, and later filters and projections reach
    its scan.

    ``min_partition_bytes`` is for tables that iterative jobs scan many times
    (model fitting): the read-back is coalesced (no shuffle) so that each
    partition holds at least that many stored bytes, because every iteration
    pays a fixed cost per task. A big table keeps all its splits.
    """
    out, nbytes = store(df, name)
    if min_partition_bytes:
        want = max(1, -(-nbytes // min_partition_bytes))
        if want < out.rdd.getNumPartitions():
            out = out.coalesce(want)
    return out


def store(df: DataFrame, name: str = "stage") -> tuple[DataFrame, int]:
    """:func:`materialize` without coalescing; also returns the stored size in
    bytes (one file-system call), which size checks use before a broadcast."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path), stored_bytes(spark, path)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, never used before, that
    the current run (see :func:`stored_stages`) deletes at its end."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    if _RUN.get() is not None:
        _RUN.get().append(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) handles of the cluster's own file system client."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path``, which may be a glob (one file-system call per match)."""
    fs, p = hadoop_path(spark, path)
    found = fs.globStatus(p)
    return sum(int(fs.getContentSummary(s.getPath()).getLength()) for s in found or [])


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return bool(fs.delete(p, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of ``path`` (any scheme)."""
    fs, p = hadoop_path(spark, path)
    return bool(fs.exists(p))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Was the table at ``path`` written to its end? A writer leaves ``_SUCCESS`` when its job commits."""
    return path_exists(spark, os.path.join(path, "_SUCCESS"))
