"""Key lookups (J1-J4, J6): every positional alignment of the reference is a key join here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store

# Largest side that is broadcast: at most this many rows, and at most this
# many bytes when decoded. Both are read from the stored side: its rows from
# the file footers, its bytes from the file system.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024
# Decoded bytes per stored (compressed, encoded) byte, assumed on the safe side.
DECODED_PER_STORED = 8


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
               max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when its size is proven small, else ``df`` (the join
    then shuffles on the key; AQE may still broadcast at runtime). The rows of
    the join are the same either way.

    The side is stored first, so that the check and the join read the stored
    result and the plan behind it runs once.
    """
    df, nbytes = store(df, "side")
    if nbytes * DECODED_PER_STORED > max_bytes or df.count() > max_rows:
        return df
    return F.broadcast(df)


def lookup_by_id(papers: DataFrame, ids: DataFrame, key: str = "base_id",
                 max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Rows of ``papers`` whose key is in ``ids``; unknown ids drop out,
    repeated requests collapse. ``ids`` may carry extra columns that are kept:
    two versions of one id (``versioned_id``) are two requests."""
    return papers.join(small_side(ids.dropDuplicates(), max_broadcast_rows), on=key, how="inner")


def lookup_left_stub(ids: DataFrame, papers: DataFrame, columns, key: str = "base_id",
                     max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """One row per request with only the needed paper columns (NULL when
    the id is unknown). Only ``columns`` are read from the paper scan, and the
    scan is reduced to the requested ids first."""
    req, _ = store(ids.dropDuplicates(), "ids")
    wanted = small_side(req.select(key).distinct(), max_broadcast_rows)
    side = papers.select(key, *columns).join(wanted, on=key, how="left_semi")
    return req.join(side, on=key, how="left")


def align(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Key join replacing positional alignment."""
    return left.join(right, on=key, how=how)


def zero_fill(ids: DataFrame, vectors: DataFrame, key: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """Left join to vectors; a missing vector becomes ``dim`` zeros (by
    default the longest vector's length)."""
    if dim is None:
        dim = vectors.agg(F.coalesce(F.max(F.size(vec_col)), F.lit(0))).first()[0]
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (ids.join(vectors.select(key, vec_col), on=key, how="left")
            .withColumn(vec_col, F.coalesce(F.col(vec_col), zeros)))


def decode_labels(df: DataFrame, codes: DataFrame, code_col: str, label_col: str = "label",
                  out_col: str | None = None) -> DataFrame:
    """Code -> label through the label dimension (one row per class). Pass
    a table of :func:`encode.label_codes`, which is stored and marked for
    broadcast once, however often it is used."""
    dim = codes.select(F.col("code").alias(code_col), F.col(label_col).alias(out_col or label_col))
    return df.join(dim, on=code_col, how="left")
