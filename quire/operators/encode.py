"""Text -> vectors and label codes.

M1 is pluggable: an encoder is a function ``Column(text) -> Column(array)``
or a ``mapInPandas`` batch function. The default encoder needs no model
download: whitespace tokens, bucket = first 8 hex digits of ``md5(token)`` mod
``dim``, weight = term count / L2 norm of the counts.

Both forms of the default encoder work in the row, without any shuffle: an
Arrow UDF splits the texts, hashes each distinct token of a batch once and
counts the buckets of many rows together.

* :func:`hashed_embedding` - dense ``array<double>`` per row;
* :func:`hashed_term_weights` - sparse ``(id, bucket, tf, weight)`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_if_null
from .lookup import small_side


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Buckets come from 32 bits of a hash.
MAX_DIM = 1 << 31


def token_bucket(tok, dim: int) -> Column:
    """Bucket of one token: first 8 hex digits of its md5, mod ``dim``."""
    _check(dim)
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def _check(dim: int) -> None:
    if not 0 < dim <= MAX_DIM:
        raise ValueError(f"dim must be 1 to {MAX_DIM}, not {dim}")


class _Buckets(dict):
    """Token -> bucket; a distinct token of a batch is hashed once."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        self[token] = b = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % self.dim
        return b


def _counted(texts: pa.Array, dim: int, rows: int = 500) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For a few texts at a time: their number, and the row and bucket of every token."""
    known = _Buckets(dim)
    for a in range(0, len(texts), rows):
        tokens = [t.split() for t in texts.slice(a, rows).to_pylist()]
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        bucket = np.fromiter((known[w] for t in tokens for w in t), np.int64, int(size.sum()))
        yield len(tokens), np.repeat(np.arange(len(tokens)), size), bucket


# Both encoders are deterministic in fact; flagged otherwise so that Catalyst
# never copies the Python call into an inferred filter (an explode adds
# ``size(v) > 0``), which would run them twice.
def _sparse(dim: int):
    cells = pa.list_(pa.struct([("bucket", pa.int32()), ("tf", pa.int64()), ("weight", pa.float64())]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("tf", T.LongType()),
                                           T.StructField("weight", T.DoubleType())])))
    def enc(texts: pa.Array) -> pa.Array:
        keys, counts, sizes = [], [], []
        for n, row, bucket in _counted(texts, dim):
            key, tf = np.unique(row * dim + bucket, return_counts=True)
            sizes.append(np.bincount(key // dim, minlength=n))
            keys.append(key % dim)
            counts.append(tf)
        if not keys:
            return pa.array([], cells)
        size, tf = np.concatenate(sizes), np.concatenate(counts)
        row = np.repeat(np.arange(len(size)), size)
        norm = np.sqrt(np.bincount(row, weights=tf.astype(float) ** 2, minlength=len(size)))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(keys), pa.int32()), pa.array(tf, pa.int64()), pa.array(tf / norm[row])],
                                          names=["bucket", "tf", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)
    return enc.asNondeterministic()


def _dense(dim: int):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def enc(texts: pa.Array) -> pa.Array:
        parts, step = [np.zeros(0)], max(1, min(500, (1 << 22) // dim))        # rows counted at once: 32 MB of counts
        for n, row, bucket in _counted(texts, dim, step):
            v = np.bincount(row * dim + bucket, minlength=n * dim).reshape(n, dim).astype(np.float64)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            parts.append((v / np.where(norm > 0, norm, 1.0)).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(np.concatenate(parts)))
    return enc.asNondeterministic()


def sparse_terms(text, dim: int = 256) -> Column:
    """``array<struct<bucket, tf, weight>>`` of the non-empty buckets, ascending; of an empty text none."""
    _check(dim)
    return _sparse(dim)(blank_if_null(text))


def hashed_term_weights(df: DataFrame, key: str, text_col: str, dim: int = 256) -> DataFrame:
    """M1 sparse form: ``(key, bucket, tf, weight)`` for every non-empty bucket
    of every row. The row is encoded where it stands to its non-empty buckets
    alone, which are exploded; nothing is shuffled, however often a key occurs."""
    return df.select(key, F.explode(sparse_terms(text_col, dim)).alias("_c")).select(key, "_c.bucket", "_c.tf", "_c.weight")


def hashed_embedding(text, dim: int = 256) -> Column:
    """M1 dense form: L2-normalised hashed term counts, ``array<double>[dim]``;
    an empty text gives the zero vector."""
    _check(dim)
    return _dense(dim)(blank_if_null(text))


def embed_columns(df: DataFrame, key: str, text_cols, dim: int = 256, encoder=None,
                  suffix: str = "_emb") -> DataFrame:
    """M2: embed several text columns side by side (NULL -> ``''`` first, P24).
    ``encoder(col, dim) -> Column`` replaces the default hashed encoder."""
    enc = encoder or hashed_embedding
    cols = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    return df.select(key, *[enc(blank_if_null(c), dim).alias(c + suffix) for c in cols])


def widen(df: DataFrame, vec_col: str, dim: int | None = None, prefix: str | None = None, keep=()) -> DataFrame:
    """``vec`` -> ``vec_0 .. vec_{dim-1}`` scalar columns. The width is
    that of the data; a vector of another length raises (with a given ``dim``
    when its row is read). A null vector gives nulls."""
    p = prefix or vec_col
    v = F.col(vec_col)
    if dim is None:
        r = df.where(v.isNotNull()).agg(F.min(F.size(v)), F.max(F.size(v))).first()
        if r[0] != r[1]:
            raise ValueError(f"{vec_col} has vectors of {r[0]} to {r[1]} values; a wide table needs one length")
        dim = r[0] or 0
    wrong = F.raise_error(F.format_string(f"{vec_col} has %d values, not {dim}", F.size(v)))
    v = F.when(v.isNull() | (F.size(v) == dim), v).otherwise(wrong)
    return df.select(*keep, v.alias("_v")).select(*keep, *[F.get("_v", i).alias(f"{p}_{i}") for i in range(dim)])


def concat_features(*cols) -> Column:
    """Horizontal concatenation of vector blocks (arrays of one element type)."""
    return F.concat(*[F.transform(_col(c), lambda x: x.cast("double")) for c in cols])


def label_codes(df: DataFrame, label_col: str) -> DataFrame:
    """M3: ``(label, code)`` with codes 0..k-1 in ascending label order, stored
    once and marked for broadcast when checked small.

    Works on the distinct-label table (one row per class), never on the rows.
    """
    labels = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label")).distinct()
    return small_side(labels.select(
        "label", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("code")))


def encode_labels(df: DataFrame, label_col: str, out: str = "code", codes: DataFrame | None = None) -> DataFrame:
    """M3 applied: attach the code of each row's label. ``codes``: a table of
    :func:`label_codes` when there is one already."""
    codes = label_codes(df, label_col) if codes is None else codes
    return df.join(codes.select(F.col("label").alias(label_col), F.col("code").alias(out)), on=label_col, how="left")
