"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged_path
from ..sources.storage import open_fs

END_ID = 2                       # the id appended to every encoded document

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every byte that is neither an ASCII letter or digit nor part
#: of a non-ASCII character becomes a blank: ``split()`` then gives the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, mod: int, held: int) -> Column:
    """True where crc32 of the id as text leaves ``held`` modulo ``mod``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == held, F.lit(False))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it
    back: lineage ends there and lost executors cost nothing."""
    return store_at(df, staged_path(df.sparkSession, name))


def store_at(df: DataFrame, path: str) -> DataFrame:
    """:func:`store` under a given path, for a stage that is deleted before the run ends."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(batch: pa.RecordBatch, name: str = "text", rows: int = 500) -> Iterator[bytes]:
    """The texts of a batch as UTF-8, null as empty; a few are held as Python objects at a time."""
    texts = column(batch, name).cast(pa.binary())
    for a in range(0, len(texts), rows):
        for t in texts.slice(a, rows).to_pylist():
            yield t or b""


def lots(batch: pa.RecordBatch, name: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in consecutive parts whose texts have at most ``size`` bytes together (or that are one row)."""
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column(batch, name)), 0)).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def with_columns(batch: pa.RecordBatch, **values: pa.Array) -> pa.RecordBatch:
    """``batch`` with the named columns replaced in place or appended."""
    arrays, names = list(batch.columns), list(batch.schema.names)
    for k, v in values.items():
        if k in names:
            arrays[names.index(k)] = v
        else:
            arrays.append(v)
            names.append(k)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder below the shared checkpoint folder."""
    uri = staged_path(spark, name)
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    return uri
