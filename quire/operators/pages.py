"""A stored page directory (O2): deep pages and cursors without sorting again.

:func:`store_pages` sorts a table once into range partitions, numbers the rows
of each and stores a directory of one row per partition: its rows, the rows
before it and its last key. After that a page of any depth, or the rows behind
a key (a cursor), is found in the directory and only the partitions it lies in
are read, by number, without a shuffle or a sort.

Defined results: the order is ascending with nulls first; a page behind the end
is empty, and so is every page of an empty table; rows come with their
``position`` (from 0) and in any order. Rows that are equal in all order
columns stand in one fixed order; a cursor goes behind all of them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import is_complete

_PART, _ROW = "_part", "_row"


def store_pages(df: DataFrame, order_cols, dest: str, partitions: int | None = None, overwrite: bool = False) -> str:
    """Sort ``df`` once and store it with its directory at ``dest``; a finished one is kept unless ``overwrite``."""
    spark = df.sparkSession
    if not overwrite and is_complete(spark, f"{dest}/parts"):
        return dest
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    if "position" in df.columns:
        raise ValueError("the rows have a column 'position' already")
    by = (partitions, *order) if partitions else order
    number = F.monotonically_increasing_id()               # (partition << 33) + row
    ranged = (df.repartitionByRange(*by).sortWithinPartitions(*order)
              .withColumns({_PART: F.shiftright(number, 33), _ROW: number.bitwiseAND(F.lit((1 << 33) - 1))}))
    ranged.write.mode("overwrite").partitionBy(_PART).parquet(f"{dest}/rows")
    spark.createDataFrame([(ranged.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{dest}/schema")
    rows = _rows(spark, dest, ranged.schema)
    parts = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    last = rows.join(F.broadcast(parts), _PART).where(F.col(_ROW) == F.col("n") - 1)      # a row per partition
    last = last.select(_PART, "n", F.struct(*order).alias("last"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{dest}/parts")
    return dest


def _schema(spark: SparkSession, dest: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(spark.read.parquet(f"{dest}/schema").first()[0]))


def _rows(spark: SparkSession, dest: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{dest}/rows")


def read_page(spark: SparkSession, dest: str, start: int = 0, max_results: int | None = None) -> DataFrame:
    """The rows at positions ``[start, start + max_results)`` (all from ``start`` on, if no number is given)."""
    parts = spark.read.parquet(f"{dest}/parts").where(F.col("before") + F.col("n") > start)
    if max_results is not None:
        parts = parts.where(F.col("before") < start + max_results)
    found = parts.select(_PART, "before", "n").orderBy(_PART).collect()    # one row per partition of the page
    rows = _rows(spark, dest, _schema(spark, dest))
    names = [c for c in rows.columns if c not in (_PART, _ROW)]
    wanted, at = F.lit(False), F.lit(None).cast("long")
    for r in found:
        mine = F.col(_PART) == r[_PART]
        low, high = max(start - r.before, 0), r.n if max_results is None else min(start + max_results - r.before, r.n)
        inside = low == 0 and high == r.n
        wanted = wanted | (mine if inside else mine & (F.col(_ROW) >= low) & (F.col(_ROW) < high))
    if found:
        offsets = F.create_map(*[F.lit(x).cast("long") for r in found for x in (r[_PART], r.before)])
        at = F.element_at(offsets, F.col(_PART)) + F.col(_ROW)
        rows = rows.where(F.col(_PART).isin([r[_PART] for r in found]))
    return rows.where(wanted).select(*[f"`{c}`" for c in names], at.alias("position"))


def position_after(spark: SparkSession, dest: str, key) -> int:
    """How many rows have order columns up to ``key`` (a tuple of their values): the start of the page behind it."""
    parts = spark.read.parquet(f"{dest}/parts")
    order = parts.schema["last"].dataType
    values = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(order.fields, key, strict=True)])
    hit = parts.where(F.col("last") > values).orderBy(_PART).select(_PART, "before").first()
    if hit is None:
        return parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in order.fields])
    return hit.before + _rows(spark, dest, _schema(spark, dest)).where((F.col(_PART) == hit[_PART]) & (own <= values)).count()


def read_after(spark: SparkSession, dest: str, key, max_results: int | None = None) -> DataFrame:
    """Keyset paging: the next ``max_results`` rows behind the order values ``key``."""
    return read_page(spark, dest, position_after(spark, dest, key), max_results)
