"""Distinct and keyed dedup (A3, A4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import natural_order
from .lookup import small_side


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """A3: distinct values of ``cols`` (partial + final aggregate, no sort)."""
    return df.select(*cols).distinct()


def with_position_number(df: DataFrame, position: str, out: str = "_at") -> DataFrame:
    """``out``: the struct ``position`` (the place of a file block, then a long
    row) as one number of the same order, texts in natural order. The blocks
    are ranked in a table of one row per block; a hash aggregate can keep the smallest of such numbers,
    while a struct with a text in it would be sorted."""
    *places, row = [f.name for f in df.schema[position].dataType.fields]
    place = F.struct(*[F.col(f"{position}.{p}").alias(p) for p in places])
    order = [natural_order(f"_place.{f.name}") if isinstance(f.dataType, T.StringType) else F.col(f"_place.{f.name}")
             for f in df.schema[position].dataType.fields[:-1]]
    ranks = df.select(place.alias("_place")).distinct()
    ranks = small_side(ranks.select("_place", F.row_number().over(Window.orderBy(*order, "_place")).alias("_rank")))
    number = F.col("_rank").cast("decimal(10,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.col(f"{position}.{row}").cast("decimal(19,0)")
    return df.withColumn("_own", place).join(ranks, F.col("_own") == F.col("_place")).withColumn(out, number).drop("_own", "_place", "_rank")


def _is_position(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and len(kind.fields) > 1 and isinstance(kind.fields[-1].dataType, T.LongType)


def dedup_by_key(df: DataFrame, key, ordinal, keep: str = "first") -> DataFrame:
    """A4: one row per key, the one with the smallest (``first``) or largest
    (``last``) ordinal.

    The winning ordinal per key comes from a narrow projection (key and
    ordinal only), reduced on the map side, so a key holding a third of all
    rows ships one row per task. The wide rows are then semi-joined to the
    winners on (key, ordinal): they move once, unsorted rows are never
    aggregated. ``ordinal`` (a column name or a list) must be a total order of
    a key's rows; nulls in it come first. A source position is reduced as one
    number (:func:`with_position_number`). The rows are read once for the
    projection and once for the join: store them first if they are parsed.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    keys = [key] if isinstance(key, str) else list(key)
    order = [ordinal] if isinstance(ordinal, str) else list(ordinal)
    if len(order) == 1 and _is_position(df.schema[order[0]].dataType):
        numbered = with_position_number(df, order[0])
        return dedup_by_key(numbered, key, "_at", keep).select(*df.columns)
    pick = F.min if keep == "first" else F.max
    if len(order) == 1:                                    # nulls come first: the smallest, if there are any
        best = pick(order[0])
        if keep == "first":
            best = F.when(F.count(order[0]) == F.count(F.lit(1)), best)
        winners = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("_o0"))
        return _semi_join(df, winners, keys, order)
    best = (df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
            .agg(pick(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])).alias("_best"))
            .select("*", "_best.*").drop("_best"))
    return _semi_join(df, best, keys, order)


def _semi_join(df: DataFrame, best: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    same += [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)]
    return df.join(best, reduce(lambda a, b: a & b, same), "left_semi")
