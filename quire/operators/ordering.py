"""Seeded order, exact positions, paging and splits.

The reference shuffles arrays with a seeded generator and slices them by
position. Here the order is a hash of (seed, key). Rows are bucketed by the
leading hex digits of the hash and the buckets are counted (a small table).
A split needs no position per row: the counts name the one bucket in which a
group's threshold lies, the rows of that bucket alone are ranked, and the
threshold row's (hash, key) then decides every row where it stands. A class
holding a third of all rows is still spread over 16^digits buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .lookup import small_side


def seeded_hash(key, seed: int = 14850) -> Column:
    """Hex md5 of ``'<seed>:<key>'``, the sort key of the seeded shuffle."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 14850) -> DataFrame:
    """Deterministic, uniform permutation as a total order ``(hash, key)``."""
    return df.orderBy(seeded_hash(key, seed), F.col(key))


def bucket_counts(df: DataFrame, key: str, seed: int = 14850, partition_by=(),
                  digits: int = 4) -> DataFrame:
    """Rows per (partition key, hash bucket), stored once (reliable checkpoint):
    at most ``groups x 16^digits`` rows, read by the size check, the offsets
    and the split quotas without another pass over the data."""
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    x = df.select(*parts, F.substring(seeded_hash(key, seed), 1, digits).alias("_b"))
    return materialize(x.groupBy(*parts, "_b").agg(F.count(F.lit(1)).alias("_n")))


def dense_position(df: DataFrame, key: str, seed: int = 14850, partition_by=(),
                   out: str = "position", digits: int = 4, counts: DataFrame | None = None) -> DataFrame:
    """Exact 1-based position of each row in the seeded order, within
    ``partition_by`` groups (globally when empty)."""
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    if counts is None:
        counts = bucket_counts(df, key, seed, parts, digits)
    x = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    w = Window.partitionBy(*parts).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(*parts, "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    x = x.join(small_side(offsets), on=[*parts, "_b"], how="inner")
    rw = Window.partitionBy(*parts, "_b").orderBy("_h", key)
    return (x.withColumn(out, (F.col("_off") + F.row_number().over(rw)).cast("bigint"))
            .drop("_h", "_b", "_off"))


def thresholds(df: DataFrame, key: str, counts: DataFrame, quotas: DataFrame, seed: int,
               group: str, digits: int = 4) -> DataFrame:
    """Per group of ``quotas`` (the group column and ``_take``, how many rows
    to take from the front of the seeded order): ``_limit``, the (hash, key)
    of the last row taken, NULL when none is.

    ``counts`` are the groups' bucket counts. Only the rows of the bucket in
    which a quota ends are ranked; all others are decided by their bucket.
    """
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.withColumn("_upto", F.sum("_n").over(w)).join(quotas, on=group)
    edge = (steps.where((F.col("_upto") - F.col("_n") < F.col("_take")) & (F.col("_take") <= F.col("_upto")))
            .select(group, "_b", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_rest")))
    rows = (df.select(group, key, seeded_hash(key, seed).alias("_h"))
            .withColumn("_b", F.substring("_h", 1, digits))
            .join(small_side(edge), on=[group, "_b"]))                     # one bucket of each group
    at = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", key))
    last = (rows.withColumn("_at", at).where(F.col("_at") == F.col("_rest"))
            .select(group, F.struct(F.col("_h").alias("h"), F.col(key).alias("k")).alias("_limit")))
    return quotas.join(last, on=group, how="left").drop("_take")


def _split_by(limit: Column, key: str, seed: int) -> Column:
    mine = F.struct(seeded_hash(key, seed).alias("h"), F.col(key).alias("k"))
    return F.when(limit.isNotNull() & (mine <= limit), "train").otherwise("test")


def positional_split(df: DataFrame, key: str, train_size: int, seed: int = 14850,
                     out: str = "split", digits: int = 4) -> DataFrame:
    """First ``train_size`` rows of the seeded order are ``train``, the
    rest ``test`` (``key`` unique). The rows are not shuffled: all are compared
    with the (hash, key) of the last training row, one row on the driver."""
    counts = bucket_counts(df, key, seed, (), digits)
    upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))   # at most 16^digits rows
    n = counts.agg(F.sum("_n")).first()[0] or 0
    take = min(int(train_size), n)
    edge = (counts.withColumn("_upto", upto)
            .where((F.col("_upto") - F.col("_n") < take) & (F.col("_upto") >= take)).first()) if take > 0 else None
    if edge is None:
        return df.withColumn(out, F.lit("test"))
    rows = df.select(key, seeded_hash(key, seed).alias("_h")).where(F.substring("_h", 1, digits) == edge["_b"])
    rest = take - edge["_upto"] + edge["_n"]
    last = rows.orderBy("_h", key).offset(rest - 1).limit(1).first()       # rows of one bucket
    limit = F.struct(F.lit(last["_h"]).alias("h"), F.lit(last[key]).cast(df.schema[key].dataType).alias("k"))
    return df.withColumn(out, _split_by(limit, key, seed))


def quotas_from_counts(counts: DataFrame, label_col: str, test_size: float = 0.2) -> DataFrame:
    """T2 quotas: per class ``(n_class, n_train, n_test)`` from a class-count
    table ``(label, n_class)``.

    Total test size is ``ceil(test_size * N)``; each class gets
    ``floor(c * n_train / N)`` training rows, and the missing rows go one each
    to the classes with the largest remainder ``(c * n_train) mod N`` (ties:
    smaller label first). Works on one row per class.
    """
    tot = Window.partitionBy()
    q = counts.withColumn("_N", F.sum("n_class").over(tot))
    q = q.withColumn("_ntest", F.ceil(F.col("_N") * F.lit(test_size)).cast("bigint"))
    q = q.withColumn("_ntrain", F.col("_N") - F.col("_ntest"))
    prod = F.col("n_class") * F.col("_ntrain")
    q = q.withColumn("_floor", F.expr("n_class * _ntrain div _N")).withColumn("_rem", prod % F.col("_N"))
    q = q.withColumn("_short", F.col("_ntrain") - F.sum("_floor").over(tot))
    rk = Window.orderBy(F.col("_rem").desc(), F.col(label_col).asc())
    q = q.withColumn("_rank", F.row_number().over(rk))
    q = q.withColumn("n_train", (F.col("_floor") + F.when(F.col("_rank") <= F.col("_short"), 1)
                                 .otherwise(0)).cast("bigint"))
    return q.select(label_col, "n_class", "n_train",
                    (F.col("n_class") - F.col("n_train")).alias("n_test"))


def class_quotas(df: DataFrame, label_col: str, test_size: float = 0.2) -> DataFrame:
    """T2 quotas computed from the rows (see :func:`quotas_from_counts`)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    return quotas_from_counts(counts, label_col, test_size)


def stratified_split(df: DataFrame, key: str, label_col: str, test_size: float = 0.2,
                     seed: int = 42, out: str = "split", check: bool = False,
                     digits: int = 4, min_count: int | None = None,
                     code_col: str | None = None) -> DataFrame:
    """Exact-size stratified split; inside each class, rows are taken in the
    seeded hash order (``key`` unique). With ``check`` a class of fewer than 2
    rows raises.

    ``min_count`` also drops classes with fewer rows (F11) and ``code_col``
    attaches the label code (M3: 0..k-1 in ascending label order over the kept
    classes). The preparation of a training table costs one narrow pass that
    counts rows per (class, hash bucket), small-table work on those counts,
    one narrow pass that ranks the rows of one bucket per class (see
    :func:`thresholds`), and a join of the rows with one row per class, which
    is broadcast when checked small: the rows themselves are not shuffled.
    """
    counts = bucket_counts(df, key, seed, [label_col], digits)
    per_class = counts.groupBy(label_col).agg(F.sum("_n").alias("n_class"))
    if min_count is not None:
        per_class = per_class.where(F.col("n_class") >= min_count)
    quotas = materialize(quotas_from_counts(per_class, label_col, test_size), "quotas")
    if check:
        m = quotas.agg(F.min("n_class")).first()[0]
        if m is not None and m < 2:
            raise ValueError("The least populated class has only 1 member; need at least 2")
    limits = thresholds(df, key, counts, quotas.select(label_col, F.col("n_train").alias("_take")), seed, label_col, digits)
    if code_col:
        codes = quotas.select(label_col, (F.row_number().over(Window.orderBy(label_col)) - 1).cast("bigint").alias(code_col))
        limits = limits.join(codes, on=label_col)
    return (df.join(small_side(limits), on=label_col, how="inner")
            .withColumn(out, _split_by(F.col("_limit"), key, seed)).drop("_limit"))


def page(df: DataFrame, order_cols, start: int = 0, max_results: int | None = None) -> DataFrame:
    """O2 / O3: sorted page ``[start, start + max_results)``.

    The first page is a TakeOrderedAndProject (per-task top-k, then merge).
    For a later one the sorted rows are stored once in range partitions; the
    counts per partition say where the page lies, and only its rows are read
    back: no task holds the rows before the page.
    """
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    if not start:
        out = df.orderBy(*order)
        return out if max_results is None else out.limit(max_results)
    spark = df.sparkSession
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))         # (partition << 33) + row, rising with the order
    ranged = materialize(ranged, "sorted")
    sizes = (ranged.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy("p").collect())                                      # one row per partition
    stop = math.inf if max_results is None else start + max_results
    wanted, before = F.lit(False), 0
    for r in sizes:
        low, high = max(start - before, 0), min(stop - before, r.n)
        if low < high:
            first = r.p << 33
            wanted = wanted | ((F.col("_at") >= first + low) & (F.col("_at") < first + int(high)))
        before += r.n
    out = ranged.where(wanted).drop("_at").orderBy(*order)
    return out if sizes else spark.createDataFrame([], df.schema)


def top_labels(probs, n: int) -> Column:
    """Indices of the ``n`` largest entries of a probability array, largest
    first; ties go to the higher index."""
    p = F.col(probs) if isinstance(probs, str) else probs
    idx = F.transform(p, lambda v, i: F.struct((-v).alias("k"), (-i).alias("j")))
    return F.transform(F.slice(F.array_sort(idx), 1, n), lambda s: -s["j"])


def test_count(n: int, test_size: float = 0.2) -> int:
    return math.ceil(test_size * n)
