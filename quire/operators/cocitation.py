"""Co-citation category features.

Definition (ours; the reference imports it from a package not in its tree):
for paper *x* and category *c*, count the pairs ``(s, y)`` where citing paper
*s* cites both *x* and *y*, ``y != x``, and *y* is a training paper of
category *c*. Test labels never enter. ``share`` = count / total over *x*.

The pairwise form is quadratic in a citing paper's out-degree. It is computed
here without emitting pairs: for each citing paper ``C(s, c)`` = its training
citations per category (a partial aggregate), and

    count(x, c) = sum over s citing x of  C(s, c) - [x is training with category c]

so the work is one row per (edge, category of that citing paper). ``C`` has one
row per citing paper and category; it is broadcast when checked small. Beyond
that ``edges x C`` is joined by shuffles, each side once: only citing papers of
more than ``HUB`` edges are salted, a salt per ``HUB`` edges, and only their
rows of ``C`` are repeated. Hubs are at most one in ``HUB`` edges, so the
shuffles grow with the edges. Both aggregates combine map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, store
from .lookup import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, DECODED_PER_STORED, small_side

HUB = 10_000                          # edges of one citing paper that one task joins


def _with_categories(edges: DataFrame, per_src: DataFrame, max_rows: int, hub: int) -> DataFrame:
    """``edges`` with the rows of ``per_src`` (src, cat, c; without a category: the other edges) of their citing paper."""
    per_src, nbytes = store(per_src, "per-source")
    known = per_src.where(F.col("cat").isNotNull())
    if nbytes * DECODED_PER_STORED <= BROADCAST_MAX_BYTES and known.count() <= max_rows:
        return edges.join(F.broadcast(known), on="src")
    hubs = per_src.groupBy("src").agg(F.ceil(F.sum("c") / hub).cast("int").alias("salts")).where("salts > 1")
    hubs = small_side(hubs)
    salts = F.coalesce("salts", F.lit(1))
    dealt = edges.join(hubs, on="src", how="left").withColumn("_s", F.pmod(F.hash("paper"), salts)).drop("salts")
    salted = known.join(hubs, on="src", how="left").withColumn("_s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(salted, on=["src", "_s"]).drop("_s")


def cocitation_counts(edges: DataFrame, train_labels: DataFrame, src: str = "src",
                      dst: str = "dst", id_col: str = "id", label_col: str = "cat",
                      max_broadcast_rows: int = BROADCAST_MAX_ROWS, hub: int = HUB) -> DataFrame:
    """``(paper, cat, cnt, share)`` for every paper cited at least once, over
    categories with a non-zero count."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("paper")).distinct()
    lab = train_labels.select(F.col(id_col).alias("paper"), F.col(label_col).alias("own_cat"))
    # both branches below read the labelled distinct edges: store them once
    # (one scan and one dedup shuffle of the edges, not two)
    el = materialize(e.join(lab, on="paper", how="left"), "labelled-edges")
    per_src = el.groupBy("src", F.col("own_cat").alias("cat")).agg(F.count(F.lit(1)).alias("c"))
    contrib = _with_categories(el, per_src, max_broadcast_rows, hub).select(
        "paper", "cat",
        (F.col("c") - F.when(F.col("own_cat") == F.col("cat"), 1).otherwise(0)).alias("c"))
    agg = (contrib.groupBy("paper", "cat").agg(F.sum("c").alias("cnt"))
           .where(F.col("cnt") > 0))
    tot = F.sum("cnt").over(Window.partitionBy("paper"))
    return agg.withColumn("share", F.col("cnt") / tot)


def cocitation_vectors(counts: DataFrame, categories: DataFrame, cat_col: str = "cat",
                       value: str = "share") -> DataFrame:
    """Dense per-paper vector over the sorted category list (0 where absent).

    The category list is a one-row scalar subquery; per paper only its own
    non-zero categories are collected (bounded by the number of categories).
    """
    labels = categories.select(F.col(cat_col).alias("l")).where(F.col("l").isNotNull()).distinct()
    all_labels = labels.agg(F.array_sort(F.collect_list("l"))).scalar()
    m = counts.groupBy("paper").agg(
        F.map_from_entries(F.collect_list(F.struct("cat", F.col(value).cast("double")))).alias("m"))
    # the label array is projected first: a subquery cannot sit inside a lambda
    m = m.select("paper", "m", all_labels.alias("_labels"))
    return m.select("paper", F.transform("_labels", lambda lab: F.coalesce(F.col("m")[lab], F.lit(0.0)))
                    .alias("cocitation"))
