"""Evaluation metrics and confusion tables (A5-A13, M5 normalisation).

Row-wise parts (top-n membership, log of the true-class probability) are
array expressions evaluated in the scan stage; the totals are one partial +
final aggregate, so the metrics cost one pass and one tiny shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(scores) -> Column:
    """Row-wise softmax of a numeric array (max-shifted for stability)."""
    s = F.transform(_col(scores), lambda x: x.cast("double"))
    m = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - m))
    tot = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / tot)


def ovr_probability(raw) -> Column:
    """M5: one-vs-rest probabilities from per-class margins: sigmoid of each
    margin, normalised to sum 1 (argmax unchanged)."""
    sig = F.transform(_col(raw), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double"))))
    tot = F.aggregate(sig, F.lit(0.0), lambda a, b: a + b)
    return F.transform(sig, lambda x: x / tot)


def true_prob(probs, label) -> Column:
    """Probability given to the true label (0-based code); 0 when out of range."""
    return F.coalesce(F.get(_col(probs), _col(label)), F.lit(0.0))


def is_label(probs, label, seen=None) -> Column:
    """Is ``label`` one of the labels the probabilities are for? False for NULL,
    for a code out of range and, with ``seen`` (an array of the codes that
    occurred in training), for a code not in it."""
    t = _col(label)
    ok = t.isNotNull() & (t >= 0) & (t < F.size(_col(probs)))
    if seen is not None:
        ok = ok & F.array_contains(_col(seen), t.cast("bigint"))
    return F.coalesce(ok, F.lit(False))


def labels_ahead(probs, label, seen=None) -> Column:
    """How many labels rank above the true one: higher probability, or equal
    probability and higher index (a stable ascending sort keeps those last).
    All labels are ahead of one the probabilities are not for."""
    p = _col(probs)
    t = _col(label)
    pt = true_prob(p, t)
    ahead = F.size(F.filter(p, lambda v, j: (v > pt) | ((v == pt) & (j > t))))
    return F.when(is_label(p, t, seen), ahead).otherwise(F.size(p))


def in_top_n(probs, label, n: int, seen=None) -> Column:
    """True label among the ``n`` most probable (ties: higher index wins);
    false for a label the probabilities are not for."""
    return is_label(probs, label, seen) & (labels_ahead(probs, label, seen) < n)


def mask_unseen(probs, seen) -> Column:
    """Probabilities with those of codes not in ``seen`` set to 0, rescaled to sum 1."""
    kept = F.transform(_col(probs), lambda p, i: F.when(F.array_contains(_col(seen), i.cast("bigint")), p).otherwise(0.0))
    tot = F.aggregate(kept, F.lit(0.0), lambda a, b: a + b)
    return F.transform(kept, lambda p: F.when(tot > 0, p / tot).otherwise(0.0))


def log_true_prob(probs, label) -> Column:
    """A7 term: ``ln p(true)``, ``-inf`` when p is 0 (Spark's ``ln(0)`` is NULL)."""
    pt = true_prob(probs, label)
    return F.when(pt <= 0, F.lit(float("-inf"))).otherwise(F.log(pt))


def accuracy(pred, label) -> Column:
    """A5: share of rows with prediction == label (aggregate expression)."""
    return F.avg((_col(pred) == _col(label)).cast("double"))


def score_table(df: DataFrame, probs: str, label: str, pred: str | None = None,
                ns=(3, 5), extra=(), seen=None, by=()) -> DataFrame:
    """M6 metrics in one aggregate (a row per ``by``): top1 (accuracy of ``pred`` or of the argmax),
    top-n for each n, log-likelihood, perplexity = exp(-LL / N), row count."""
    top1 = accuracy(pred, label) if pred else F.avg(in_top_n(probs, label, 1, seen).cast("double"))
    aggs = [top1.alias("top1")]
    for n in ns:
        aggs.append(F.avg(in_top_n(probs, label, n, seen).cast("double")).alias(f"top{n}"))
    ll = F.sum(log_true_prob(probs, label))
    aggs += [ll.alias("loglikelihood"), F.count(F.lit(1)).alias("n"), *extra]
    out = df.groupBy(*by).agg(*aggs)
    return out.withColumn("perplexity", F.exp(-F.col("loglikelihood") / F.col("n")))


def pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(actual, predicted, cnt)``: the input of the confusion tables, read
    once and stored; at most one row per pair of classes."""
    pairs = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
    return materialize(pairs.agg(F.count(F.lit(1)).alias("cnt")), "pairs")


def confusion_cube(counts: DataFrame) -> DataFrame:
    """Crosstab with margins from :func:`pair_counts`: ``(actual,
    predicted, cnt)``, totals labelled ``All``."""
    g = (counts.select(F.col("actual").cast("string"), F.col("predicted").cast("string"), "cnt")
         .cube("actual", "predicted")
         .agg(F.sum("cnt").alias("cnt"), F.grouping("actual").alias("ga"),
              F.grouping("predicted").alias("gp")))
    return g.select(F.when(F.col("ga") == 1, F.lit("All")).otherwise(F.col("actual")).alias("actual"),
                    F.when(F.col("gp") == 1, F.lit("All")).otherwise(F.col("predicted")).alias("predicted"),
                    "cnt")


# A dense table has the square of this many cells at most.
DENSE_MAX_LABELS = 10_000


def confusion_dense(counts: DataFrame, labels: str = "union", max_labels: int = DENSE_MAX_LABELS) -> DataFrame:
    """A10: long-form dense confusion matrix from :func:`pair_counts`, zero
    cells included.

    ``labels='union'``: rows and columns are every label seen as truth or
    prediction; ``'truth'``: only labels in the truth (other predictions drop).
    The grid is the label array (one row) exploded onto the label table; with
    more than ``max_labels`` labels it raises rather than return a part.
    """
    lab = counts.select(F.col("actual").alias("l"))
    if labels == "union":
        lab = lab.union(counts.select(F.col("predicted").alias("l")))
    lab = lab.where(F.col("l").isNotNull()).distinct()
    k = lab.count()
    if k > max_labels:
        raise ValueError(f"{k} labels make a dense table of {k * k} cells; the bound is {max_labels} labels")
    all_labels = lab.agg(F.array_sort(F.collect_list("l"))).scalar()
    grid = lab.select(F.col("l").alias("actual"), F.explode(all_labels).alias("predicted"))
    return (grid.join(counts, on=["actual", "predicted"], how="left")
            .select("actual", "predicted", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")))


def confusion_percent(dense: DataFrame) -> DataFrame:
    """Row percentages and the cell text of the annotated heat map:
    diagonal ``p%\\nc/rowsum``, zero ``''``, otherwise ``p%\\nc``."""
    w = Window.partitionBy("actual")
    rs = F.sum("cnt").over(w)
    x = dense.withColumn("row_total", rs.cast("bigint"))
    x = x.withColumn("pct", F.when(F.col("row_total") > 0, 100.0 * F.col("cnt") / F.col("row_total")))
    # format_number rounds the binary value half-even, as Python's "%.1f" does
    p = F.concat(F.format_number(F.col("pct"), 1), F.lit("%"))
    txt = (F.when(F.col("actual") == F.col("predicted"),
                  F.concat(p, F.lit("\n"), F.col("cnt").cast("string"), F.lit("/"),
                           F.col("row_total").cast("string")))
           .when(F.col("cnt") == 0, F.lit(""))
           .otherwise(F.concat(p, F.lit("\n"), F.col("cnt").cast("string"))))
    return x.withColumn("cell", txt)


def class_counts(df: DataFrame, label_col: str) -> DataFrame:
    """A2: class frequencies (NULL labels excluded), most frequent first."""
    return (df.where(F.col(label_col).isNotNull()).groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), F.col(label_col)))


def vector_shape(df: DataFrame, vec_col: str) -> DataFrame:
    """``(rows, dim)`` of a vector column (dim = longest vector)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vec_col)).cast("bigint").alias("dim"))
