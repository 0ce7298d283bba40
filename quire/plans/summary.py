"""Category normalisation -> rare-class filter -> codes -> stratified split ->
one-vs-rest classifier -> accuracy and confusion tables (P9-P11, F11, M3, T2,
M4, M5, A5, A9-A11, J6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import normalised_category
from ..operators import classify, encode, lookup, metrics
from ..session import materialize
from .ablation import prepare


def run_summary(corpus: DataFrame, key: str, features: str, categories: str,
                spec: classify.ClassifierSpec | None = None, encoder=None) -> dict[str, DataFrame]:
    """``corpus`` has a key, a feature column and a category string. Features
    are arrays, or what ``encoder`` makes arrays of; it runs after the split.

    Returns ``accuracy`` (one row), ``cube`` (crosstab with ``All`` margins),
    ``dense`` (zero cells included, truth labels) and ``percent`` (row
    percentages with cell text); labels are decoded names, not codes.
    """
    spec = spec or classify.ClassifierSpec(**classify.SUMMARY_PARAMS)
    x = corpus.select(key, features, normalised_category(categories).alias("label"))
    x = x.where(F.col("label").isNotNull())
    # reused by fit, predict and decode
    split = prepare(x, key, "label")
    if encoder is not None:
        split = split.withColumn(features, encoder(features))
    prepared = materialize(split, "prepared", min_partition_bytes=classify.TRAIN_PARTITION_BYTES)
    v = classify.to_vector(prepared, features)
    model = classify.fit(v.where(F.col("split") == "train"), spec)
    scored = classify.predict_proba(model, v.where(F.col("split") == "test"), spec)
    codes = encode.label_codes(prepared, "label")
    pred = scored.select(key, F.col("code"), F.col("prediction").cast("bigint").alias("pcode"))
    pred = lookup.decode_labels(pred, codes, "code", out_col="actual")
    pred = lookup.decode_labels(pred, codes, "pcode", out_col="predicted")
    acc = scored.agg(metrics.accuracy("prediction", "code").alias("accuracy"),
                     F.count(F.lit(1)).alias("n"))
    counts = metrics.pair_counts(pred, "actual", "predicted")
    dense = metrics.confusion_dense(counts, labels="truth")
    return {"accuracy": acc, "cube": metrics.confusion_cube(counts),
            "dense": dense, "percent": metrics.confusion_percent(dense)}
