"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the
columns of ``documents``; the last one returns the pieces of the packed
sequences. ``run`` writes every stage as Parquet into the shared checkpoint
folder and hands the reread table to the next one, so a lost executor costs
one stage at most. No stage caps, samples or drops rows but by its decision;
an empty table passes as an empty table, and extra columns pass unchanged.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, packing, pseudonyms, quality, simhash
from quire.llm.common import fold, read, store
from quire.llm.queries import BYTE_BPE

#: The session's setting that holds the secret key of the pseudonyms.
PSEUDONYM_KEY = "spark.quire.pseudonymKey"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier predicts to be good, learned from the labels of the training fold."""
    _, model = quality.train(docs, read(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 4, 2))
    return quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of each group of linked fingerprints."""
    return simhash.keep_one(docs, shingle=3, bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents a twentieth of whose words stand in benchmark windows."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal values by pseudonyms of their format, under the key in the session's setting PSEUDONYM_KEY."""
    key = spark.conf.get(PSEUDONYM_KEY, None)
    if not key:
        warnings.warn(f"{PSEUDONYM_KEY} is not set: the public demonstration key is used, which anyone can undo", stacklevel=2)
    return pseudonyms.protect(docs, key.encode() if key else pseudonyms.DEMO_KEY)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and fingerprints of 64-bit hashes have no SQL form; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
