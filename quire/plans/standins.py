"""Bindings of the engine's data model to the driver's tables.

None of the driver's tables holds paper metadata, so each operator runs on a
stand-in with the same shape (see README, "Stand-in tables"):

* ``part``   -> papers with a title (``p_name``), categories (``p_type``) and an author field (``p_brand``)
* ``orders`` -> dated papers (``o_orderdate``) with a category (``o_orderpriority``)
* ``lineitem`` -> citation edges (``l_orderkey`` cites ``l_partkey``)
* ``documents`` / ``embeddings`` / ``labels`` / ``pages`` -> texts, vectors, labels, HTML artefacts
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def part_papers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("base_id"),
                    F.col("p_type").alias("categories"),
                    F.col("p_brand").alias("authors"),
                    F.col("p_name").alias("title"))


def order_papers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("base_id"),
                    F.col("o_orderdate").cast("date").alias("created"),
                    F.col("o_orderpriority").alias("categories"),
                    F.col("o_orderstatus").alias("status"))


def order_papers_with_missing_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dated papers where the status-``P`` rows have no date (exercises the null rule)."""
    o = table(spark, d, "orders")
    created = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("date")) \
        .otherwise(F.col("o_orderdate").cast("date"))
    return o.select(F.col("o_orderkey").cast("string").alias("base_id"), created.alias("created"))


def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("src"),
                     F.col("l_partkey").cast("string").alias("dst"))
