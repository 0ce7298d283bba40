"""Registered queries (filters, lookups, dedup) over the driver's tables, each with a DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (SQL on the
pre-registered views) return the same columns; every computed column is
aliased to the same name on both sides, doubles are rounded to 6 digits.
Every query reads whole tables; none samples or caps rows except where the
limit is the operator itself (paging).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories as cat
from ..functions import dates, ids
from ..operators import dedup, filters, lookup
from ..sources.tables import table
from . import standins as si
from .registry import ORACLE, QUERIES, register  # noqa: F401

# --------------------------------------------------------------------------
# E1 flagship: id pattern + date range + category -> per-category, per-year count
# --------------------------------------------------------------------------
FLAGSHIP_PATTERN = "1[0-9]+"
FLAGSHIP_START, FLAGSHIP_END = "1996-01-01", "1997-12-31"


@register("flagship_filter_count", f"""
SELECT categories, year, count(*) AS n FROM (
  SELECT o_orderpriority AS categories, CAST(year(o_orderdate) AS INTEGER) AS year
  FROM orders
  WHERE regexp_matches(CAST(o_orderkey AS VARCHAR), '^(?:{FLAGSHIP_PATTERN})')
    AND CAST(o_orderdate AS DATE) >= DATE '{FLAGSHIP_START}'
    AND CAST(o_orderdate AS DATE) <= DATE '{FLAGSHIP_END}')
GROUP BY categories, year""")
def flagship_filter_count(spark, d):
    papers = si.order_papers(spark, d)
    pred = filters.paper_predicate(FLAGSHIP_PATTERN, FLAGSHIP_START, FLAGSHIP_END, anchored=True)
    return (papers.where(pred)
            .groupBy("categories", F.year("created").alias("year"))
            .agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------
# Id patterns
# --------------------------------------------------------------------------
@register("id_regex_search", """
SELECT CAST(p_partkey AS VARCHAR) AS base_id FROM part
WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '12')""")
def id_regex_search(spark, d):
    return filters.list_paper_ids(si.part_papers(spark, d), regex_id="12")


@register("id_regex_match", """
SELECT CAST(o_orderkey AS VARCHAR) AS base_id FROM orders
WHERE regexp_matches(CAST(o_orderkey AS VARCHAR), '^(?:1[0-9]+5)')""")
def id_regex_match(spark, d):
    return filters.list_paper_ids(si.order_papers(spark, d), regex_id="1[0-9]+5", anchored=True)


@register("versioned_ids", r"""
SELECT b AS base_id, b || 'v2' AS versioned_id,
       regexp_replace(b || 'v2', 'v[0-9]+$', '') AS stripped
FROM (SELECT 'solv-int/' || CAST(p_partkey AS VARCHAR) AS b FROM part)
WHERE regexp_matches(b, '^(?:solv-int/1[0-9]*)')
  AND regexp_matches(b || 'v2', '^(?:solv-int/1[0-9]*v2$)')""")
def versioned_ids_q(spark, d):
    papers = table(spark, d, "part").select(
        F.concat(F.lit("solv-int/"), F.col("p_partkey").cast("string")).alias("base_id"))
    v = filters.versioned_ids(papers, "solv-int/1[0-9]*v2$")
    return v.withColumn("stripped", ids.base_id("versioned_id"))


# --------------------------------------------------------------------------
# Category, text, dates
# --------------------------------------------------------------------------
@register("category_any_of", r"""
SELECT CAST(p_partkey AS VARCHAR) AS base_id, p_name AS title FROM part
WHERE list_has_any(list_filter(string_split_regex(p_name, '\s+'), lambda x: x <> ''), ['red', 'bolt'])""")
def category_any_of(spark, d):
    p = si.part_papers(spark, d)
    return p.where(filters.category_any_of("title", ["red", "bolt"])).select("base_id", "title")


@register("text_contains_cased", """
SELECT CAST(p_partkey AS VARCHAR) AS base_id FROM part
WHERE contains(p_brand, 'Brand#1') AND contains(p_name, 'ring')""")
def text_contains_cased(spark, d):
    return filters.list_paper_ids(si.part_papers(spark, d), author="Brand#1", title="ring")


@register("text_contains_uncased", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless')""")
def text_contains_uncased(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(filters.text_contains("text", "WorthLess", case_sensitive=False)).select("doc_id")


_DATES_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS base_id,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS created
FROM orders"""


@register("date_range_both", f"""
SELECT * FROM ({_DATES_SQL}) WHERE created >= DATE '1996-03-01' AND created <= DATE '1996-08-31'""")
def date_range_both(spark, d):
    p = si.order_papers_with_missing_dates(spark, d)
    return p.where(dates.date_in_range("created", "1996-03-01", "1996-08-31"))


@register("date_range_start_only", f"""
SELECT * FROM ({_DATES_SQL}) WHERE created >= DATE '2000-06-01'""")
def date_range_start_only(spark, d):
    p = si.order_papers_with_missing_dates(spark, d)
    return p.where(dates.date_in_range("created", start="2000-06-01"))


@register("date_range_end_only", f"""
SELECT * FROM ({_DATES_SQL}) WHERE created IS NULL OR created <= DATE '1995-04-30'""")
def date_range_end_only(spark, d):
    p = si.order_papers_with_missing_dates(spark, d)
    return p.where(dates.date_in_range("created", end="1995-04-30"))


# --------------------------------------------------------------------------
# F8, F9, O1, A1, A12
# --------------------------------------------------------------------------
@register("list_paper_ids", r"""
SELECT CAST(p_partkey AS VARCHAR) AS base_id FROM part
WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '1')
  AND list_has_any(string_split_regex(p_type, '\s+'), ['ECONOMY', 'SMALL'])
  AND contains(p_brand, 'Brand#1') AND contains(p_name, 'bolt')""")
def list_paper_ids(spark, d):
    return filters.list_paper_ids(si.part_papers(spark, d), regex_id="1",
                                  categories=["ECONOMY", "SMALL"], author="Brand#1", title="bolt")


@register("list_ids_sorted", r"""
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS base_id FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1998-12-31'
  AND list_has_any(string_split_regex(o_orderpriority, '\s+'), ['1-URGENT', '2-HIGH'])
ORDER BY base_id""")
def list_ids_sorted(spark, d):
    return filters.list_ids_sorted(si.order_papers(spark, d), start_date="1998-01-01",
                                   end_date="1998-12-31", categories=["1-URGENT", "2-HIGH"])


@register("count_by_dates", """
SELECT count(*) AS n FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1999-06-30'""")
def count_by_dates(spark, d):
    return filters.count_papers(si.order_papers(spark, d), "1997-01-01", "1999-06-30")


# --------------------------------------------------------------------------
# Lookups by id
# --------------------------------------------------------------------------
@register("lookup_by_id", """
SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d
WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def lookup_by_id(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    req = table(spark, d, "labels").where(F.col("quality") == 1).select("doc_id")
    return lookup.lookup_by_id(docs, req, key="doc_id")


@register("lookup_versions", """
SELECT CAST(p_partkey AS VARCHAR) AS base_id, CAST(p_partkey AS VARCHAR) || v AS versioned_id, p_name AS title
FROM part, (SELECT unnest(['v1', 'v2']) AS v) WHERE p_partkey % 10 = 0""")
def lookup_versions(spark, d):
    """J1 with two versions of an id requested, each repeatedly: both come back, once."""
    papers = si.part_papers(spark, d).select("base_id", "title")
    ids = papers.where(F.col("base_id").cast("long") % 10 == 0).select(
        "base_id", F.explode(F.array(*[F.concat("base_id", F.lit(v)) for v in ("v1", "v2", "v1")])).alias("versioned_id"))
    unknown = ids.select(F.concat(F.lit("x"), "base_id").alias("base_id"), "versioned_id")
    return lookup.lookup_by_id(papers, ids.unionByName(unknown)).select("base_id", "versioned_id", "title")


@register("archive_vocabulary", f"""
SELECT doc_id, pool[1 + doc_id % {len(cat.ARCHIVES)}] AS archive, true AS known, false AS other FROM (
  SELECT doc_id, [{", ".join(f"'{a}'" for a in cat.ARCHIVES)}] AS pool FROM documents)""")
def archive_vocabulary(spark, d):
    """Membership in the vocabulary of archives, for a member and for another word."""
    pool = F.array(*[F.lit(a) for a in cat.ARCHIVES])
    docs = table(spark, d, "documents").select("doc_id", F.element_at(pool, (F.col("doc_id") % len(cat.ARCHIVES)).cast("int") + 1).alias("archive"), "lang")
    return docs.select("doc_id", "archive", cat.is_archive("archive").alias("known"), cat.is_archive("lang").alias("other"))


@register("lookup_left_stub", """
SELECT c.c_custkey AS doc_id, d.lang, d.n_chars
FROM (SELECT DISTINCT c_custkey FROM customer) c LEFT JOIN documents d ON d.doc_id = c.c_custkey""")
def lookup_left_stub(spark, d):
    req = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    docs = table(spark, d, "documents")
    return lookup.lookup_left_stub(req, docs, ["lang", "n_chars"], key="doc_id")


# --------------------------------------------------------------------------
# A3, A4: dedup
# --------------------------------------------------------------------------
_LI_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"


@register("dedup_first", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LI_ORDER}) AS rn FROM lineitem)
WHERE rn = 1""")
def dedup_first(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                            "l_suppkey", "l_quantity", "l_shipdate",
                                            "l_extendedprice", "l_discount", "l_tax")
    order = [c.strip() for c in _LI_ORDER.split(",")]
    return dedup.dedup_by_key(li, "l_orderkey", order, keep="first").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@register("dedup_last", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c.strip() + ' DESC' for c in _LI_ORDER.split(','))}) AS rn
  FROM lineitem)
WHERE rn = 1""")
def dedup_last(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                            "l_suppkey", "l_quantity", "l_shipdate",
                                            "l_extendedprice", "l_discount", "l_tax")
    order = [c.strip() for c in _LI_ORDER.split(",")]
    return dedup.dedup_by_key(li, "l_orderkey", order, keep="last").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@register("distinct_labels", """
SELECT DISTINCT lang, source FROM documents""")
def distinct_labels(spark, d):
    return dedup.distinct_values(table(spark, d, "documents"), "lang", "source")


# the other query modules register themselves on import
from . import catalogue_feeds, catalogue_files, catalogue_ml, catalogue_pipeline, catalogue_text  # noqa: E402,F401
