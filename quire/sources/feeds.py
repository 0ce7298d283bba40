"""Atom feed pages and OAI-PMH identifier listings, read from staged XML files.

HTTP paging is not part of the engine: pages are staged to storage and read
with Spark's XML source, one task per file split. The schema is always given:
inference read a title like ``T2`` as a timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_in_range, iso_day
from ..functions.ids import base_id, id_from_url
from ..functions.text import strip
from ..operators.dedup import dedup_by_key
from ..session import is_complete, materialize
from .snapshot import POSITION, source_position

_S = T.StringType()

# Atom <entry> as read with ignoreNamespace (arxiv:comment -> comment, ...);
# attributes carry the "_" prefix.
ENTRY_SCHEMA = T.StructType([
    T.StructField("id", _S),
    T.StructField("published", _S),
    T.StructField("updated", _S),
    T.StructField("title", _S),
    T.StructField("summary", _S),
    T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", _S)]))),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", _S)]))),
    T.StructField("primary_category", T.StructType([T.StructField("_term", _S)])),
    T.StructField("comment", _S),
    T.StructField("journal_ref", _S),
    T.StructField("doi", _S),
    T.StructField("link", T.ArrayType(T.StructType([T.StructField("_rel", _S),
                                                     T.StructField("_href", _S),
                                                     T.StructField("_title", _S)]))),
])

# OAI-PMH <header> (identifier listing).
HEADER_SCHEMA = T.StructType([
    T.StructField("identifier", _S),
    T.StructField("datestamp", _S),
    T.StructField("setSpec", T.ArrayType(_S)),
])


def read_feed_entries(spark: SparkSession, path, schema: T.StructType = ENTRY_SCHEMA,
                      position: bool = False) -> DataFrame:
    """``<entry>`` rows of staged Atom pages; with ``position`` also their
    place in the pages (:data:`snapshot.POSITION`)."""
    rows = (spark.read.format("xml").schema(schema)
            .option("rowTag", "entry").option("ignoreNamespace", True)
            .load(path))
    return rows.select("*", source_position()) if position else rows


def project_entries(entries: DataFrame, full: bool = False, old_ids: bool = False) -> DataFrame:
    """Batch projection ``(id, published, published_date,
    categories, title, abstract)``; ``full`` adds authors, updated,
    primary_category, comment, journal_ref, doi, links (NULL when absent)."""
    vid = id_from_url("id", old_ids=old_ids)
    cols = [vid.alias("id"), base_id(vid).alias("base_id"), F.col("published"),
            iso_day("published").alias("published_date"),
            F.transform("category", lambda c: c["_term"]).alias("categories"),
            strip("title").alias("title"), strip("summary").alias("abstract")]
    if full:
        cols += [F.col("updated"),
                 F.transform("author", lambda a: a["name"]).alias("authors"),
                 F.col("primary_category._term").alias("primary_category"),
                 F.col("comment"), F.col("journal_ref"), F.col("doi"),
                 F.transform("link", lambda lk: F.struct(lk["_rel"].alias("rel"),
                                                         lk["_href"].alias("href"))).alias("links")]
    if POSITION in entries.columns:
        cols.append(F.col(POSITION))
    return entries.select(*cols)


def entries_as_papers(entries: DataFrame) -> DataFrame:
    """Feed rows in the papers layout (so one filter serves both sources)."""
    p = project_entries(entries, full=True)
    more = [c for c in ("id", POSITION) if POSITION in p.columns]
    # only these fields are parsed and stored, not the links, comments and references
    p = p.select("base_id", F.array_join("categories", " ").alias("categories"),
                 F.col("published_date").alias("created"),
                 F.array_join("authors", ", ").alias("authors"), "title", "abstract", *more)
    if more:                                               # overlapping pages: the last entry of an id
        p = dedup_by_key(materialize(p, "entries"), "id", POSITION, keep="last").drop(*more)     # the pages are parsed once
    return p


def open_papers(spark: SparkSession, index: str | None = None, feed=None) -> DataFrame:
    """The papers to filter: the local index when there is a finished
    one, else the staged feed pages; one of them must be there."""
    if index and is_complete(spark, index):
        return spark.read.parquet(index)
    if feed:
        return entries_as_papers(read_feed_entries(spark, feed, position=True))
    raise FileNotFoundError(f"no finished index at {index!r} and no feed pages given")


def read_oai_headers(spark: SparkSession, path) -> DataFrame:
    """OAI-PMH ``<header>`` rows ``(identifier, datestamp, setSpec[])``."""
    return (spark.read.format("xml").schema(HEADER_SCHEMA)
            .option("rowTag", "header").option("ignoreNamespace", True).load(path))


def list_identifiers(headers: DataFrame, start=None, end=None, set_spec: str | None = None) -> DataFrame:
    """Identifiers with a datestamp in range and, optionally, in a set or
    in one of its subsets (``physics`` holds ``physics:hep-ph``)."""
    d = F.try_to_date(F.col("datestamp"), "yyyy-MM-dd")
    cond = date_in_range(d, start, end)
    if set_spec:
        cond = cond & F.exists("setSpec", lambda s: (s == set_spec) | s.startswith(set_spec + ":"))
    return headers.where(cond).select("identifier", d.alias("datestamp"), "setSpec")


# --- fixed values: the bulk loader's chosen columns ----------------------------
LOADER_COLUMNS = ["id", "title", "summary", "authors", "primary_category", "categories"]
# ---------------------------------------------------------------------------


def load_entries(entries: DataFrame, start=None, end=None, ascending: bool = True,
                 num: int | None = None) -> DataFrame:
    """The loader's six columns in a date range, sorted by submission
    date; all rows, or the first ``num`` when a number is given (O3)."""
    p = entries.select(
        id_from_url("id").alias("id"), strip("title").alias("title"), strip("summary").alias("summary"),
        F.transform("author", lambda a: a["name"]).alias("authors"),
        F.col("primary_category._term").alias("primary_category"),
        F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.col("published").alias("submitted"))
    p = p.where(date_in_range(iso_day("submitted"), start, end))
    order = F.col("submitted").asc() if ascending else F.col("submitted").desc()
    p = p.orderBy(order, F.col("id"))
    return (p if num is None else p.limit(num)).select(*LOADER_COLUMNS)
