"""Registered feed queries (S12-S15, P13-P15, P17, F10, O2, O3) over Atom and
OAI-PMH pages that Spark writes from ``orders``, then reads back with the feed
sources. Each order is one feed entry: id ``<base>/abs/<key>v1``, published at
its order date (no date for status ``P``), categories = priority and status,
two authors; its OAI header carries the date and the priority as set."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..operators.filters import feed_batch_filter, list_ids_sorted
from ..session import staged_path
from ..sources import feeds, harvest
from ..sources.snapshot import POSITION
from ..sources.storage import open_fs, publish
from ..sources.tables import table
from .registry import register

_FEED_URL = "http://example.org/abs/"
STAGED_ROWS = 50_000                  # rows of a staged file: a page file is read by one task, so long ones would be few tasks


def _staged_xml(rows, name: str, row_tag: str, root_tag: str) -> str:
    """``rows`` as compressed XML files in the order of the rows (partition, then file of the partition)."""
    dest = staged_path(rows.sparkSession, name)
    rows.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).option("compression", "gzip") \
        .option("maxRecordsPerFile", STAGED_ROWS).mode("overwrite").save(dest)
    return dest


def _orders_feed(spark, d, pages_overlap: bool = False) -> str:
    """Atom pages (``<feed><entry>...``) written from ``orders``; text fields
    carry surrounding whitespace, as real pages do."""
    o = table(spark, d, "orders")
    ts = (F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
          .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    key = F.col("o_orderkey").cast("string")
    entries = o.select(
        F.concat(F.lit(_FEED_URL), key, F.lit("v1")).alias("id"),
        ts.alias("published"), ts.alias("updated"),
        F.concat(F.lit("\n  Order "), key, F.lit("  ")).alias("title"),
        F.concat(F.lit("\n  customer "), F.col("o_custkey").cast("string"), F.lit("\n")).alias("summary"),
        F.array(F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name")),
                F.struct(F.lit("X Y").alias("name"))).alias("author"),
        F.array(F.struct(F.col("o_orderpriority").alias("_term")),
                F.struct(F.concat(F.lit("status."), F.col("o_orderstatus")).alias("_term"))).alias("category"),
        F.struct(F.col("o_orderpriority").alias("_term")).alias("primary_category"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("clerk "), key)).alias("comment"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("J. "), key)).alias("journal_ref"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("10.1/"), key)).alias("doi"),
        F.array(F.struct(F.lit("alternate").alias("_rel"), F.concat(F.lit(_FEED_URL), key, F.lit("v1")).alias("_href")),
                F.struct(F.lit("related").alias("_rel"), F.concat(F.lit("http://example.org/pdf/"), key).alias("_href"))).alias("link"))
    if pages_overlap:                                      # every fourth entry comes again, on a later page, retitled
        again = entries.where(F.length("id") % 4 == 0).withColumn("title", F.lit("again"))
        entries = entries.unionByName(again)
    return _staged_xml(entries, "orders-feed", "entry", "feed")


def _orders_oai(spark, d) -> str:
    """OAI-PMH ``<header>`` listing written from ``orders``."""
    o = table(spark, d, "orders")
    headers = o.select(
        F.concat(F.lit("oai:example.org:"), F.col("o_orderkey").cast("string")).alias("identifier"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("datestamp"),
        F.array(F.col("o_orderpriority"), F.concat(F.lit("status."), F.col("o_orderstatus"))).alias("setSpec"))
    return _staged_xml(headers, "orders-oai", "header", "ListIdentifiers")


@register("feed_entries", """
SELECT CAST(o_orderkey AS VARCHAR) || 'v1' AS id, CAST(o_orderkey AS VARCHAR) AS base_id,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS published_date,
       o_orderpriority || ' status.' || o_orderstatus AS categories,
       'Order ' || CAST(o_orderkey AS VARCHAR) AS title,
       'customer ' || CAST(o_custkey AS VARCHAR) AS abstract,
       'C' || CAST(o_custkey AS VARCHAR) || ', X Y' AS authors,
       o_orderpriority AS primary_category
FROM orders""")
def feed_entries(spark, d):
    e = feeds.project_entries(feeds.read_feed_entries(spark, _orders_feed(spark, d)), full=True)
    return e.select("id", "base_id", "published_date", F.array_join("categories", " ").alias("categories"),
                    "title", "abstract", F.array_join("authors", ", ").alias("authors"), "primary_category")


@register("feed_batch", r"""
SELECT CAST(o_orderkey AS VARCHAR) || 'v1' AS id, CAST(o_orderdate AS DATE) AS published_date
FROM orders
WHERE regexp_matches(CAST(o_orderkey AS VARCHAR) || 'v1', '^(?:1[0-9]*3)')
  AND o_orderstatus <> 'P'
  AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
  AND (o_orderpriority = '1-URGENT' OR o_orderstatus = 'O')""")
def feed_batch(spark, d):
    e = feeds.project_entries(feeds.read_feed_entries(spark, _orders_feed(spark, d)))
    got = feed_batch_filter(e, "1[0-9]*3", "1995-01-01", "1996-12-31", ["1-URGENT", "status.O"])
    return got.select("id", "published_date")


@register("feed_entry_full", """
SELECT k || 'v1' AS id, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS updated,
       CASE WHEN o_orderkey % 2 = 0 THEN 'clerk ' || k END AS comment, CASE WHEN o_orderkey % 3 = 0 THEN 'J. ' || k END AS journal_ref,
       CASE WHEN o_orderkey % 5 = 0 THEN '10.1/' || k END AS doi,
       'alternate http://example.org/abs/' || k || 'v1, related http://example.org/pdf/' || k AS links
FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders)""")
def feed_entry_full(spark, d):
    """P13 in full: the fields of a single entry, NULL where the page has none."""
    e = feeds.project_entries(feeds.read_feed_entries(spark, _orders_feed(spark, d)), full=True)
    links = F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["rel"], x["href"])), ", ")
    return e.select("id", "updated", "comment", "journal_ref", "doi", links.alias("links"))


@register("feed_batch_overlap", r"""
SELECT k || 'v1' AS id, CASE WHEN length('http://example.org/abs/' || k || 'v1') % 4 = 0 THEN 'again' ELSE 'Order ' || k END AS title
FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
WHERE regexp_matches(k || 'v1', '^(?:1[0-9]*3)') AND o_orderstatus <> 'P'
  AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""")
def feed_batch_overlap(spark, d):
    """F10 over pages that overlap: of an id's entries the last one counts."""
    e = feeds.read_feed_entries(spark, _orders_feed(spark, d, pages_overlap=True), position=True)
    got = feed_batch_filter(feeds.project_entries(e), "1[0-9]*3", "1995-01-01", "1996-12-31",
                            [f"status.{x}" for x in "FOP"], position=POSITION)
    return got.select("id", "title")


@register("feed_list_ids", """
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS base_id FROM orders
WHERE o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
  AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND contains('C' || o_custkey || ', X Y', 'C1')
ORDER BY base_id""")
def feed_list_ids(spark, d):
    """Without an index the staged feed pages are filtered, by the same filters."""
    papers = feeds.open_papers(spark, index=None, feed=_orders_feed(spark, d, pages_overlap=True))
    return list_ids_sorted(papers, start_date="1997-01-01", end_date="1997-12-31", categories=["1-URGENT", "3-MEDIUM"], author="C1")


@register("feed_loader", """
SELECT CAST(o_orderkey AS VARCHAR) || 'v1' AS id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title,
       'customer ' || CAST(o_custkey AS VARCHAR) AS summary,
       'C' || CAST(o_custkey AS VARCHAR) || ', X Y' AS authors, o_orderpriority AS primary_category,
       o_orderpriority || ' status.' || o_orderstatus AS categories
FROM orders
WHERE o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) >= DATE '1995-06-01'""")
def feed_loader(spark, d):
    e = feeds.read_feed_entries(spark, _orders_feed(spark, d))
    got = feeds.load_entries(e, start="1995-06-01")        # the end side is open
    return got.select("id", "title", "summary", F.array_join("authors", ", ").alias("authors"),
                      "primary_category", F.array_join("categories", " ").alias("categories"))


@register("oai_identifiers", """
SELECT 'oai:example.org:' || CAST(o_orderkey AS VARCHAR) AS identifier, CAST(o_orderdate AS DATE) AS datestamp
FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
  AND o_orderpriority = '2-HIGH'""")
def oai_identifiers(spark, d):
    h = feeds.read_oai_headers(spark, _orders_oai(spark, d))
    return feeds.list_identifiers(h, start="1996-01-01", end="1996-12-31", set_spec="2-HIGH") \
        .select("identifier", "datestamp")


PAGE_ROWS = 1000                      # headers of a page, as listings have


def _orders_pages(spark, d) -> str:
    """A chain of OAI-PMH pages in order of date, written from ``orders``. The
    page of the token ``p:k`` is the k-th of partition p; a last, empty page ends the chain."""
    folder = staged_path(spark, "orders-pages")
    files, root = open_fs(folder)
    files.create_dir(root, recursive=True)

    def page(files, root: str, token: str, after: str, rows: list[dict]) -> None:
        heads = "".join(
            f"<header><identifier>{html.escape(r['identifier'])}</identifier><datestamp>{r['datestamp']}</datestamp>"
            + "".join(f"<setSpec>{html.escape(x)}</setSpec>" for x in r["setSpec"]) + "</header>" for r in rows)
        body = f"<ListIdentifiers>{heads}<resumptionToken>{after}</resumptionToken></ListIdentifiers>"
        publish(files, f"{root}/{harvest.page_name(token)}", f'<OAI-PMH xmlns="urn:oai">{body}</OAI-PMH>'.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_fs(folder)
        part = TaskContext.get().partitionId()
        k, rows = 0, []

        def token(part: int, k: int) -> str:
            return "" if part == k == 0 else f"{part}:{k}"

        for b in batches:
            for r in b.to_pylist():
                if len(rows) == PAGE_ROWS:
                    page(files, root, token(part, k), token(part, k + 1), rows)
                    k, rows = k + 1, []
                rows.append(r)
        page(files, root, token(part, k), token(part + 1, 0), rows)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

    o = table(spark, d, "orders").select(
        F.concat(F.lit("oai:example.org:"), F.col("o_orderkey").cast("string")).alias("identifier"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("datestamp"),
        F.array(F.col("o_orderpriority"), F.concat(F.lit("status."), F.col("o_orderstatus"))).alias("setSpec"))
    parts = o.repartitionByRange(16, "datestamp", "identifier").sortWithinPartitions("datestamp", "identifier")
    last = parts.mapInArrow(run, "part int").agg(F.max("part")).first()[0]
    page(files, root, f"{last + 1}:0", "", [])
    return folder


@register("oai_harvest", """
SELECT 'oai:example.org:' || CAST(o_orderkey AS VARCHAR) AS identifier, CAST(o_orderdate AS DATE) AS datestamp
FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND o_orderpriority = '2-HIGH'""")
def oai_harvest(spark, d):
    """S13 and S15 over a chain of pages: the date bounds skip pages by the directory."""
    folder = _orders_pages(spark, d)
    directory = harvest.build_directory(spark, folder, staged_path(spark, "orders-directory"))
    h = harvest.read_pages(spark, folder, directory)
    h = h.where((F.col("datestamp") >= F.lit("1996-01-01").cast("date")) & (F.col("datestamp") <= F.lit("1996-12-31").cast("date")))
    return h.where(F.array_contains("setSpec", "2-HIGH")).select("identifier", "datestamp")


@register("oai_harvest_stream", """
SELECT 'oai:example.org:' || CAST(o_orderkey AS VARCHAR) AS identifier, CAST(o_orderdate AS DATE) AS datestamp,
       o_orderpriority || ' status.' || o_orderstatus AS sets
FROM orders""")
def oai_harvest_stream(spark, d):
    """S13 as a stream whose offset is the resumption token; every header once."""
    dest = staged_path(spark, "harvested")
    q = (harvest.stream_pages(spark, _orders_pages(spark, d)).writeStream.format("parquet")
         .option("checkpointLocation", staged_path(spark, "harvest-offsets")).trigger(availableNow=True).start(dest))
    q.awaitTermination()
    return spark.read.schema(harvest.SCHEMA).parquet(dest).select("identifier", "datestamp", F.array_join("setSpec", " ").alias("sets"))
