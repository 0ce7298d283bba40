"""Registered file-source queries (S6-S11, S17, S18, P9, P22) over files that
Spark writes from the tables under the shared scratch folder and reads back
with the engine's sources: a CSV corpus with multi-line texts, the wide
embedding CSV, gzip adjacency objects and a gzip metadata list."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import categories as cat
from ..operators import encode
from ..session import staged_path
from ..sources import files
from ..sources.tables import table
from .ablation import write_results
from .catalogue_ml import _TOKENS_SQL
from .catalogue_text import _lines_sql
from .fetch import fetch_batch, snippets
from .registry import register


@register("corpus_csv", """
SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, text AS abstract, lang AS authors,
       lang || '.' || source AS categories, CAST(length(text) AS BIGINT) AS n_chars
FROM documents""")
def corpus_csv(spark, d):
    docs = table(spark, d, "documents")
    corpus = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"),
                         F.col("text").alias("abstract"), F.col("lang").alias("authors"),
                         F.concat_ws(".", "lang", "source").alias("categories"))
    path = files.write_corpus_csv(corpus, staged_path(spark, "documents-csv"))
    back = files.read_corpus(spark, path, fmt="csv")
    return back.select("id", "title", "abstract", "authors", "categories",
                       F.length("abstract").cast("bigint").alias("n_chars"))


_WIDE = 64                                   # the width of the driver's table; the query takes it from the data


@register("embed_wide_csv", "SELECT vec_id, " + ", ".join(
    f"embedding[{i + 1}] AS embedding_{i}" for i in range(_WIDE)) + " FROM embeddings")
def embed_wide_csv(spark, d):
    wide = encode.widen(table(spark, d, "embeddings"), "embedding", keep=["vec_id"])
    path = files.write_wide_csv(wide, staged_path(spark, "embeddings-wide-csv"))
    schema = T.StructType([T.StructField("vec_id", T.LongType())] +
                          [T.StructField(c, T.FloatType()) for c in wide.columns[1:]])
    return files.read_wide_csv(spark, path, schema)


@register("citation_adjacency", """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem""")
def citation_adjacency(spark, d):
    li = table(spark, d, "lineitem")
    path = files.write_citation_lines(li, staged_path(spark, "lineitem-adjacency"), "l_orderkey", "l_partkey")
    return files.read_citation_edges(spark, path)


@register("citation_objects", """
SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem""")
def citation_objects(spark, d):
    """S9 in its real form: a few large objects with a list per paper, each
    read by as many tasks as it has splits; suppliers are hubs."""
    li = table(spark, d, "lineitem")
    path = files.write_citation_objects(li, staged_path(spark, "lineitem-objects"), "l_suppkey", "l_partkey", partitions=4)
    return files.read_citation_edges(spark, path)


@register("json_document", """
SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS title, c_mktsegment AS category FROM customer""")
def json_document(spark, d):
    """Whole JSON documents (an array of records per file)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"),
                                           F.col("c_mktsegment").alias("category"))
    path = files.write_json_documents(c, staged_path(spark, "customer-json"))
    return files.read_json_document(spark, path, "id long, title string, category string")


@register("embed_three", f"""
WITH t AS (SELECT doc_id, 'title_emb' AS block, source AS text FROM documents
           UNION ALL SELECT doc_id, 'summary_emb', text FROM documents
           UNION ALL SELECT doc_id, 'authors_emb', lang || ' ' || source FROM documents),
k AS (SELECT doc_id, block, unnest({_TOKENS_SQL}) AS tok FROM t),
b AS (SELECT doc_id, block, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 32 AS INTEGER) AS bucket FROM k),
c AS (SELECT doc_id, block, bucket, count(*) AS tf FROM b GROUP BY doc_id, block, bucket)
SELECT doc_id, block, bucket, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id, block)), 6) AS weight FROM c""")
def embed_three(spark, d):
    """Three text columns embedded side by side, stored, loaded by key."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"),
                                               F.col("text").alias("summary"), F.concat_ws(" ", "lang", "source").alias("authors"))
    path = files.write_embeddings(encode.embed_columns(docs, "id", ["title", "summary", "authors"], dim=32),
                                  staged_path(spark, "embeddings"))
    e = files.read_embeddings(spark, path)
    blocks = F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in files.EMBEDDING_COLUMNS]), F.array(*files.EMBEDDING_COLUMNS)))
    x = e.select(F.col("id").alias("doc_id"), blocks.alias("block", "v"))
    x = x.select("doc_id", "block", F.posexplode("v").alias("bucket", "weight")).where("weight > 0")
    return x.select("doc_id", "block", "bucket", F.round("weight", 6).alias("weight"))


@register("results_json", """
SELECT lang AS feature_set, count(*) AS n, round(avg(CAST(n_chars AS DOUBLE)), 6) AS mean_chars FROM documents GROUP BY lang""")
def results_json(spark, d):
    """A result table written under its date and read back."""
    docs = table(spark, d, "documents")
    r = docs.groupBy(F.col("lang").alias("feature_set")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("n_chars").cast("double")), 6).alias("mean_chars"))
    path = write_results(r, staged_path(spark, "results"), date="2024-05-31")
    return spark.read.schema("feature_set string, n long, mean_chars double").json(path)


def _page_artefacts(spark, d):
    """Pages as artefacts: the html, and a source archive of two text members and one or no .tex member."""
    pg = table(spark, d, "pages")
    vid = F.concat(F.col("page_id").cast("string"), F.lit("v1"))
    html = pg.select(vid.alias("id"), F.lit("html").alias("format"), F.encode("html", "UTF-8").alias("content"))

    def tar(batches):
        for b in batches:
            out = []
            for i, text in zip(b["page_id"], b["html"], strict=True):
                buf = io.BytesIO()
                with tarfile.open(fileobj=buf, mode="w:gz") as t:
                    for name, data in (("README", b"x"), (f"p{i}.tex" if i % 3 else f"p{i}.txt", text.encode()), ("z.tex" if i % 3 else "z", b"no")):
                        info = tarfile.TarInfo(name)
                        info.size = len(data)
                        t.addfile(info, io.BytesIO(data))
                out.append(buf.getvalue() if i % 7 else b"no archive")
            yield pd.DataFrame({"id": b["page_id"].astype(str) + "v1", "format": "source", "content": out})

    source = pg.select("page_id", "html").mapInPandas(tar, "id string, format string, content binary")
    return html, source


@register("artefact_files", """
SELECT CAST(page_id AS VARCHAR) || 'v1' AS id, CAST(page_id AS VARCHAR) AS base_id, 'html' AS format,
       CAST(octet_length(encode(html)) AS BIGINT) AS size, md5(html) AS digest FROM pages""")
def artefact_files(spark, d):
    """One file per artefact, written by the tasks and read back as binary files."""
    html, _ = _page_artefacts(spark, d)
    dest = staged_path(spark, "files")
    files.export_artefact_files(html, dest).write.format("noop").mode("overwrite").save()
    got = files.read_artefacts(spark, dest, glob="*.html")
    return got.select("id", "base_id", "format", F.octet_length("content").cast("bigint").alias("size"), F.md5("content").alias("digest"))


@register("source_first_tex", f"""
SELECT CAST(page_id AS VARCHAR) || 'v1' AS id,
       CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 0 ELSE CAST(len(l) AS BIGINT) END AS n,
       CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN '' ELSE array_to_string(l, chr(10)) END AS lines
FROM (SELECT page_id, {_lines_sql('html')} AS l FROM pages)""")
def source_first_tex(spark, d):
    """Lines of the first .tex member; none without one, NULL for what is no archive."""
    got = files.source_lines(_page_artefacts(spark, d)[1])
    return got.select("id", F.size("source").cast("bigint").alias("n"), F.array_join("source", "\n").alias("lines")) \
        .withColumn("n", F.when(F.col("lines").isNotNull(), F.col("n")))


@register("metadata_list", r"""
SELECT id, title, primary_category, split_part(primary_category, '.', 1) AS main_category FROM (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title,
         list_filter(string_split_regex(p_type || ' ' || p_brand, '\s+'), lambda x: x <> '')[1] AS primary_category
  FROM part)""")
def metadata_list(spark, d):
    p = table(spark, d, "part")
    recs = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("authors"),
                    F.col("p_name").alias("title"),
                    F.array(F.concat_ws(" ", "p_type", "p_brand")).alias("categories"))
    dest = staged_path(spark, "part-metadata-list")
    recs.write.mode("overwrite").option("compression", "gzip").json(dest)
    m = files.read_metadata_list(spark, dest)
    first = F.col("categories")[0]
    return m.select("id", "title", cat.primary_category(first).alias("primary_category"),
                    cat.main_category(cat.primary_category(first)).alias("main_category"))


@register("fetch_artefacts", f"""
SELECT CAST(page_id AS VARCHAR) || 'v1' AS id,
       array_to_string(l[1:3], chr(10)) AS abstract_head,
       array_to_string(l[1:3], chr(10)) AS html_head,
       CAST(len(l) AS BIGINT) AS html_lines,
       hex(substr('%PDF-1.5 ' || url, 1, 50)) AS pdf_head
FROM (SELECT page_id, url, {_lines_sql('html')} AS l FROM pages)
WHERE regexp_matches(CAST(page_id AS VARCHAR), '^(?:1[0-9]*)')""")
def fetch_artefacts(spark, d):
    """E1 with binary formats: artefacts written from ``pages`` (S20) and read
    back, then ``fetch_batch`` over a page index with abstract, HTML lines
    (P19) and PDF bytes (P29) requested (P20, P21)."""
    pg = table(spark, d, "pages")
    papers = pg.select(F.col("page_id").cast("string").alias("base_id"), F.lit("web").alias("categories"),
                       F.lit(None).cast("date").alias("created"), F.lit("").alias("authors"),
                       F.col("url").alias("title"), F.col("html").alias("abstract"))
    vid = F.concat(F.col("page_id").cast("string"), F.lit("v1"))
    arts = pg.select(vid.alias("id"), F.lit("html").alias("format"), F.encode("html", "UTF-8").alias("content")) \
        .unionByName(pg.select(vid.alias("id"), F.lit("pdf").alias("format"),
                               F.encode(F.concat(F.lit("%PDF-1.5 "), "url"), "UTF-8").alias("content")))
    stored = files.write_artefacts(arts, staged_path(spark, "pages-artefacts"))
    got = fetch_batch(papers, "1[0-9]*", formats=["abstract", "html", "pdf", "html"],
                      artefacts=spark.read.parquet(stored))
    s = snippets(got.withColumn("html_lines", F.size("html").cast("bigint")), keep=["html_lines"])
    return s.select("id", "abstract_head", F.array_join("html_head", "\n").alias("html_head"),
                    "html_lines", F.hex("pdf_head").alias("pdf_head"))
