"""Registered queries: parsing, text, category and ordering operators (S1, P*, A2, F11, O*, T*, M3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories as cat
from ..functions import dates, ids, text
from ..operators import encode, filters, lookup, metrics, ordering, pages, trigrams
from ..session import staged_path
from ..sources.tables import table
from . import standins as si
from .registry import register

# --------------------------------------------------------------------------
# JSON fields with defaults
# --------------------------------------------------------------------------
_PROPS = "struct<k:int, note:string, versions:array<struct<version:string, created:string>>>"


@register("json_field_default", """
SELECT event_id,
       CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       coalesce(json_extract_string(props, '$.note'), '') AS note,
       coalesce(json_extract_string(props, '$.versions[0].created'), '') AS first_created
FROM events""")
def json_field_default(spark, d):
    ev = table(spark, d, "events")
    j = F.from_json("props", _PROPS)
    return ev.select("event_id", j.alias("j")).select(
        "event_id", F.col("j.k").alias("k"),
        text.blank_if_null(F.col("j.note")).alias("note"),
        text.blank_if_null(F.get(F.col("j.versions"), 0).getField("created")).alias("first_created"))


# --------------------------------------------------------------------------
# RFC-2822 stamps written from the order date, read back
# --------------------------------------------------------------------------
@register("rfc2822_dates", """
SELECT CAST(o_orderkey AS VARCHAR) AS base_id,
       CAST(o_orderdate AS DATE) AS created,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ||
         CASE WHEN o_orderpriority = '1-URGENT' THEN '-05:00' ELSE '+00:00' END AS published,
       CAST(o_orderdate AS DATE) AS published_day,
       CAST(epoch(o_orderdate) AS BIGINT) +
         CASE WHEN o_orderpriority = '1-URGENT' THEN 18000 ELSE 0 END AS published_epoch
FROM orders""")
def rfc2822_dates(spark, d):
    o = table(spark, d, "orders")
    zone = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("-0500")).otherwise(F.lit("GMT"))
    stamp = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" "), zone)
    x = o.select(F.col("o_orderkey").cast("string").alias("base_id"), stamp.alias("stamp"))
    pub = dates.rfc2822_iso("stamp")
    return x.select("base_id", dates.rfc2822_date("stamp").alias("created"),
                    pub.alias("published"), dates.iso_day(pub).alias("published_day"),
                    F.unix_timestamp(dates.rfc2822_instant("stamp")).alias("published_epoch"))


# --------------------------------------------------------------------------
# P9-P11, A2, F11/F12
# --------------------------------------------------------------------------
# Archive names for the stand-in category strings (fixed order; index = p_size).
_ARCHIVE_POOL = cat.PH_ARCHIVES + cat.MATH_ARCHIVES + cat.CS_ARCHIVES + cat.QFIN_ARCHIVES + \
    ["cs", "econ", "eess", "math", "stat", "q-bio", "q-fin"]
_POOL_SQL = "[" + ", ".join(f"'{a}'" for a in _ARCHIVE_POOL) + "]"


def _remap_sql(expr: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cat.CATEGORY_GROUPS.items())
    return f"CASE {expr} {cases} ELSE {expr} END"


@register("category_remap", f"""
SELECT base_id, primary_category, main_category, {_remap_sql('main_category')} AS category_group FROM (
  SELECT base_id, primary_category, string_split(primary_category, '.')[1] AS main_category FROM (
    SELECT CAST(p_partkey AS VARCHAR) AS base_id,
           {_POOL_SQL}[((p_size - 1) % {len(_ARCHIVE_POOL)}) + 1] || '.' || p_type AS primary_category
    FROM part))""")
def category_remap(spark, d):
    p = table(spark, d, "part")
    pool = F.array(*[F.lit(a) for a in _ARCHIVE_POOL])
    arch = F.element_at(pool, F.pmod(F.col("p_size") - 1, F.lit(len(_ARCHIVE_POOL))) + 1)
    cats = F.concat(F.lit("  "), arch, F.lit("."), F.col("p_type"), F.lit(" "), F.lower("p_brand"), F.lit(" "))
    x = p.select(F.col("p_partkey").cast("string").alias("base_id"), cats.alias("categories"))
    prim = cat.primary_category("categories")
    return x.select("base_id", prim.alias("primary_category"),
                    cat.main_category(prim).alias("main_category"),
                    cat.normalised_category("categories").alias("category_group"))


@register("primary_category", """
SELECT doc_id, source || '.' || lang AS primary_category, source AS main_category FROM documents""")
def primary_category(spark, d):
    docs = table(spark, d, "documents")
    c = F.concat(F.col("source"), F.lit("."), F.col("lang"), F.lit(" "), F.col("lang"))
    prim = cat.primary_category(c)
    return docs.select("doc_id", prim.alias("primary_category"),
                       cat.main_category(prim).alias("main_category"))


@register("class_counts", """
SELECT lang, count(*) AS cnt FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def class_counts(spark, d):
    return metrics.class_counts(table(spark, d, "documents"), "lang")


@register("min_class_filter", """
SELECT doc_id, lang || '/' || source AS cls FROM documents
WHERE lang || '/' || source IN (SELECT lang || '/' || source FROM documents GROUP BY 1 HAVING count(*) >= 5)""")
def min_class_filter(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat(F.col("lang"), F.lit("/"), F.col("source")).alias("cls"))
    return filters.min_class_filter(docs, "cls", 5)


# --------------------------------------------------------------------------
# P14 / P17-P19 / P26 / P27 / P6 / P16
# --------------------------------------------------------------------------
_LINES_RE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _lines_sql(expr: str) -> str:
    s = f"string_split_regex({expr}, '{_LINES_RE}')"
    return (f"CASE WHEN {expr} = '' THEN CAST([] AS VARCHAR[]) "
            f"WHEN {s}[len({s})] = '' THEN {s}[1:len({s}) - 1] ELSE {s} END")


@register("page_lines", f"""
SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS line
FROM (SELECT page_id, {_lines_sql('html')} AS l FROM pages)""")
def page_lines(spark, d):
    pg = table(spark, d, "pages")
    x = pg.select("page_id", F.posexplode(text.lines("html")).alias("line_no", "line"))
    return x.withColumn("line_no", F.col("line_no").cast("bigint"))


@register("snippet3", f"""
SELECT doc_id, array_to_string(l[1:3], chr(10)) AS snippet
FROM (SELECT doc_id, {_lines_sql('text')} AS l FROM documents)""")
def snippet3(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.snippet("text", 3).alias("snippet"))


@register("artefact_names", """
SELECT page_id, fmt,
       CASE fmt WHEN 'pdf' THEN 'https://arxiv.org/pdf/' || page_id || 'v1.pdf' WHEN 'html' THEN 'https://arxiv.org/abs/' || page_id || 'v1'
                ELSE 'https://arxiv.org/e-print/' || page_id || 'v1' END AS url,
       CAST(page_id AS VARCHAR) || 'v1.' || CASE fmt WHEN 'pdf' THEN 'pdf' WHEN 'html' THEN 'html'
                ELSE 'tar.gz' END AS file_name
FROM (SELECT page_id, unnest(['pdf', 'html', 'source']) AS fmt FROM pages)""")
def artefact_names(spark, d):
    pg = table(spark, d, "pages").select("page_id")
    vid = ids.with_version(F.col("page_id").cast("string"), "v1")
    x = pg.select("page_id", vid.alias("vid"),
                  F.explode(F.array(*[F.lit(f) for f in ("pdf", "html", "source")])).alias("fmt"))
    url = F.when(F.col("fmt") == "pdf", text.format_url("vid", "pdf")) \
        .when(F.col("fmt") == "html", text.format_url("vid", "html")) \
        .otherwise(text.format_url("vid", "source"))
    return x.select("page_id", "fmt", url.alias("url"), text.artefact_name("vid", "fmt").alias("file_name"))


@register("url_last_segment", """
SELECT page_id, string_split(url, '/')[-1] AS segment FROM pages""")
def url_last_segment(spark, d):
    pg = table(spark, d, "pages")
    return pg.select("page_id", ids.id_from_url("url").alias("segment"))


@register("author_join", """
SELECT CAST(p_partkey AS VARCHAR) AS base_id, array_to_string(string_split(p_name, ' '), ', ') AS authors
FROM part""")
def author_join(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("base_id"),
                    text.join_authors(F.split("p_name", " ")).alias("authors"))


@register("trim_fields", f"""
SELECT doc_id, length(s) AS n, md5(s) AS h FROM (
  SELECT doc_id, regexp_replace(regexp_replace(text, '^{text.PY_SPACE}+', ''), '{text.PY_SPACE}+$', '') AS s
  FROM documents)""")
def trim_fields(spark, d):
    docs = table(spark, d, "documents")
    s = text.strip("text")
    return docs.select("doc_id", F.length(s).cast("bigint").alias("n"), F.md5(s).alias("h"))


@register("day_bounds", """
SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-04 00:00:00'""")
def day_bounds(spark, d):
    ev = table(spark, d, "events")
    return ev.where(dates.day_bounds("ts", "2024-01-02", "2024-01-03")).select("event_id", "ts")


# --------------------------------------------------------------------------
# O2 / O3 / O4 / T1 / T2
# --------------------------------------------------------------------------
@register("page_window", """
SELECT CAST(o_orderkey AS VARCHAR) AS base_id, CAST(o_orderdate AS DATE) AS created FROM orders
ORDER BY created, base_id LIMIT 50 OFFSET 100""")
def page_window(spark, d):
    p = si.order_papers(spark, d).select("base_id", "created")
    return ordering.page(p, ["created", "base_id"], start=100, max_results=50)


@register("page_directory", """
SELECT base_id, created, position FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS base_id, CAST(o_orderdate AS DATE) AS created,
         row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), CAST(o_orderkey AS VARCHAR)) - 1 AS position FROM orders)
WHERE position BETWEEN 1000 AND 1099""")
def page_directory(spark, d):
    """O2: a deep page by its position and the next one by a cursor, from one stored directory."""
    p = si.order_papers(spark, d).select("base_id", "created")
    where = pages.store_pages(p, ["created", "base_id"], staged_path(spark, "pages"))
    one = pages.read_page(spark, where, 1000, 50)
    last = one.orderBy(F.desc("position")).first()
    return one if last is None else one.unionByName(pages.read_after(spark, where, (last.created, last.base_id), 50))


@register("seeded_shuffle", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5('14850:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS position
FROM orders""")
def seeded_shuffle(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return ordering.dense_position(o, "o_orderkey", seed=14850)


@register("positional_split", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('14850:' || CAST(o_orderkey AS VARCHAR)), o_orderkey)
                         <= (SELECT count(*) FROM orders) * 4 // 5 THEN 'train' ELSE 'test' END AS split
FROM orders""")
def positional_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return ordering.positional_split(o, "o_orderkey", o.count() * 4 // 5, seed=14850)


STRATIFIED_SQL = """
WITH c AS (SELECT label, count(*) AS n_class FROM embeddings GROUP BY label),
t AS (SELECT sum(n_class) AS n_all FROM c),
q AS (SELECT label, n_class, n_all, n_all - CAST(ceil(n_all * 0.2::DOUBLE) AS BIGINT) AS ntrain FROM c, t),
f AS (SELECT label, n_class, ntrain, (n_class * ntrain) // n_all AS fl, (n_class * ntrain) % n_all AS rem FROM q),
s AS (SELECT *, ntrain - sum(fl) OVER () AS short, row_number() OVER (ORDER BY rem DESC, label) AS rk FROM f),
quota AS (SELECT label, fl + CASE WHEN rk <= short THEN 1 ELSE 0 END AS ntr FROM s)
SELECT e.vec_id, e.label,
       CASE WHEN row_number() OVER (PARTITION BY e.label ORDER BY md5('42:' || CAST(e.vec_id AS VARCHAR)), e.vec_id)
                 <= quota.ntr THEN 'train' ELSE 'test' END AS split
FROM embeddings e JOIN quota USING (label)"""


@register("stratified_split", STRATIFIED_SQL)
def stratified_split(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return ordering.stratified_split(e, "vec_id", "label", test_size=0.2, seed=42)


# --------------------------------------------------------------------------
# Label codes
# --------------------------------------------------------------------------
@register("label_decode", """
WITH c AS (SELECT lang AS label, CAST(row_number() OVER (ORDER BY lang) - 1 AS BIGINT) AS code
           FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
x AS (SELECT d.doc_id, c.code, (c.code + 1) % (SELECT count(*) FROM c) AS pcode
      FROM documents d LEFT JOIN c ON c.label = d.lang)
SELECT x.doc_id, a.label AS actual, p.label AS predicted
FROM x LEFT JOIN c a ON a.code = x.code LEFT JOIN c p ON p.code = x.pcode""")
def label_decode(spark, d):
    """Codes back to names through the label dimension, for the true code
    and a stand-in prediction (the next code, wrapping around)."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    codes = encode.label_codes(docs, "lang")               # stored once, used for both directions
    k = codes.count()
    coded = encode.encode_labels(docs, "lang", codes=codes).withColumn("pcode", (F.col("code") + 1) % k)
    out = lookup.decode_labels(coded, codes, "code", out_col="actual")
    out = lookup.decode_labels(out, codes, "pcode", out_col="predicted")
    return out.select("doc_id", "actual", "predicted")


@register("label_codes", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS code FROM documents""")
def label_codes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return encode.encode_labels(docs, "lang")


@register("trigram_search", """
SELECT 'title' AS search, CAST(p_partkey AS VARCHAR) AS base_id, p_name AS title FROM part WHERE contains(p_name, 'lue')
UNION ALL SELECT 'author', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE contains(lower(p_brand), 'brand#1')
UNION ALL SELECT 'id', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '^1(23)+')
UNION ALL SELECT 'all', CAST(p_partkey AS VARCHAR), p_name FROM part
          WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '[0-9]7$') AND contains(p_name, 'red') AND contains(p_brand, 'Brand#2')""")
def trigram_search(spark, d):
    """F1, F5 and F6 by a substring index: the rows of a scan, from the blocks that can hold them."""
    root = trigrams.build_index(si.part_papers(spark, d), staged_path(spark, "trigrams"), block_rows=1000)
    searches = {"title": {"title": "lue"}, "author": {"author": "BRAND#1", "case_sensitive": False}, "id": {"regex_id": "^1(23)+"},
                "all": {"regex_id": "[0-9]7$", "title": "red", "author": "Brand#2"}}
    out = None
    for name, s in searches.items():
        found = trigrams.search(spark, root, **s).select(F.lit(name).alias("search"), "base_id", "title")
        out = found if out is None else out.unionAll(found)
    return out
