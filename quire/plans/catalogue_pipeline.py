"""Registered end-to-end queries: index build from a snapshot Spark writes from
the tables, fetch by id pattern (E1), and the summary classifier (E2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import staged_path
from ..sources import merged, offsets, snapshot
from ..sources.tables import table
from .fetch import fetch_batch, select_papers
from .registry import register


def _record_cols(title, categories="p_type", days="p_size"):
    created = F.concat(F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.col(days)),
                                     "EEE, d MMM yyyy"), F.lit(" 00:00:00 GMT"))
    return [F.col("p_partkey").cast("string").alias("id"), title.alias("title"),
            F.col("p_brand").alias("authors"), F.col(categories).alias("categories"),
            F.concat_ws("\n", "p_name", "p_brand").alias("abstract"),
            F.array(F.struct(F.lit("v1").alias("version"), created.alias("created"))).alias("versions")]


def _part_snapshot(spark, d, later=None) -> str:
    """Write ``part`` as an NDJSON paper snapshot under the shared scratch
    folder; ``later(part)`` gives records that come behind the first ones."""
    dest = staged_path(spark, "part-snapshot")
    p = table(spark, d, "part")
    df = p.select(*_record_cols(F.col("p_name")))
    snapshot.write_snapshot(df if later is None else df.unionByName(later(p)), dest)
    return dest


def _upper_titles(p):
    return p.select(*_record_cols(F.upper("p_name")))


def _moved(p):
    """Every third part again, in another category and a thousand days later."""
    x = p.where("p_partkey % 3 = 0").withColumns({"moved": F.concat(F.lit("MOVED."), "p_type"), "later": F.col("p_size") + 1000})
    return x.select(*_record_cols(F.col("p_name"), "moved", "later"))


@register("index_roundtrip", r"""
SELECT CAST(p_partkey AS VARCHAR) || 'v1' AS id, p_name AS title, p_brand AS authors, p_type AS categories,
       p_name || chr(10) || p_brand AS abstract,
       strftime(DATE '1995-01-01' + p_size, '%Y-%m-%d') || 'T00:00:00+00:00' AS published
FROM part
WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '^(?:1[0-9]*2)') AND p_type IN ('SMALL', 'PROMO')""")
def index_roundtrip(spark, d):
    src = _part_snapshot(spark, d)
    idx = snapshot.build_index(spark, src, staged_path(spark, "index"))
    got = fetch_batch(spark.read.parquet(idx), "1[0-9]*2", category=["SMALL", "PROMO"], formats="metadata")
    return got.select("id", "title", "authors", "categories", "abstract", "published")


@register("index_dedup", """
SELECT CAST(p_partkey AS VARCHAR) AS base_id, upper(p_name) AS title, CAST(DATE '1995-01-01' + p_size AS DATE) AS created
FROM part""")
def index_dedup(spark, d):
    src = _part_snapshot(spark, d, _upper_titles)
    idx = snapshot.build_index(spark, src, staged_path(spark, "index"))
    return snapshot.load_index(spark, idx, ["title", "created"], dedup="last")


@register("index_sorted_dates", """
SELECT CAST(p_partkey AS VARCHAR) AS base_id, p_type AS categories, CAST(DATE '1995-01-01' + p_size AS DATE) AS created
FROM part
WHERE DATE '1995-01-01' + p_size BETWEEN DATE '1995-01-10' AND DATE '1995-01-20'
  AND p_type IN ('SMALL', 'LARGE')""")
def index_sorted_dates(spark, d):
    """S2 with the date-sorted layout, then F4 + F7 + A4: the range-partitioned
    files each cover a narrow ``created`` range, so the pushed date bounds skip
    whole files and row groups."""
    src = _part_snapshot(spark, d)
    idx = snapshot.build_index(spark, src, staged_path(spark, "sorted-index"), layout="sorted")
    # the date bounds reach the wide scan; which record of an id is its last comes from a narrow one
    papers = spark.read.parquet(idx).select("base_id", "categories", "created", snapshot.POSITION)
    sel = select_papers(papers, None, "1995-01-10", "1995-01-20", ["SMALL", "LARGE"])
    return sel.select("base_id", "categories", "created")


@register("index_changed_duplicates", """
SELECT CAST(p_partkey AS VARCHAR) AS base_id, p_type AS categories, CAST(DATE '1995-01-01' + p_size AS DATE) AS created FROM part
WHERE p_partkey % 3 <> 0 AND p_type IN ('SMALL', 'LARGE') AND p_size <= 40""")
def index_changed_duplicates(spark, d):
    """E1 on records that changed: only an id's last record is tested, so a
    part that left the category is not returned for what it once was."""
    src = _part_snapshot(spark, d, _moved)
    papers = spark.read.parquet(snapshot.build_index(spark, src, staged_path(spark, "index"), layout="sorted"))
    sel = select_papers(papers, None, None, "1995-02-10", ["SMALL", "LARGE"])
    return sel.select("base_id", "categories", "created")


@register("index_compact", """
SELECT CAST(p_partkey AS VARCHAR) AS base_id, p_type AS categories, CAST(DATE '1995-01-01' + p_size AS DATE) AS created,
       p_brand AS authors, p_name AS title FROM part""")
def index_compact(spark, d):
    """The first record of an id wins."""
    src = _part_snapshot(spark, d, lambda p: _moved(p).unionByName(_upper_titles(p)))
    return snapshot.load_compact(spark, snapshot.build_compact_index(spark, src, staged_path(spark, "compact")))


@register("index_refresh", """
SELECT 'a' AS version, count(*) AS rows, count(DISTINCT p_partkey) AS ids FROM part
UNION ALL SELECT 'b', count(*) + count(*) FILTER (WHERE p_partkey % 3 = 0), count(DISTINCT p_partkey) FROM part""")
def index_refresh(spark, d):
    """A refresh goes to a new version; the one being read stays whole."""
    root = staged_path(spark, "versions")
    before = spark.read.parquet(snapshot.refresh_index(spark, _part_snapshot(spark, d), root, "a"))
    after = spark.read.parquet(snapshot.refresh_index(spark, _part_snapshot(spark, d, _moved), root, "b"))

    def size(name, df):
        return df.agg(F.lit(name).alias("version"), F.count(F.lit(1)).alias("rows"), F.countDistinct("base_id").alias("ids"))

    return size("a", before).unionByName(size("b", after))


@register("offset_lookup", """
SELECT CAST(p_partkey AS VARCHAR) AS base_id, upper(p_name) AS title, p_type AS categories, p_name || chr(10) || p_brand AS abstract,
       CAST(DATE '1995-01-01' + p_size AS DATE) AS created
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def offset_lookup(spark, d):
    """J1 by place: the papers of the large orders, read by byte range from a snapshot with two records of each."""
    where = offsets.build_offsets(spark, _part_snapshot(spark, d, _upper_titles), staged_path(spark, "offsets"))
    ids = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").cast("string").alias("base_id"))
    return offsets.lookup_offsets(spark, where, ids).select("base_id", "title", "categories", "abstract", "created")


_MERGED = """
SELECT CAST(p_partkey AS VARCHAR) AS base_id, p_name AS title,
       CASE WHEN p_partkey % 3 = 0 THEN 'MOVED.' || p_type ELSE p_type END AS categories,
       CAST(DATE '1995-01-01' + p_size + CASE WHEN p_partkey % 3 = 0 THEN 1000 ELSE 0 END AS DATE) AS created
FROM part"""


def _merged_index(spark, d) -> str:
    """The index of ``part``, into which a drop of changed records was merged."""
    root, drop = staged_path(spark, "merged"), staged_path(spark, "drop")
    merged.create(spark, _part_snapshot(spark, d), root)
    snapshot.write_snapshot(_moved(table(spark, d, "part")), drop)
    merged.merge(spark, drop, root)
    return root


@register("index_merge", _MERGED)
def index_merge(spark, d):
    """A drop merged into the touched buckets; the read needs no dedup."""
    return merged.read(spark, _merged_index(spark, d)).select("base_id", "title", "categories", "created")


@register("index_merge_lookup", _MERGED + " WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def index_merge_lookup(spark, d):
    """J1 on the merged index: only the buckets of the requested ids are read."""
    ids = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").cast("string").alias("base_id"))
    return merged.lookup(spark, _merged_index(spark, d), ids).select("base_id", "title", "categories", "created")
