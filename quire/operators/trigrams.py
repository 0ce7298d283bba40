"""A substring index over papers (F1, F2, F5, F6): trigrams to blocks of rows.

The papers are stored in blocks of near ids, one partition folder each, and every
trigram of the indexed texts points to the blocks that hold it. A search turns
its pattern or needle into trigrams that any match must contain, intersects
their blocks, reads these only, and tests every row with the filter itself, so
the rows are those of a scan.

* Postings are one row per (field, trigram, block), reduced on the map side: a
  trigram that all rows hold is one row per block, whatever their number.
* They are partitioned by a hash of the trigram; a search reads the partitions of its own.
* What the driver holds is block numbers, one per ``BLOCK_ROWS`` rows at most.

Defined results: a search without trigrams (short needles, classes, alternatives,
flags, patterns Python cannot read) reads all blocks; null and short texts have no
trigrams; repeated rows stay; an empty table has no blocks and no rows. An index is written once.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import split_versioned_pattern
from .filters import paper_predicate

BLOCK_ROWS = 100_000
BUCKETS = 64                          # partitions of the postings


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(3)))))


def _bucket(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % BUCKETS).cast("int")


def build_index(papers: DataFrame, root: str, block_rows: int = BLOCK_ROWS, id_col: str = "base_id",
                fields: tuple[str, ...] = ("base_id", "authors", "title")) -> str:
    """Store ``papers`` in blocks and the postings of ``fields``, each as it
    stands and in lower case, below ``root``."""
    spark = papers.sparkSession
    n = max(1, -(-papers.count() // block_rows))
    blocks = papers.repartitionByRange(n, id_col).withColumn("block", F.spark_partition_id())
    papers.limit(0).write.parquet(f"{root}/schema")        # an index without rows has no file that tells its columns
    blocks.write.partitionBy("block").parquet(f"{root}/rows")
    rows = _rows(spark, root)
    pairs = []
    for f in fields:
        text = F.col(f).cast("string")
        pairs += [F.struct(F.lit(f).alias("field"), _grams(text).alias("grams")),
                  F.struct(F.lit(f + " lower").alias("field"), _grams(F.lower(text)).alias("grams"))]
    listed = rows.select("block", F.explode(F.array(*pairs)).alias("p")).select("block", "p.field", F.explode("p.grams").alias("gram"))
    listed = listed.distinct().withColumn("bucket", _bucket(F.col("gram")))
    listed.repartition("bucket").sortWithinPartitions("bucket", "field", "gram").write.partitionBy("bucket").parquet(f"{root}/postings")
    return root


def _rows(spark: SparkSession, root: str) -> DataFrame:
    schema = spark.read.parquet(f"{root}/schema").schema
    return spark.read.schema(schema.add("block", "integer")).parquet(f"{root}/rows")


def required_literals(pattern: str) -> list[str]:
    """Strings that every match of a regular expression contains; none where that is not certain."""
    try:
        parsed = re._parser.parse(pattern)                 # Python's own parser of its patterns
    except (re.error, RecursionError, OverflowError):
        return []
    if parsed.state.flags & ~re.UNICODE.value:
        return []
    runs = [""]

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(arg)
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                walk(arg[3])
            elif name == "MAX_REPEAT" and arg[0] >= 1:     # once at least: what it holds is required, what follows it apart
                runs.append("")
                walk(arg[2])
                runs.append("")
            elif name != "AT":                             # an anchor has no width
                runs.append("")

    walk(parsed)
    return [r for r in runs if r]


def _required(needles: list[str]) -> set[str]:
    return {x[k:k + 3] for x in needles for k in range(len(x) - 2)}


def candidate_blocks(spark: SparkSession, root: str, regex_id: str | None = None, author: str | None = None,
                     title: str | None = None, case_sensitive: bool = True, id_col: str = "base_id") -> list[int] | None:
    """The blocks that hold every required trigram; None where nothing is required, so that all are read."""
    base, _, named = split_versioned_pattern(regex_id)
    pattern = (base if named else regex_id) or ""          # a version is not part of the id
    wanted = {(id_col, g) for g in _required(required_literals(pattern))}
    if author:
        field, needle = ("authors", author) if case_sensitive else ("authors lower", author.lower())
        wanted |= {(field, g) for g in _required([needle])}
    if title:
        wanted |= {("title", g) for g in _required([title])}
    if not wanted:
        return None
    buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for _, g in wanted})
    postings = spark.read.schema("block int, field string, gram string, bucket int").parquet(f"{root}/postings")
    one = F.lit(False)
    for f in sorted({f for f, _ in wanted}):
        one = one | ((F.col("field") == f) & F.col("gram").isin(sorted(g for x, g in wanted if x == f)))
    hits = postings.where(F.col("bucket").isin(buckets) & one)
    found = hits.groupBy("block").count().where(F.col("count") == len(wanted)).select("block")
    return sorted(r.block for r in found.collect())


def search(spark: SparkSession, root: str, regex_id: str | None = None, author: str | None = None, title: str | None = None,
           case_sensitive: bool = True, id_col: str = "base_id", **filters) -> DataFrame:
    """The papers that pass all filters (those of :func:`filters.paper_predicate`), read from the candidate blocks."""
    blocks = candidate_blocks(spark, root, regex_id, author, title, case_sensitive, id_col)
    rows = _rows(spark, root)
    if blocks is not None:
        rows = rows.where(F.col("block").isin(blocks))
    return rows.where(paper_predicate(regex_id, author=author, title=title, case_sensitive=case_sensitive,
                                      id_col=id_col, **filters)).drop("block")
