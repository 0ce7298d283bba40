"""Work that must grow no faster than its input: shuffles, staged pages, Python memory."""

import datetime
import os
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import cocitation, lsa
from quire.plans import catalogue_feeds
from quire.sources import feeds


def test_cocitation_salts_only_hubs(spark):
    """Edges of few citing papers of many edges and many of few: any size of a hub gives the same counts, and only hubs' rows are repeated."""
    rows = [("hub", f"p{k}") for k in range(400)] + [(f"s{k // 3}", f"p{k * 7 % 300}") for k in range(900)]
    e = spark.createDataFrame(rows, "src string, dst string")
    tr = spark.createDataFrame([(f"p{k}", f"c{k % 5}") for k in range(250)], "id string, cat string")

    def result(**more):
        return sorted((r.paper, r.cat, r.cnt) for r in cocitation.cocitation_counts(e, tr, **more).collect())

    want = result()
    for hub in (1, 50, cocitation.HUB):
        assert result(max_broadcast_rows=0, hub=hub) == want
    edges = e.select("src", F.col("dst").alias("paper")).withColumn("own_cat", F.lit("c"))
    per_src = spark.createDataFrame([("hub", "c", 400), ("s1", "c", 3), ("s2", None, 3)], "src string, cat string, c long")
    joined = cocitation._with_categories(edges, per_src, 0, 100)
    left, right = joined.collect(), edges.where("src in ('hub', 's1')").count()
    assert len(left) == right


def orders(spark, tmp_path, n=120):
    day = datetime.datetime(1996, 1, 1)
    rows = [(k, k % 7, "FOP"[k % 3], day + datetime.timedelta(days=k % 9), "1-URGENT") for k in range(1, n)] + [(1003, 1, "F", day, "3-MEDIUM")]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string")
    df.repartition(2).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path), rows


def test_staged_pages_are_compressed_and_split(spark, tmp_path, monkeypatch):
    d, rows = orders(spark, tmp_path)
    monkeypatch.setattr(catalogue_feeds, "STAGED_ROWS", 9)
    folder = catalogue_feeds._orders_feed(spark, d, pages_overlap=True)
    names = [x for x in os.listdir(folder.removeprefix("file:")) if x.startswith("part-")]
    assert len(names) > 10 and all(x.endswith(".gz") for x in names)
    repeated = [r for r in rows if len(f"http://example.org/abs/{r[0]}v1") % 4 == 0]
    assert repeated and spark.read.format("xml").schema(feeds.ENTRY_SCHEMA).option("rowTag", "entry").load(folder).count() == len(rows) + len(repeated)
    got = {r.id: r.title for r in catalogue_feeds.feed_batch_overlap(spark, d).collect()}
    want = {f"{r[0]}v1": "again" if r in repeated else f"Order {r[0]}" for r in rows if r[2] != "P" and re.match("1[0-9]*3", f"{r[0]}v1")}
    assert got == want and "again" in want.values()        # the entry of the later file counts


def test_papers_of_a_feed_store_only_their_fields(spark, tmp_path, monkeypatch):
    d, rows = orders(spark, tmp_path, 20)
    stored, keep = [], feeds.materialize
    monkeypatch.setattr(feeds, "materialize", lambda df, name: stored.append(df.columns) or keep(df, name))
    papers = feeds.open_papers(spark, feed=catalogue_feeds._orders_feed(spark, d, pages_overlap=True))
    assert papers.columns == ["base_id", "categories", "created", "authors", "title", "abstract"] and papers.count() == len(rows)
    assert not {"links", "comment", "journal_ref", "doi", "updated"} & set(stored[0])


def test_encoder_holds_the_cells_of_few_texts():
    rng, dim, cells = np.random.default_rng(1), 1024, 200
    size, idf, axes = 6000, rng.random(dim) + 1, rng.normal(size=(dim, 8))
    flat = pa.StructArray.from_arrays([pa.array(rng.integers(0, dim, size * cells), pa.int32()), pa.array(rng.integers(1, 5, size * cells), pa.int64())], names=["bucket", "tf"])
    terms = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * cells, pa.int32()), flat)
    tracemalloc.start()
    y = lsa.projected(terms, idf, axes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6                                     # all texts at once: 10 MB for each number of a cell
    assert np.allclose(y, lsa._times(*lsa._rows(terms, idf), axes), atol=1e-12)
    assert lsa.projected(terms.slice(0, 0), idf, axes).shape == (0, 8)
