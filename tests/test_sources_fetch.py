"""S9, S12-S14, S18, S20-S21, P13, P28, F10, E1 fetch, streaming ingest, M1 encoder forms."""

import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import encode, filters
from quire.plans.fetch import fetch_batch, snippets
from quire.sources import feeds, files, snapshot

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
  <entry>
    <id>http://arxiv.org/abs/2309.00543v1</id>
    <updated>2023-09-02T10:00:00Z</updated>
    <published>2023-09-01T12:34:56Z</published>
    <title>  T2 </title>
    <summary>  First line
second line  </summary>
    <author><name>A. One</name></author>
    <arxiv:comment>10 pages</arxiv:comment>
    <link href="http://arxiv.org/abs/2309.00543v1" rel="alternate" type="text/html"/>
    <link title="pdf" href="http://arxiv.org/pdf/2309.00543v1" rel="related" type="application/pdf"/>
    <arxiv:primary_category term="cs.LG" scheme="http://arxiv.org/schemas/atom"/>
    <category term="cs.LG" scheme="http://arxiv.org/schemas/atom"/>
    <category term="stat.ML" scheme="http://arxiv.org/schemas/atom"/>
  </entry>
  <entry>
    <id>http://arxiv.org/abs/2104.00001v2</id>
    <updated>2021-04-02T00:00:00Z</updated>
    <published>2021-04-01T00:00:00Z</published>
    <title>Second</title>
    <summary>S</summary>
    <author><name>B. Two</name></author>
    <author><name>C. Three</name></author>
    <arxiv:doi>10.1/x</arxiv:doi>
    <arxiv:primary_category term="math.AG" scheme="http://arxiv.org/schemas/atom"/>
    <category term="math.AG" scheme="http://arxiv.org/schemas/atom"/>
  </entry>
</feed>
"""

OAI = """<?xml version="1.0" encoding="UTF-8"?>
<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListIdentifiers>
<header><identifier>oai:arXiv.org:0704.0001</identifier><datestamp>2021-01-05</datestamp><setSpec>physics:hep-ph</setSpec></header>
<header><identifier>oai:arXiv.org:0704.0002</identifier><datestamp>2020-01-05</datestamp><setSpec>math</setSpec><setSpec>cs</setSpec></header>
</ListIdentifiers></OAI-PMH>
"""


def test_feed_entries(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    (d / "page1.xml").write_text(FEED)
    (d / "page2.xml").write_text('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"></feed>')
    e = feeds.read_feed_entries(spark, str(d))
    rows = {r.id: r for r in feeds.project_entries(e, full=True).collect()}
    a = rows["2309.00543v1"]
    assert a.title == "T2" and a.base_id == "2309.00543"          # no timestamp inference
    assert a.abstract == "First line\nsecond line"
    assert a.categories == ["cs.LG", "stat.ML"] and a.primary_category == "cs.LG"
    assert a.authors == ["A. One"] and a.comment == "10 pages" and a.doi is None
    assert rows["2104.00001v2"].authors == ["B. Two", "C. Three"]
    assert str(a.published_date) == "2023-09-01"
    papers = feeds.entries_as_papers(e)
    hit = filters.list_paper_ids(papers, categories="stat.ML", start_date="2023-01-01").collect()
    assert [r.base_id for r in hit] == ["2309.00543"]
    fb = feeds.project_entries(e)
    got = filters.feed_batch_filter(fb, "2309", "2023-01-01", "2023-12-31", ["cs.LG"]).collect()
    assert [r.id for r in got] == ["2309.00543v1"]
    with pytest.raises(ValueError):
        filters.feed_batch_filter(fb, None, None, "2023-12-31", ["cs.LG"])
    loaded = feeds.load_entries(e, num=1).collect()
    assert [r.id for r in loaded] == ["2104.00001v2"]
    assert feeds.load_entries(e).count() == 2                     # no cap unless a number is given
    (d / "page10.xml").write_text(FEED.replace("  T2 ", "  T10 ").replace("2104.00001v2", "2104.00009v1"))
    again = feeds.read_feed_entries(spark, str(d), position=True)
    last = filters.feed_batch_filter(feeds.project_entries(again), "2309", "2023-01-01", "2023-12-31", ["cs.LG"], position="_pos")
    assert [(r.id, r.title) for r in last.collect()] == [("2309.00543v1", "T10")]      # page10 comes after page1
    routed = feeds.open_papers(spark, index=str(tmp_path / "none"), feed=str(d))
    assert [r.base_id for r in filters.list_ids_sorted(routed).collect()] == ["2104.00001", "2104.00009", "2309.00543"]
    with pytest.raises(FileNotFoundError):
        feeds.open_papers(spark, index=str(tmp_path / "none"))


def test_oai_headers(spark, tmp_path):
    p = tmp_path / "oai.xml"
    p.write_text(OAI)
    h = feeds.read_oai_headers(spark, str(p))
    got = feeds.list_identifiers(h, start="2021-01-01").collect()
    assert [r.identifier for r in got] == ["oai:arXiv.org:0704.0001"]
    got = feeds.list_identifiers(h, set_spec="physics").collect()
    assert [r.identifier for r in got] == ["oai:arXiv.org:0704.0001"]
    assert feeds.list_identifiers(h, set_spec="phys").count() == 0
    got = feeds.list_identifiers(h, set_spec="cs").collect()
    assert [r.identifier for r in got] == ["oai:arXiv.org:0704.0002"]


def _tar(members):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def test_artefacts_and_fetch(spark, tmp_path):
    art = tmp_path / "art"
    art.mkdir()
    (art / "2309.00543v1.tar.gz").write_bytes(_tar([("README", b"x"), ("main.tex", b"\\section{A}\r\nline 2\n")]))
    (art / "2104.00001v1.tar.gz").write_bytes(_tar([("fig.png", b"png")]))
    (art / "2104.00003v1.tar.gz").write_bytes(b"not a tarball")
    (art / "2309.00543v1.html").write_bytes(b"<p>a</p>\r\n<p>b</p>\n")
    (art / "2309.00543v1.pdf").write_bytes(b"%PDF-1.5" + bytes(100))
    arts = files.read_artefacts(spark, str(art))
    parsed = files.source_lines(arts.where("format = 'source'"))
    assert parsed.columns == ["id", "source"]
    src = {r.id: r.source for r in parsed.collect()}
    assert src == {"2309.00543v1": ["\\section{A}", "line 2"], "2104.00001v1": [], "2104.00003v1": None}

    # index from a snapshot, then the fetch plan
    snap = tmp_path / "snap.json"
    recs = [{"id": "2309.00543", "title": "Good", "authors": "A", "categories": "cs.LG stat.ML",
             "abstract": "l1\nl2\nl3\nl4", "versions": [{"created": "Fri, 1 Sep 2023 12:34:56 GMT"}]},
            {"id": "2104.00001", "title": "Other", "categories": "math.AG",
             "versions": [{"created": "Thu, 1 Apr 2021 00:00:00 GMT"}]},
            {"id": "2104.00003", "title": "Third", "categories": "cs.LG",
             "versions": [{"created": "Fri, 2 Apr 2021 00:00:00 GMT"}]}]
    snap.write_text("\n".join(json.dumps(r) for r in recs))
    idx = str(tmp_path / "idx")
    snapshot.build_index(spark, str(snap), idx, overwrite=True)
    papers = spark.read.parquet(idx)

    md = fetch_batch(papers, r"^2309.00543v1$", formats="metadata").collect()
    assert [(r.id, r.title, r.published) for r in md] == [("2309.00543v1", "Good", "2023-09-01T12:34:56+00:00")]

    allf = fetch_batch(papers, r"^2\d+", category=["cs.LG"], formats=["metadata", "abstract", "pdf", "html", "latex"],
                       artefacts=arts, output_dir=str(tmp_path / "out")).collect()
    rows = {r.id: r for r in allf}
    assert set(rows) == {"2309.00543v1", "2104.00003v1"}
    r = rows["2309.00543v1"]
    assert r.metadata.id == "2309.00543v1" and r.abstract == "l1\nl2\nl3\nl4"
    assert r.html == ["<p>a</p>", "<p>b</p>"] and r.source == ["\\section{A}", "line 2"]
    assert bytes(r.pdf)[:8] == b"%PDF-1.5" and r.pdf_path == str(tmp_path / "out" / "2309.00543v1.pdf")
    assert rows["2104.00003v1"].source is None and rows["2104.00003v1"].pdf is None
    assert rows["2104.00003v1"].pdf_path is None
    named = [p for x in allf for p in (x.pdf_path, x.html_path, x.source_path) if p]
    assert len(named) == 4 and sorted(f.name for f in (tmp_path / "out").iterdir()) == sorted(p.rsplit("/", 1)[1] for p in named)
    for p in named:                                      # every file that the result names has the artefact's bytes
        assert (tmp_path / "out" / p.rsplit("/", 1)[1]).read_bytes() == (art / p.rsplit("/", 1)[1]).read_bytes()
    sn = {x.id: x for x in snippets(fetch_batch(papers, "2309", formats=["abstract"])).collect()}
    assert sn["2309.00543v1"].abstract_head == "l1\nl2\nl3"


def test_citation_edges_and_sinks(spark, tmp_path):
    p = tmp_path / "cites.json.gz"
    with gzip.open(p, "wt") as f:
        json.dump({"a": ["b", "c", "b"], "d": ["a"]}, f)
    e = files.read_citation_edges(spark, str(p))
    assert sorted(tuple(r) for r in e.collect()) == [("a", "b"), ("a", "c"), ("d", "a")]
    p = tmp_path / "pretty.json"
    p.write_text(json.dumps({"a": ["b", "c"], "empty": [], "d": ["a"]}, indent=2))
    e = files.read_citation_edges(spark, str(p))
    assert sorted(tuple(r) for r in e.collect()) == [("a", "b"), ("a", "c"), ("d", "a")]
    df = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [3.0, 4.0])], "id string, v array<double>")
    out = files.write_wide_csv(encode.widen(df, "v", 2, prefix="title_emb"), str(tmp_path / "wide"))
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["title_emb_0", "title_emb_1"] and back.count() == 2


def test_stream_ingest(spark, tmp_path):
    from quire.streaming.ingest import start_index_ingest
    src = tmp_path / "drops"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"id": "1", "title": "t1"}) + "\n{bad\n")
    dest = str(tmp_path / "idx")
    q = start_index_ingest(spark, str(src), dest, checkpoint=str(tmp_path / "cp"))
    q.awaitTermination(120)
    (src / "b.json").write_text("\n".join(json.dumps(r) for r in [
        {"id": "2", "title": "t2"}, {"id": "1", "title": "t1 again"}, {"id": "1", "title": "t1 last"}]) + "\n")
    q = start_index_ingest(spark, str(src), dest, checkpoint=str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted((r.base_id, r.title) for r in spark.read.parquet(dest).collect())
    assert got == [("1", "t1"), ("1", "t1 again"), ("1", "t1 last"), ("2", "t2")]   # each file read once
    last = sorted((r.base_id, r.title) for r in snapshot.load_index(spark, dest, ["title"], dedup="last").collect())
    assert last == [("1", "t1 last"), ("2", "t2")]    # exact order inside one dropped file
    first = sorted((r.base_id, r.title) for r in snapshot.load_index(spark, dest, ["title"], dedup="first").collect())
    assert first == [("1", "t1"), ("2", "t2")]        # earlier drop wins


TEXTS = [None, "", "word", "a short sentence here", "A paragraph.  With\ttabs\nand lines, word word word."]


def test_hashed_encoder_forms_agree(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    dense = {r.k: r.v for r in df.select("k", encode.hashed_embedding("text", 32).alias("v")).collect()}
    sparse = encode.hashed_term_weights(df, "k", "text", 32).collect()
    for k in range(len(TEXTS)):
        v = np.zeros(32)
        for r in sparse:
            if r.k == k:
                v[r.bucket] = r.weight
        assert np.allclose(dense[k], v)
        assert len(dense[k]) == 32
    assert not any(dense[0]) and not any(dense[1])
    emb = encode.embed_columns(df.withColumn("t2", F.upper("text")), "k", ["text", "t2"], dim=8)
    assert emb.columns == ["k", "text_emb", "t2_emb"]


def test_newest_record_decides(spark, tmp_path):
    """An id whose last record left the category or the dates is not returned for an older record."""
    snap = tmp_path / "snap.json"
    v = lambda d: [{"created": f"{d} 00:00:00 GMT"}]
    recs = [{"id": "1", "categories": "cs.LG", "versions": v("1 Apr 2021")}, {"id": "2", "categories": "cs.LG", "versions": v("1 Apr 2021")},
            {"id": "1", "categories": "math.CO", "versions": v("1 Apr 2021")}, {"id": "2", "categories": "cs.LG x.Y", "versions": v("2 Apr 2021")}]
    snap.write_text("\n".join(json.dumps(r) for r in recs))
    for layout in ("none", "sorted"):
        papers = spark.read.parquet(snapshot.build_index(spark, str(snap), str(tmp_path / layout), layout=layout))
        got = fetch_batch(papers, None, category=["cs.LG"], formats="metadata").collect()
        assert [(r.id, r.categories) for r in got] == [("2v1", "cs.LG x.Y")]
        assert fetch_batch(papers, None, end_date="2021-04-01", category="cs.LG").count() == 0


def test_cli_job_from_feed_with_files(spark, tmp_path, capsys):
    from quire import job
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p1.xml").write_text(FEED)
    (tmp_path / "art").mkdir()
    (tmp_path / "art" / "2309.00543v1.html").write_bytes(b"<p>a</p>")
    out = tmp_path / "out"
    assert job.main(["--feed", str(tmp_path / "pages"), "--id", "2309", "--formats", "html", "--artefacts", str(tmp_path / "art"),
                     "--output-dir", str(out)]) == 0
    r = spark.read.parquet(str(out / "results")).first()
    assert r.html == ["<p>a</p>"] and r.html_path == str(out / "2309.00543v1.html")
    assert (out / "2309.00543v1.html").read_bytes() == b"<p>a</p>"


def test_cli_job(spark, tmp_path, capsys):
    from quire import job
    snap = tmp_path / "snap.json"
    recs = [{"id": "2104.00001", "title": "A", "categories": "cs.LG", "abstract": "x",
             "versions": [{"created": "Thu, 1 Apr 2021 00:00:00 GMT"}]},
            {"id": "2104.00002", "title": "B", "categories": "math.AG",
             "versions": [{"created": "Thu, 1 Apr 2021 00:00:00 GMT"}]},
            {"id": "2203.00001", "title": "C", "categories": "cs.LG",
             "versions": [{"created": "Tue, 1 Mar 2022 00:00:00 GMT"}]}]
    snap.write_text("\n".join(json.dumps(r) for r in recs))
    out = tmp_path / "out"
    rc = job.main(["--snapshot", str(snap), "--id", r"^2104\.\d+", "--start", "2021-01-01",
                   "--end", "2021-12-31", "--category", "cs.LG", "--formats", "metadata",
                   "--output-dir", str(out), "--verbose"])
    assert rc == 0
    rows = spark.read.parquet(str(out / "results")).collect()
    assert [(r.id, r.title, r.published) for r in rows] == [("2104.00001v1", "A", "2021-04-01T00:00:00+00:00")]
    assert str(out / "results") in capsys.readouterr().out
