"""Chained pages: stream offsets are resumption tokens, a stopped harvest goes on, filters skip pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.sources import harvest


def header(k, day, more=""):
    return f"<header{more}><identifier>oai:{k}</identifier><datestamp>{day}</datestamp><setSpec>a:{k % 2}</setSpec></header>"


def stage(folder, token, after, heads, prefix=""):
    end = "" if after is None else f"<resumptionToken cursor='1'>{after}</resumptionToken>"
    (folder / harvest.page_name(token)).write_text(f"<OAI-PMH xmlns='urn:x'><ListIdentifiers>{prefix}{''.join(heads)}{end}</ListIdentifiers></OAI-PMH>")


def days(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=31 * k)


@pytest.fixture
def pages(tmp_path):
    """Five pages of three headers, a month each; the token of a page has signs that XML escapes."""
    folder = tmp_path / "pages"
    folder.mkdir()
    tokens = ["", *[f"t&amp;{k}" for k in range(1, 5)]]
    for k, t in enumerate(tokens):
        stage(folder, t.replace("&amp;", "&"), tokens[k + 1] if k < 4 else "", [header(10 * k + j, days(k)) for j in range(3)])
    return folder


def names(rows):
    return sorted(r.identifier for r in rows)


ALL = sorted(f"oai:{10 * k + j}" for k in range(5) for j in range(3))


def test_batch_reads_the_whole_chain_and_nothing_else(spark, pages):
    stage(pages, "not in the chain", "", [header(99, days(0))])
    rows = harvest.read_pages(spark, str(pages)).collect()
    assert names(rows) == ALL
    assert {(r.identifier, r.page, r.datestamp) for r in rows} == {(f"oai:{10 * k + j}", k, days(k)) for k in range(5) for j in range(3)}
    assert all(r.setSpec == [f"a:{int(r.identifier[4:]) % 2}"] and r.deleted is False for r in rows)


def test_date_filters_skip_pages(spark, pages, tmp_path):
    directory = harvest.build_directory(spark, str(pages), str(tmp_path / "directory"))
    stage(pages, "t&4", "late", [header(40 + j, days(4)) for j in range(3)])   # goes on with a page the directory lacks

    def read(cond):
        df = harvest.read_pages(spark, str(pages), directory).where(cond)
        return df.rdd.getNumPartitions(), names(df.collect())

    day = F.col("datestamp")
    assert read(day == F.lit(days(2))) == (1, [f"oai:2{j}" for j in range(3)])
    assert read((day > F.lit(days(0))) & (day <= F.lit(days(2)))) == (3, sorted(f"oai:{k}{j}" for k in (1, 2) for j in range(3)))
    assert read(day < F.lit(dt.date(2000, 1, 1)))[1] == []
    assert read(F.col("identifier") == "oai:30") == (5, ["oai:30"])


@pytest.fixture
def run(spark, tmp_path):
    def go(folder, fail=False):
        seen = []

        def batch(df, k):
            rows = df.collect()
            if fail:
                raise RuntimeError("stopped")
            df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={k}"))
            seen.extend(rows)

        q = (harvest.stream_pages(spark, str(folder)).writeStream.foreachBatch(batch)
             .option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start())
        if fail:
            with pytest.raises(Exception, match="stopped"):
                q.awaitTermination()
        else:
            q.awaitTermination()
        return names(seen)
    return go


def test_a_harvest_goes_on_at_its_token(spark, tmp_path, pages, run):
    part = tmp_path / "part"
    part.mkdir()
    staged = [harvest.page_name(t) for t in ("", "t&1", "t&2", "t&3", "t&4")]

    def copy(*ks):
        for k in ks:
            (part / staged[k]).write_bytes((pages / staged[k]).read_bytes())

    assert harvest.next_token(str(part)) == ""
    copy(0, 1, 3)                                          # page 2 is missing: page 3 is not reached
    assert harvest.next_token(str(part)) == "t&2"
    assert run(part) == sorted(f"oai:{10 * k + j}" for k in (0, 1) for j in range(3))
    assert run(part) == []                                 # nothing new
    copy(2)
    run(part, fail=True)                                   # stopped inside a batch: the batch is run again
    assert run(part) == sorted(f"oai:{10 * k + j}" for k in (2, 3) for j in range(3))
    copy(4)
    assert run(part) == [f"oai:4{j}" for j in range(3)]
    assert harvest.next_token(str(part)) is None and run(part) == []
    assert names(spark.read.parquet(str(tmp_path / "out")).collect()) == ALL


def test_odd_pages(spark, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    assert harvest.read_pages(spark, str(empty)).count() == 0
    stage(empty, "", None, [], prefix="<error code='noRecordsMatch'/>")        # no headers, no token
    assert harvest.read_pages(spark, str(empty)).count() == 0 and harvest.next_token(str(empty)) is None
    odd = tmp_path / "odd"
    odd.mkdir()
    stage(odd, "", "x", [header(1, "no date"), header(1, "no date"), header(2, "2020-02-03T04:05:06Z", " status='deleted'")])
    stage(odd, "x", "", ["<header/>"])
    rows = harvest.read_pages(spark, str(odd)).collect()
    assert sorted((r.identifier or "", str(r.datestamp), r.deleted, r.page) for r in rows) == [
        ("", "None", False, 1), ("oai:1", "None", False, 0), ("oai:1", "None", False, 0), ("oai:2", "2020-02-03", True, 0)]
    stage(odd, "x", "x", [])                               # comes back to itself
    with pytest.raises(Exception, match="come back"):
        harvest.read_pages(spark, str(odd)).count()
    (odd / harvest.page_name("x")).write_text("<OAI-PMH>")
    with pytest.raises(Exception, match="is not a page"):
        harvest.read_pages(spark, str(odd)).count()
