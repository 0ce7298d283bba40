"""Operators 9 and 10 against brute force."""

import gzip
import hashlib
import io
import re
from collections import defaultdict

import pytest

from quire.llm import licenses, queries, warc
from quire.llm.common import open_fs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_scan(text):
    w, places, labels, best = words(text), [], set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [k for k in range(len(w)) if w[k:k + len(p)] == p]
        places += [(k, label) for k in at]
    for template, label in licenses.TEMPLATES.items():
        t, m = set(words(template)), len(words(template))
        held = max((len(t & set(w[k:k + m])) for k in range(max(1, len(w) - m + 1))), default=0)     # every run of m words
        if held >= licenses.CONTAINMENT * len(t) - 1e-9:
            labels.add(label)
            best = max(best, held / len(t))
    base = {x for _, x in places}
    starts = [k for k, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), best or (0.5 if places else 0.0))


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)
                   if not isinstance(r.base_labels, str) else r.base_labels,
                   ",".join(r.labels) if not isinstance(r.labels, str) else r.labels, r.score) for r in df.collect())


def test_license_query(spark, sf_middle):
    docs = spark.read.parquet(f"{sf_middle}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *plain_scan(r.text)) for r in docs)
    got = rows_of(queries.op9_licenses(spark, sf_middle))
    assert got == want and sum(bool(r[6]) for r in got) > 5


def test_license_odd_rows(spark):
    notices = list(licenses.TEMPLATES)
    texts = [None, "", " \n ", "MIT License", "mit license mit LICENSE\nmit-license", "x mit license\ny general,public;license z apache license",
             "mitlicense mit licenses", "É mit license é", "mit\nlicense", "MIT\x00License\x7f", "mit license " * 20_000,
             *notices, *(n.upper() + " and more" for n in notices), *(" ".join(n.split()[1:]) for n in notices),
             *(" ".join(reversed(n.split())) for n in notices), "\n".join(notices), " ".join(notices),
             *(n + " w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12" for n in notices), "line one\n" + notices[0] + "\nend"]
    rows = [(k, t, 1.0) for k, t in enumerate(texts)] + [(3, "MIT License", 1.0), (None, notices[0], 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels double").repartition(3)
    got = rows_of(licenses.scan(df))
    assert got == sorted((i if i is not None else -1, *plain_scan(t)) for i, t, _ in rows)
    assert licenses.scan(df.limit(0)).count() == 0
    assert {r.score for r in licenses.scan(df, templates={}).collect()} == {0.0, 0.5}
    with pytest.raises(ValueError):
        licenses.scan(df, phrases={"a b a": "x"})


def test_notices_wrapped_or_among_other_words(spark):
    bsd = next(n for n, label in licenses.TEMPLATES.items() if label == "bsd")
    more = " ".join(f"w{k}" for k in range(60))
    wrapped = bsd.replace("without ", "without\n# ")
    texts = [bsd + " " + more, more + " " + bsd, wrapped, bsd, f"{more}\n{wrapped}\n{more}", (bsd + " ") * 30, " ".join(f"x {w}" for w in bsd.split()),
             f"{bsd.split('binary')[0]} {more} {bsd.split('binary')[1]}", "redistribution " * 3000 + bsd, "met " * 500 + wrapped + " met" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(licenses.scan(df))
    assert got == sorted((k, *plain_scan(t)) for k, t in enumerate(texts))
    assert [r[6] for r in got] == ["bsd"] * 6 + ["", "", "bsd", "bsd"] and got[3][7] == 1.0


def test_license_plan_is_native(spark, sf):
    plan = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def plain_pages(rows):
    least = defaultdict(list)
    for i, _, html in rows:
        least[(html or "").encode()].append(i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        first = min((x for x in least[p] if x is not None), default=None)
        revisit = len(p) >= 100 and i != first
        out.append((i if i is not None else -1, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response",
                    first if revisit else None))
    return sorted(out, key=str)


def pages_of(df):
    return sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in df.collect()), key=str)


def test_warc_query(spark, sf_middle):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_middle}/pages.parquet").select("page_id", "url", "html").collect()]
    assert pages_of(queries.op10_warc(spark, sf_middle)) == plain_pages(rows)


def test_warc_odd_rows(spark):
    big, huge = "<p>é</p>" * 30, "<p>" + "x y " * 1_500_000
    rows = [(k, f"http://a/{k}", big) for k in (9, 4, 7, 5)] + [(1, None, None), (2, "u\r\nX: y", ""), (3, "", "short"), (6, "", "short"),
                                                               (None, "n", big), (8, "h", huge), (10, "h", huge), (-3, "m", "neg" * 50),
                                                               (11, "x", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = warc.write(df)
    got = warc.read(spark, folder, with_payload=True)
    assert pages_of(got) == plain_pages(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id] if r.record_type == "response" else r.payload is None for r in got.collect())
    empty = df.limit(0)
    assert warc.read(spark, warc.write(empty)).count() == 0


def test_warc_repeated_rows(spark):
    df = spark.createDataFrame([(5, "u", "z" * 200)] * 3 + [(6, "u", "z" * 200)], "page_id long, url string, html string")
    got = warc.read(spark, warc.write(df)).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(5, "response")] * 3 + [(6, "revisit")]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {5}


def test_archives_are_gzip_members_and_damage_is_found(spark):
    rows = [(k, f"http://a/{k}", f"<p>{k}</p>" * 50) for k in range(20)]
    folder = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    fs, path = open_fs(folder)
    from pyarrow import fs as pafs
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".warc.gz")]
    data = fs.open_input_stream(files[0]).read()
    for chunk in (1, 7, 1000, 1 << 20):                    # any way of cutting the stream gives the same records
        assert len(list(warc.records(io.BytesIO(data), chunk))) == 21
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\nWARC-Type") == 21
    for bad in (text.replace(b"<p>7</p>", b"<p>8</p>", 1), text.replace(b"Content-Length: 400\r\n\r\n", b"Content-Length: 399\r\n\r\n"),
                text[:-30]):
        parts = re.split(rb"(?=WARC/1\.1\r\nWARC-Type)", bad)[1:]
        with pytest.raises(warc.BadRecord):
            list(warc.records(io.BytesIO(b"".join(map(gzip.compress, parts)))))
    with pytest.raises(warc.BadRecord):
        list(warc.records(io.BytesIO(data[:-5])))
