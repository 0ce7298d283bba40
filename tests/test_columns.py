"""F1-F3, F7, P1/P2, P5-P7, P9-P11, P14, P17-P19, P24 against plain-Python brute force."""

import datetime as dt
import re
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from quire.functions import categories as cat
from quire.functions import dates, ids, text
from quire.operators import filters

IDS = ["2309.00543", "2104.1", "x2104.1", "math/0309136", "solv-int/9901001"]
VIDS = [i + v for i in IDS for v in ("v1", "v2")]
PATTERNS = [r"^2104\.\d+", "2309", r"^2309.00543v1$", "2309.00543v1", "solv", r"math/03\d+v2"]


def _df(spark, col, values):
    return spark.createDataFrame([(v,) for v in values], f"{col} string")


def test_regex_search_and_match(spark):
    df = _df(spark, "base_id", IDS)
    for p in PATTERNS:
        got_s = {r.base_id for r in df.where(ids.regex_search("base_id", p)).collect()}
        got_m = {r.base_id for r in df.where(ids.regex_match("base_id", p)).collect()}
        assert got_s == {i for i in IDS if re.search(p, i)}, p
        assert got_m == {i for i in IDS if re.match(p, i)}, p


def test_versioned_ids(spark):
    df = _df(spark, "base_id", IDS)
    for p in PATTERNS + [None]:
        got = {(r.base_id, r.versioned_id) for r in filters.versioned_ids(df, p).collect()}
        if p is None:
            want = {(i, i + "v1") for i in IDS}
        else:
            m = re.search(r"(v\d+)\$?$", p)
            if m:
                base = p[:m.start()].rstrip("$")
                want = {(i, i + m.group(1)) for i in IDS
                        if re.match(base, i) and re.match(p, i + m.group(1))}
            else:
                want = {(i, i + "v1") for i in IDS if re.match(p, i)}
        assert got == want, p
    # the documented example (pattern ends in "$") finds its paper
    got = filters.versioned_ids(df, r"^2309.00543v1$").collect()
    assert [(r.base_id, r.versioned_id) for r in got] == [("2309.00543", "2309.00543v1")]


def test_base_id_and_url(spark):
    df = _df(spark, "vid", VIDS + ["nover"])
    got = {r.vid: r.b for r in df.select("vid", ids.base_id("vid").alias("b")).collect()}
    for v in VIDS:
        assert got[v] == v[:-2]
    assert got["nover"] == "nover"
    u = _df(spark, "url", ["http://arxiv.org/abs/math/0309136v1", "http://arxiv.org/abs/2309.00543v1"])
    r = u.select(ids.id_from_url("url").alias("a"), ids.id_from_url("url", old_ids=True).alias("b")).collect()
    assert [(x.a, x.b) for x in r] == [("0309136v1", "math/0309136v1"), ("2309.00543v1", "2309.00543v1")]


STAMPS = ["Fri, 1 Sep 2023 12:34:56 GMT", "Mon, 2 Apr 2007 19:18:42 GMT",
          "Tue, 2 Apr 2007 23:30:00 -0500", "2 Apr 2007 23:30:00 +0130", "garbage", "",
          "Wed, 10 Jan 2001 05:06:07 -0000", "Wed, 10 Jan 2001 05:06:07 EST", "10 Jan 2001 5:06 PDT",
          "10 Jan 2001 05:06:07 Z", "10 Jan 2001 05:06:07 XYZ", "10 Jan 2001 99:99:99 GMT", "10 Jan 2001 24:00:00 GMT",
          "10 Jan 2001 23:60:00 GMT", "10 Jan 2001 23:59:60 GMT", "31 Feb 2001 00:00:00 GMT"]


def test_rfc2822(spark):
    df = _df(spark, "s", STAMPS + [None])
    out = {r.s: r for r in df.select("s", dates.rfc2822_date("s").alias("d"),
                                     dates.rfc2822_iso("s").alias("iso"),
                                     F.unix_timestamp(dates.rfc2822_instant("s")).alias("t")).collect()}
    for s in STAMPS:
        try:
            ref = parsedate_to_datetime(s)
        except (TypeError, ValueError, IndexError):
            ref = None
        r = out[s]
        if ref is None:
            assert r.d is None and r.iso is None, s
            continue
        assert r.d == ref.date(), s
        assert r.iso == ref.isoformat(), s
        if ref.tzinfo is not None:
            assert r.t == int(ref.timestamp()), s


def test_date_null_rule(spark):
    rows = [("a", dt.date(2021, 1, 1)), ("b", dt.date(2021, 6, 30)), ("c", dt.date(2022, 1, 1)), ("n", None)]
    df = spark.createDataFrame(rows, "id string, created date")

    def ref(start, end):
        out = set()
        for i, c in rows:
            cd = c.isoformat() if c else ""
            if start and cd < start:
                continue
            if end and cd > end:
                continue
            out.add(i)
        return out
    for s, e in [(None, None), ("2021-01-01", None), (None, "2021-06-30"), ("2021-01-01", "2021-06-30"),
                 ("2021-06-30", "2021-06-30")]:
        got = {r.id for r in df.where(dates.date_in_range("created", s, e)).collect()}
        assert got == ref(s, e), (s, e)


CATS = ["cs.LG stat.ML", "cs.L", "  cs.LG  ", "", "funct-an", "alg-geom", "hep-th", "cmp-lg", "q-bio.NC", None]


def test_categories(spark):
    df = _df(spark, "c", CATS)
    got = {r.c: r for r in df.select("c", filters.category_any_of("c", ["cs.LG", "hep-th"]).alias("hit"),
                                     cat.primary_category("c").alias("p"),
                                     cat.normalised_category("c").alias("g")).collect()}
    groups = cat.CATEGORY_GROUPS
    for c in CATS:
        toks = (c or "").split()
        assert bool(got[c].hit) == any(t in toks for t in ["cs.LG", "hep-th"]), c
        prim = toks[0] if toks else None
        assert got[c].p == prim, c
        if prim is not None:
            main = prim.split(".")[0]
            assert got[c].g == groups.get(main, main), c
    assert len(groups) == 31


def test_text_helpers(spark):
    samples = ["a\r\nb\nc\rd", "one\n", "", "x\x0by\x0cz w", "no break", "\n\n", "tail\r\n",
               "\u3000\xa0 padded \u00e9 \u2029\x1f", "\x85", "  mid  "]
    df = _df(spark, "s", samples)
    got = {r.s: r for r in df.select("s", text.lines("s").alias("l"), text.snippet("s", 3).alias("sn"),
                                     text.strip("s").alias("st")).collect()}
    for s in samples:
        assert got[s].l == s.splitlines(), repr(s)
        assert got[s].sn == "\n".join(s.splitlines()[:3]), repr(s)
        assert got[s].st == s.strip(), repr(s)
    a = spark.createDataFrame([(["A. One", "B. Two"],)], "a array<string>")
    assert a.select(text.join_authors("a")).first()[0] == "A. One, B. Two"
    n = spark.createDataFrame([(None,), (3,)], "x int")
    assert [r[0] for r in n.select(text.blank_if_null("x")).collect()] == ["", "3"]
    assert text.normalise_formats(["latex", "pdf", "tex", "source", "pdf"]) == ["source", "pdf"]
    assert text.normalise_formats("metadata") == ["metadata"]
