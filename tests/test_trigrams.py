"""The substring index gives the rows of a scan, and reads fewer blocks."""

import re

import pytest

from quire.operators import trigrams
from quire.operators.filters import paper_predicate

SCHEMA = "base_id string, authors string, title string, extra int"


@pytest.fixture(scope="module")
def papers(spark):
    rows = [(f"{2000 + k // 40:04d}.{k:05d}", f"Author{k % 7} Ωmega{k}", f"On topic {k} of many" if k % 3 else None, k) for k in range(400)]
    rows += [("math/0309136", "Ünal KKelvin", "a.b*c (d) Σίσυφος ΑΣ", 1), (None, None, None, 2), ("ab", "xy", "", 3)]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def index(papers, tmp_path_factory):
    return trigrams.build_index(papers, str(tmp_path_factory.mktemp("index") / "i"), block_rows=20)


@pytest.mark.parametrize("search, fewer", [
    ({"title": "topic 17 "}, True), ({"title": "c (d)"}, True), ({"title": "ab"}, False), ({"title": "nowhere"}, True), ({"title": "ΑΣ"}, False),
    ({"author": "Author3"}, False), ({"author": "ωMEGA39", "case_sensitive": False}, True), ({"author": "ωMEGA39"}, True),
    ({"author": "kkelvin", "case_sensitive": False}, True), ({"author": "Kelvin"}, True),
    ({"regex_id": r"2003\.0012\d"}, True), ({"regex_id": r"^2003\.0012[3-5]$"}, True), ({"regex_id": r"math/(03091)+36v2$"}, True),
    ({"regex_id": r"(2003|2004)\.00"}, False), ({"regex_id": "(?i)MATH"}, False), ({"regex_id": r"20(?:03)?\.0012"}, True),
    ({"regex_id": r"\d+"}, False), ({"regex_id": r"\Qmath/0\E"}, False), ({"regex_id": "2003", "anchored": True}, False),
    ({"regex_id": r"2004", "title": "topic 16", "author": "Author"}, True), ({}, False)])
def test_same_rows_as_the_scan(spark, papers, index, search, fewer):
    pred = {k: v for k, v in search.items() if k != "case_sensitive"}
    want = sorted(map(str, papers.where(paper_predicate(case_sensitive=search.get("case_sensitive", True), **pred)).collect()))
    assert sorted(map(str, trigrams.search(spark, index, **search).collect())) == want
    blocks = trigrams.candidate_blocks(spark, index, **{k: v for k, v in search.items() if k != "anchored"})
    n = trigrams._rows(spark, index).select("block").distinct().count()
    assert n > 15 and (blocks is not None and len(blocks) <= n / 2) == fewer


def test_only_candidate_partitions_are_read(spark, index):
    found = trigrams.search(spark, index, title="topic 17 ")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block#", plan), plan


def test_literals():
    r = trigrams.required_literals
    assert r("abc") == ["abc"] and r("a(bc)d$") == ["abcd"] and r("ab*c") == ["a", "c"] and r("x(ab){2,}c") == ["x", "ab", "c"]
    assert r("ab|cd") == [] and r("(?i)abc") == [] and r("a(?=bcd)e") == ["a", "e"] and r("[") == [] and r("(?i:abc)de") == ["de"]


def test_empty_table(spark, papers, tmp_path):
    root = trigrams.build_index(papers.limit(0), str(tmp_path / "e"))
    assert trigrams.search(spark, root, title="topic").count() == 0
