"""Stored pages and cursors against a sorted list."""

import datetime as dt
import re

import pytest

from quire.operators import pages


def order(r):
    return (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or dt.date.min)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    day = dt.date(2020, 1, 1)
    rows = [(k * 7919 % 500, day + dt.timedelta(days=k % 11), f"t{k}") for k in range(1000)]
    rows += [(None, day, "n1"), (None, None, "n2"), (3, None, "n3")] + [(250, day, f"tie{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "a int, b date, `x.y` string").repartition(7)
    return pages.store_pages(df, ["a", "b"], str(tmp_path_factory.mktemp("pages") / "p"), partitions=9), sorted(rows, key=order)


@pytest.mark.parametrize("start,n", [(0, 10), (0, None), (5, 1), (700, 300), (1402, 50), (1403, 5), (99999, 5), (1000, None), (3, 0)])
def test_pages_by_position(spark, stored, start, n):
    where, want = stored
    got = sorted(pages.read_page(spark, where, start, n).collect(), key=lambda r: r.position)
    stop = len(want) if n is None else min(len(want), start + n)
    assert [r.position for r in got] == list(range(start, stop))
    assert [tuple(r)[:2] for r in got] == [r[:2] for r in want[start:stop]]
    if n is None and not start:
        assert sorted(r["x.y"] for r in got) == sorted(r[2] for r in want)


@pytest.mark.parametrize("key", [(None, None), (None, dt.date(2020, 1, 1)), (3, None), (250, dt.date(2020, 1, 1)), (-1, None),
                                 (499, dt.date(2030, 1, 1)), (100, dt.date(2019, 1, 1))])
def test_cursors(spark, stored, key):
    where, want = stored
    behind = [r for r in want if order(r) > order(key)]
    got = sorted(pages.read_after(spark, where, key, 20).collect(), key=lambda r: r.position)
    assert pages.position_after(spark, where, key) == len(want) - len(behind)
    assert [tuple(r)[:2] for r in got] == [r[:2] for r in behind[:20]]


def test_a_deep_page_reads_its_partition_and_sorts_nothing(spark, stored):
    where, want = stored
    deep = pages.read_page(spark, where, 1200, 3)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and re.search(r"PartitionFilters: \[[^\]]*_part", plan)
    assert "PushedFilters: [" in plan and deep.count() == 3


def test_empty_finished_and_clashing(spark, tmp_path):
    df = spark.createDataFrame([], "a int, b string")
    where = pages.store_pages(df, "a", str(tmp_path / "e"))
    assert pages.read_page(spark, where, 0, 5).count() == 0 and pages.position_after(spark, where, (1,)) == 0
    assert pages.read_page(spark, where).columns == ["a", "b", "position"]
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    assert pages.store_pages(one, "a", where) == where and pages.read_page(spark, where).count() == 0    # kept
    pages.store_pages(one, "a", where, overwrite=True)
    assert [tuple(r) for r in pages.read_page(spark, where).collect()] == [(1, "x", 0)]
    with pytest.raises(ValueError, match="position"):
        pages.store_pages(one.withColumnRenamed("b", "position"), "a", str(tmp_path / "c"))
