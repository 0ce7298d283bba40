"""S1-S5, P1-P4, A4 on a snapshot with edge rows (FIXTURES.md, snapshot_edges)."""

import datetime as dt
import json

import pytest

from quire.sources import snapshot

GOOD = {"id": "2309.00543", "authors": "A. One and B. Two", "title": "Good title",
        "categories": "cs.LG stat.ML", "abstract": "Line one\nLine two",
        "versions": [{"version": "v1", "created": "Fri, 1 Sep 2023 12:34:56 GMT"},
                     {"version": "v2", "created": "Mon, 4 Sep 2023 10:00:00 GMT"}]}
LINES = [
    json.dumps(GOOD),
    "{bad",
    json.dumps({"title": "no id"}),
    json.dumps({"id": "", "title": "empty id"}),
    json.dumps({"id": "2104.00001", "versions": [], "categories": "math.AG", "title": "no versions"}),
    json.dumps({"id": "2104.00002", "versions": [{"created": "garbage"}], "title": "bad date"}),
    json.dumps({"id": "2104.00003", "versions": [{"created": "Tue, 2 Apr 2007 23:30:00 -0500"}],
                "title": "offset date", "categories": "hep-th"}),
    json.dumps({**GOOD, "title": "Duplicate later title"}),
    json.dumps({"id": "math/0309136", "versions": [{"created": "Mon, 8 Sep 2003 00:00:00 GMT"}],
                "title": "old id, no categories"}),
]


@pytest.fixture(scope="module")
def snap(tmp_path_factory):
    d = tmp_path_factory.mktemp("snap")
    p = d / "snapshot.json"
    p.write_text("\n".join(LINES) + "\n")
    return str(p), d


def test_scan_drops_bad_and_idless(spark, snap):
    path, _ = snap
    rows = snapshot.scan_snapshot(spark, path).select("record.id").collect()
    ids = sorted(r.id for r in rows)
    assert ids == sorted(["2309.00543", "2104.00001", "2104.00002", "2104.00003", "2309.00543", "math/0309136"])


def test_index_projection(spark, snap):
    path, _ = snap
    rows = {(r.base_id, r.title): r for r in snapshot.index_rows(snapshot.scan_snapshot(spark, path)).collect()}
    g = rows[("2309.00543", "Good title")]
    assert g.created == dt.date(2023, 9, 1)
    assert g.categories == "cs.LG stat.ML"
    assert rows[("2104.00001", "no versions")].created is None          # P4: empty versions -> NULL
    assert rows[("2104.00002", "bad date")].created is None             # P1: unreadable -> NULL
    assert rows[("2104.00002", "bad date")].categories == ""            # P3: missing -> ''
    assert rows[("2104.00003", "offset date")].created == dt.date(2007, 4, 2)   # its own zone
    assert rows[("math/0309136", "old id, no categories")].abstract == ""


def test_first_and_last_wins(spark, snap):
    path, d = snap
    compact = str(d / "compact")
    snapshot.build_compact_index(spark, path, compact, overwrite=True)
    first = {r.base_id: r.title for r in snapshot.load_compact(spark, compact).collect()}
    assert first["2309.00543"] == "Good title"
    assert "abstract" not in snapshot.load_compact(spark, compact).columns
    idx = str(d / "index")
    snapshot.build_index(spark, path, idx, overwrite=True)
    assert spark.read.parquet(idx).where("base_id = '2309.00543'").count() == 2   # duplicates kept
    last = {r.base_id: r.title for r in snapshot.load_index(spark, idx, ["title"]).collect()}
    assert last["2309.00543"] == "Duplicate later title"
    firsts = {r.base_id: r.title for r in snapshot.load_index(spark, idx, ["title"], dedup="first").collect()}
    assert firsts["2309.00543"] == "Good title"


def test_build_is_skipped_when_present(spark, snap):
    path, d = snap
    idx = str(d / "index2")
    snapshot.build_index(spark, path, idx, overwrite=True)
    n = spark.read.parquet(idx).count()
    snapshot.build_index(spark, path + "_missing_is_not_read", idx, overwrite=False)
    assert spark.read.parquet(idx).count() == n


def test_unknown_column_raises(spark, snap):
    _, d = snap
    with pytest.raises(ValueError):
        snapshot.load_index(spark, str(d / "index"), ["offsetz"])


def test_sorted_layout(spark, snap):
    path, d = snap
    idx = str(d / "index_sorted")
    snapshot.build_index(spark, path, idx, overwrite=True, layout="sorted", partitions=2)
    assert spark.read.parquet(idx).count() == 6


def test_first_wins_across_splits(spark, tmp_path):
    # many small splits: the position struct orders lines across tasks
    p = tmp_path / "big.json"
    recs = [json.dumps({"id": f"k{i % 50}", "title": f"t{i}"}) for i in range(5000)]
    p.write_text("\n".join(recs) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = snapshot.index_rows(snapshot.scan_snapshot(spark, str(p)), with_metadata=False)
        from quire.operators.dedup import dedup_by_key
        first = {r.base_id: r.title for r in dedup_by_key(rows, "base_id", "_pos", "first").collect()}
        last = {r.base_id: r.title for r in dedup_by_key(rows, "base_id", "_pos", "last").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == {f"k{k}": f"t{k}" for k in range(50)}
    assert last == {f"k{k}": f"t{4950 + k}" for k in range(50)}
