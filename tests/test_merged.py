"""The bucketed index against a dictionary: merges, stopped merges, versions, replays."""

import json

import pytest

from quire.sources import merged
from quire.streaming import ingest


def drop(folder, name, rows):
    """Write {"id", "title"} records as a snapshot folder."""
    p = folder / name
    p.mkdir()
    (p / "part-0.json").write_text("".join(json.dumps({"id": k, "title": t, "categories": "cs.LG"}) + "\n" for k, t in rows) + "{bad\n")
    return str(p)


def titles(df):
    rows = df.select("base_id", "title").collect()
    assert len({r.base_id for r in rows}) == len(rows)    # one row per id
    return {r.base_id: r.title for r in rows}


def test_merges_equal_a_dictionary_and_reads_need_no_dedup(spark, tmp_path):
    root, want = str(tmp_path / "index"), {}
    drops = [[(f"p{k}", f"a{k}") for k in range(200)] + [("hot", f"a{k}") for k in range(100)],
             [("p3", "b"), ("new", "b"), ("p3", "c")],
             [],
             [("hot", "d"), ("p3", "d"), ("", "no id")]]
    kept = {}
    for n, rows in enumerate(drops, 1):
        src = drop(tmp_path, f"drop{n}", rows)
        assert (merged.create(spark, src, root, buckets=16) if n == 1 else merged.merge(spark, src, root)) == n
        want.update({k: t for k, t in rows if k})
        assert titles(merged.read(spark, root)) == want
        kept[n] = dict(want)
    assert merged.versions(spark, root) == [1, 2, 3, 4]
    for n, rows in kept.items():                          # older versions stay as they were
        assert titles(merged.read(spark, root, n)) == rows
    plan = merged.read(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and "Join" not in plan
    one, two, last = (merged.manifest(spark, root, n)["folders"] for n in (1, 2, 4))
    assert len(one) == 16 and 1 <= sum(one[b] != two[b] for b in one) <= 2      # only the buckets of p3 and new
    assert sum(one[b] == last[b] for b in one) >= 13


def test_lookup_reads_the_buckets_of_the_ids(spark, tmp_path):
    root = str(tmp_path / "index")
    merged.create(spark, drop(tmp_path, "a", [(f"p{k}", f"a{k}") for k in range(300)]), root, buckets=32)
    ids = spark.createDataFrame([("p7",), ("p7",), ("none",), (None,)], "base_id string")
    got = merged.lookup(spark, root, ids)
    assert titles(got) == {"p7": "a7"} and len(got.inputFiles()) <= 3    # two buckets and the ids
    assert merged.lookup(spark, root, ids.limit(0)).count() == 0


def test_a_stopped_merge_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    merged.create(spark, drop(tmp_path, "a", [("x", "1"), ("y", "1")]), root, buckets=4)
    src = drop(tmp_path, "b", [("x", "2")])

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as mp:
        mp.setattr(merged, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            merged.merge(spark, src, root)
    assert merged.versions(spark, root) == [1] and titles(merged.read(spark, root)) == {"x": "1", "y": "1"}
    assert merged.merge(spark, src, root) == 2
    assert titles(merged.read(spark, root)) == {"x": "2", "y": "1"}
    old = merged.manifest(spark, root, 1)
    with pytest.raises(RuntimeError, match="another merge"):             # a version is published once
        merged._publish(spark, root, old)
    with pytest.raises(ValueError, match="merge into it"):
        merged.create(spark, src, root)
    with pytest.raises(ValueError, match="no index"):
        merged.read(spark, str(tmp_path / "none"))


def test_empty_snapshot(spark, tmp_path):
    root = str(tmp_path / "index")
    merged.create(spark, drop(tmp_path, "a", []), root)
    assert titles(merged.read(spark, root)) == {}
    merged.merge(spark, drop(tmp_path, "b", [("x", "1")]), root)
    assert titles(merged.read(spark, root)) == {"x": "1"}


def test_stream_of_drops_counts_each_batch_once(spark, tmp_path):
    root, inbox, cp = str(tmp_path / "index"), tmp_path / "in", str(tmp_path / "cp")
    inbox.mkdir()

    def put(name, rows):
        (inbox / name).write_text("".join(json.dumps({"id": k, "title": t}) + "\n" for k, t in rows))
        ingest.start_merged_ingest(spark, str(inbox), root, cp, buckets=4).awaitTermination()

    put("a.json", [("x", "1"), ("y", "1"), ("x", "2")])
    assert titles(merged.read(spark, root)) == {"x": "2", "y": "1"}
    put("b.json", [("y", "3"), ("z", "3")])
    assert titles(merged.read(spark, root)) == {"x": "2", "y": "3", "z": "3"}
    assert merged.versions(spark, root) == [1, 2]
    replay = merged.read(spark, root)                     # a batch that was merged is passed over
    assert merged.merge_rows(replay, root, batch=1) == 2 and merged.versions(spark, root) == [1, 2]
