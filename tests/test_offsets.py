"""Byte offsets of snapshot lines against plain Python, and reads by place."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quire.sources import offsets


def record(key, title, pad=0):
    return json.dumps({"id": key, "title": title, "categories": "cs.LG", "abstract": "é" * pad}, ensure_ascii=False)


@pytest.fixture(scope="module")
def snap(tmp_path_factory):
    d = tmp_path_factory.mktemp("offsets")
    files = {}
    for n in (1, 2, 10):                                  # natural order: part-10 is the last
        lines = [record(f"p{n}-{k}", f"title {k} of {n}", pad=k * 7 % 50) for k in range(40)]
        lines[3:3] = ["{bad", "", json.dumps({"title": "no id"}), json.dumps({"id": ""}), record("long", f"long {n}", 5000)]
        lines += [record("hot", f"hot {n}.{k}") for k in range(30)]
        files[f"part-{n}.json"] = ("\r\n" if n == 2 else "\n").join(lines) + ("" if n == 10 else "\n")
    (d / "empty.json").write_text("")
    for name, text in files.items():
        (d / name).write_bytes(text.encode())
    return str(d), files


def plain(files):
    """id -> (title of its first record, title of its last record, bytes of the last line)"""
    out = {}
    for n in (1, 2, 10):
        for line in files[f"part-{n}.json"].encode().split(b"\n"):
            try:
                r = json.loads(line)
            except ValueError:
                continue
            if r.get("id"):
                first = out[r["id"]][0] if r["id"] in out else r["title"]
                out[r["id"]] = (first, r["title"], len(line))
    return out


@pytest.mark.parametrize("chunk", [100, 4096, 1 << 20])
def test_every_line_has_its_place_for_any_range_size(spark, snap, chunk):
    src, files = snap
    lines, table = offsets.scan_offsets(spark, src, chunk)
    paths = {r.file_no: r.path.split("/")[-1] for r in table.collect()}
    got = sorted((paths[r.place >> 40], r.place % (1 << 40), r.bytes, r.base_id) for r in lines.collect())
    want = []
    for name, text in files.items():
        at = 0
        for line in text.encode().split(b"\n"):
            try:
                key = json.loads(line).get("id")
            except ValueError:
                key = None
            if key:
                want.append((name, at, len(line), key))
            at += len(line) + 1
    assert got == sorted(want)


class _Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


@pytest.mark.parametrize("data", [b"", b"a", b"\n", b"a\n", b"\n\n\n", b"ab\ncde\n\nf", b"ab\ncde\n\nf\n", b"x" * 9 + b"\ny"])
@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 50])
def test_ranges_cover_every_line_once(data, chunk):
    got = []
    for begin in range(0, len(data), chunk):
        x, first, last = offsets._line_starts(_Bytes(data), begin, min(begin + chunk, len(data)), len(data))
        got += [x[a:b] for a, b in zip(first, last, strict=True)]
    want = data.split(b"\n")
    assert got == (want[:-1] if want[-1] == b"" else want)


def test_lookup_reads_only_the_lines_it_returns(spark, snap, tmp_path):
    src, files = snap
    where = offsets.build_offsets(spark, src, str(tmp_path / "dir"), chunk=900, buckets=8)
    want = plain(files)
    asked = ["hot", "long", "p1-0", "p2-39", "p10-7", "unknown", None, "hot"]
    ids = spark.createDataFrame([(x,) for x in asked], "base_id string")
    got = {r.base_id: r for r in offsets.lookup_offsets(spark, where, ids, with_bytes=True).collect()}
    assert set(got) == {"hot", "long", "p1-0", "p2-39", "p10-7"}
    assert {k: (r.title, r.bytes_read) for k, r in got.items()} == {k: want[k][1:] for k in got}
    size = sum(len(t.encode()) for t in files.values())
    assert sum(r.bytes_read for r in got.values()) < size / 2
    first = offsets.lookup_offsets(spark, where, ids, keep="first").collect()
    assert {r.base_id: r.title for r in first} == {k: want[k][0] for k in got}
    every = spark.createDataFrame([(x,) for x in want], "base_id string")
    assert {r.base_id: r.title for r in offsets.lookup_offsets(spark, where, every).collect()} == {k: v[1] for k, v in want.items()}
    one = offsets._places(spark, where, ids.where("base_id = 'p1-0'"), "last")
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", one._jdf.queryExecution().toString())
    assert offsets.lookup_offsets(spark, where, ids.limit(0)).count() == 0


def test_a_finished_directory_is_kept_and_a_changed_snapshot_raises(spark, tmp_path):
    src = tmp_path / "snap"
    src.mkdir()
    (src / "a.json").write_text(record("a", "one") + "\n" + record("b", "two") + "\n")
    where = offsets.build_offsets(spark, str(src), str(tmp_path / "dir"))
    (src / "a.json").write_text(record("b", "two") + "\n" + record("a", "one") + "\n")
    assert offsets.build_offsets(spark, str(src), where) == where
    ids = spark.createDataFrame([("a",)], "base_id string")
    with pytest.raises(Exception, match="changed after its directory"):
        offsets.lookup_offsets(spark, where, ids).collect()
    offsets.build_offsets(spark, str(src), where, overwrite=True)
    assert [r.title for r in offsets.lookup_offsets(spark, where, ids).collect()] == ["one"]


def test_compressed_and_empty_snapshots(spark, tmp_path):
    src = tmp_path / "gz"
    src.mkdir()
    (src / "a.json.gz").write_bytes(b"x")
    with pytest.raises(Exception, match="no byte offsets"):
        offsets.build_offsets(spark, str(src), str(tmp_path / "d1"))
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.json").write_text("")
    where = offsets.build_offsets(spark, str(empty), str(tmp_path / "d2"))
    assert offsets.lookup_offsets(spark, where, spark.range(3).select(F.col("id").cast("string").alias("base_id"))).count() == 0
