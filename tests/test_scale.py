"""Scale helpers (stored stages, size-checked broadcast, salted joins), plans without row shuffles, the
encoder's single evaluation, RFC 4180 CSV and adjacency round trips, hinge loss."""

import pytest
from pyspark.sql import functions as F

from quire.operators import classify, cocitation, dedup, encode, lookup, ordering
from quire.session import is_complete, materialize, path_exists, staged_path, store, stored_bytes, stored_stages
from quire.sources import files, snapshot


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_and_materialize(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id"))
    with stored_stages(spark) as outer:
        kept = materialize(df)
        with stored_stages(spark) as run:
            stored, nbytes = store(df.repartition(6))
            assert nbytes > 0 and stored.count() == 1000
            small = materialize(df.repartition(6), min_partition_bytes=1 << 30)
            assert small.rdd.getNumPartitions() == 1     # coalesced by stored size
            assert sorted(r.id for r in small.collect()) == list(range(1000))
            paths = list(run)
            assert len(paths) == 2 and all(path_exists(spark, p) for p in paths)
        assert not any(path_exists(spark, p) for p in paths)
        assert kept.count() == 1000                      # another run's stages are not touched
        assert len(outer) == 1
    assert not path_exists(spark, outer[0])


def test_staged_paths_never_meet(spark):
    assert staged_path(spark, "x") != staged_path(spark, "x")


def test_unfinished_index_is_built_again(spark, tmp_path):
    src = tmp_path / "s-1.json"
    src.write_text('{"id": "1", "title": "a"}\n')
    dest = tmp_path / "idx"
    (dest / "_temporary").mkdir(parents=True)
    (dest / "part-00000.parquet").write_bytes(b"cut off")
    assert not is_complete(spark, str(dest))
    snapshot.build_index(spark, str(src), str(dest))
    assert spark.read.parquet(str(dest)).count() == 1 and is_complete(spark, str(dest))
    assert stored_bytes(spark, str(tmp_path / "s-*.json")) == src.stat().st_size


def test_files_in_natural_order(spark):
    names = ["part-100000", "part-99999", "snap-10/x", "snap-2/x", "a1b2c10", "a1b2c9"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(snapshot.natural_order(F.col("n"))).collect()]
    assert got == ["a1b2c9", "a1b2c10", "part-99999", "part-100000", "snap-2/x", "snap-10/x"]


def test_splits_do_not_shuffle_the_rows(spark):
    df = spark.createDataFrame([(k, "abcde"[k % 5], "text " * 20) for k in range(2000)], "k long, y string, t string")
    one = _plan(ordering.positional_split(df, "k", 1600))
    assert "Exchange" not in one and "Window" not in one
    strat = _plan(ordering.stratified_split(df, "k", "y"))
    assert "Window" not in strat and "hashpartitioning" not in strat and "BroadcastHashJoin" in strat


def test_encoders_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a b a"), (1, "c"), (2, None)], "k long, t string")
    w = encode.hashed_term_weights(df, "k", "t", 16)
    assert "Exchange" not in _plan(w)
    assert sorted((r.k, r.tf) for r in w.collect()) == [(1, 1), (1, 1), (1, 2)]      # each row for itself
    with pytest.raises(ValueError):
        encode.token_bucket(F.lit("x"), 1 << 32)
    big = df.select(encode.token_bucket(F.lit("x"), 1 << 30).alias("b")).first().b
    assert big > 65536


def test_widen_takes_the_width_from_the_data(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None)], "k long, v array<double>")
    assert encode.widen(df, "v", keep=["k"]).columns == ["k", "v_0", "v_1", "v_2"]
    assert [tuple(r) for r in encode.widen(df, "v", 3, keep=["k"]).orderBy("k").collect()] == [(1, 1.0, 2.0, 3.0), (2, None, None, None)]
    with pytest.raises(Exception, match="not 2"):
        encode.widen(df, "v", 2, keep=["k"]).collect()
    with pytest.raises(ValueError):
        encode.widen(df.unionByName(spark.createDataFrame([(3, [1.0])], "k long, v array<double>")), "v")


def test_page_of_any_depth(spark):
    rows = [(k * 7919 % 5000, k) for k in range(3000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for start, n in ((0, 10), (5, 10), (2995, 10), (1234, 1), (0, None), (2990, None), (5000, 3)):
        got = [tuple(r) for r in ordering.page(df, ["a", "b"], start, n).collect()]
        assert got == want[start:None if n is None else start + n]
    assert ordering.page(df.limit(0), ["a"], 3, 2).count() == 0


def test_dedup_moves_wide_rows_once(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z"), (None, 1, "n"), (None, None, "m")], "k string, o int, t string")
    for keep, want in (("first", {"a": "x", "b": "z", None: "m"}), ("last", {"a": "y", "b": "z", None: "n"})):
        got = dedup.dedup_by_key(df, "k", "o", keep)
        assert got.columns == df.columns and {r.k: r.t for r in got.collect()} == want
    plan = dedup.dedup_by_key(df, "k", "o")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_cocitation_with_two_hot_keys(spark):
    """Two citing papers hold nearly all edges; the salted join gives what the broadcast one gives."""
    edges = [("s%d" % (k % 2), "p%d" % (k % 301)) for k in range(3000)] + [("t", "p1"), ("t", "p2")]
    e = spark.createDataFrame(edges, "src string, dst string")
    tr = spark.createDataFrame([("p%d" % k, "c%d" % (k % 4)) for k in range(250)], "id string, cat string")

    def result(**more):
        return sorted((r.paper, r.cat, r.cnt) for r in cocitation.cocitation_counts(e, tr, **more).collect())

    assert result() == result(max_broadcast_rows=0)


def test_small_side_bounds(spark):
    keys = spark.range(50).withColumnRenamed("id", "k")
    big = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                                "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")                   # only an explicit hint may broadcast
        yes = big.join(lookup.small_side(keys), "k")
        assert "BroadcastHashJoin" in _plan(yes) and yes.count() == 500
        no_rows = big.join(lookup.small_side(keys, max_rows=10), "k")
        assert "BroadcastHashJoin" not in _plan(no_rows) and no_rows.count() == 500
        no_bytes = big.join(lookup.small_side(keys, max_bytes=1), "k")
        assert "BroadcastHashJoin" not in _plan(no_bytes) and no_bytes.count() == 500
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_encoder_runs_once_before_explode(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "doc_id long, text string")
    v = docs.select("doc_id", encode.hashed_embedding("text", 16).alias("v"))
    x = v.select("doc_id", F.posexplode("v").alias("bucket", "w")).where("w > 0")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = {(r.doc_id, r.bucket): r.w for r in x.collect()}
    assert {k[0] for k in got} == {1}
    assert sum(w * w for w in got.values()) == pytest.approx(1.0)


def test_corpus_csv_round_trip(spark, tmp_path):
    rows = [("1", 'He said "hi", twice', "line 1\nline 2\r\nline 3", "A, B", "cs.LG"),
            ("2", "", "", None, "math.AG"),
            ("3", "comma, in title", 'ends with quote"', "C", "q-fin")]
    df = spark.createDataFrame(rows, "id string, title string, abstract string, authors string, categories string")
    path = files.write_corpus_csv(df, str(tmp_path / "c"))
    back = {r.id: r for r in files.read_corpus(spark, path, fmt="csv").collect()}
    for r in rows:
        got = back[r[0]]
        assert (got.title or "", got.abstract or "", got.authors, got.categories) == \
            (r[1], r[2], r[3], r[4])


def test_adjacency_lines(spark, tmp_path):
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "x")], "src string, dst string")
    path = files.write_citation_lines(edges, str(tmp_path / "adj"))
    got = sorted((r.src, r.dst) for r in files.read_citation_edges(spark, path).collect())
    assert got == [("a", "x"), ("a", "y"), ("b", "x")]


def test_adjacency_objects(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LIST_LENGTH", 3)
    want = {("a", f"x{k}") for k in range(20)} | {('q"uo\\te', "x"), ("é", "a/1")} | {(f"s{k}", "y") for k in range(50)}
    edges = spark.createDataFrame(sorted(want), "src string, dst string")
    path = files.write_citation_objects(edges, str(tmp_path / "obj"), partitions=2)
    import json
    for f in (tmp_path / "obj").glob("part-*"):
        json.loads(f.read_text())                        # each file is one object
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", old):                         # many tiny splits, then whole files
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert {(r.src, r.dst) for r in files.read_citation_edges(spark, path).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_json_documents(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t {k}") for k in range(10)], "id long, title string").repartition(3)
    path = files.write_json_documents(df, str(tmp_path / "j"))
    back = files.read_json_document(spark, path, "id long, title string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_embedding_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0], [2.0], [3.0], "x")], "k long, title_emb array<double>, summary_emb array<double>, authors_emb array<double>, more string")
    path = files.write_embeddings(df, str(tmp_path / "e"), key="k")
    assert files.read_embeddings(spark, path).columns == ["id", "title_emb", "summary_emb", "authors_emb"]
    assert files.read_embeddings(spark, path, columns=["title_emb"]).columns == ["id", "title_emb"]
    with pytest.raises(ValueError):
        files.read_embeddings(spark, path, key="doc")


def test_hinge_loss_classifier(spark):
    rows = [(i, [float(i % 3 == c) + 0.01 * i for c in range(3)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, f array<double>, code long")
    x = classify.to_vector(df, "f")
    spec = classify.ClassifierSpec(loss="hinge", max_iter=50, alpha=1e-4)
    model = classify.fit(x, spec)
    scored = classify.predict_proba(model, x, spec)
    acc = scored.select(F.avg((F.col("prediction") == F.col("code")).cast("double"))).first()[0]
    assert acc >= 0.95
    with pytest.raises(ValueError):
        classify.binary_estimator(classify.ClassifierSpec(loss="huber"))


def test_positions_are_reduced_as_numbers(spark):
    """A struct position (file, block, row) orders rows as its number does, and no aggregate sorts."""
    rows = [(f"k{i % 7}", (f"part-{i % 3:05d}", (i * 37) % 5 * 100, i), f"t{i}") for i in range(200)] + [(None, ("part-1", 0, 3), "n"), (None, (None, None, 9), "o")]
    df = spark.createDataFrame(rows, "k string, pos struct<file: string, block: long, row: long>, t string").repartition(6)
    order = lambda p: tuple((x is not None, x) for x in p)
    for keep, pick in (("first", min), ("last", max)):
        want = {k: pick((order(p), t) for kk, p, t in rows[:200] if kk == k)[1] for k in {r[0] for r in rows[:200]}}
        got = dedup.dedup_by_key(df.where("k is not null"), "k", "pos", keep)
        assert got.columns == df.columns and {r.k: r.t for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert {r.t for r in dedup.dedup_by_key(df.where("k is null"), "k", "pos", "first").collect()} == {"o"}
    plan = dedup.dedup_by_key(df.select("k", "t", df.pos.row.alias("o")), "k", "o")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
