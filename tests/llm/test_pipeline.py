"""The pipeline against a brute-force version of its stages, and its registration."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from quire.llm import pseudonyms, quality, queries
from quire.llm.common import fold
from tests.llm.test_fingerprints import hits, plain_components, plain_fingerprint
from tests.llm.test_tokens import check_pack


def test_stages_by_brute_force(spark, sf_middle):
    docs = spark.read.parquet(f"{sf_middle}/documents.parquet")
    labels = spark.read.parquet(f"{sf_middle}/labels.parquet")
    _, model = quality.train(docs, labels, ~fold(F.col("doc_id"), 4, 2))
    import numpy as np
    rows = docs.collect()
    good = [r for r in rows if model.score(np.array([quality.statistics((r.text or "").encode())]))[0] >= 0.7]
    group, least = plain_components([plain_fingerprint(r.text) for r in good]), {}
    for r, g in zip(good, group, strict=True):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    kept = [r for r in good if r.doc_id in set(least.values())]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_middle}/benchmark.parquet").select("item_id", "text").collect()]
    found = hits([(r.doc_id, r.text) for r in kept], bench)
    clean = [r for r, (n, h, _) in zip(kept, found, strict=True) if not (h and 20 * h >= n)]
    cycle = pseudonyms.Cycle(pseudonyms.DEMO_KEY)
    texts = {r.doc_id: [pseudonyms.pseudonymise(r.text, cycle)[0]] for r in clean}
    assert len(rows) > len(good) > len(kept) > len(clean)
    got = corpus_pipeline.run(spark, sf_middle).collect()
    assert {r.doc_id for r in got} == set(texts)
    check_pack(got, texts, Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE)), 1024)


def test_stages_keep_columns_and_pass_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    odd = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(9999).cast("long")).withColumn("text", F.lit("")))
    docs = docs.withColumns({c: F.lit("x") for c in ("x", "fp", "score", "component_id", "row_hash", "_row", "n_hit", "pii")})
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == docs.columns
            now = corpus_pipeline.store(out, "test")
            assert now.count() <= table.count()
        n = Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, sf).collect())
        assert set(n) == {r.doc_id for r in now.collect()}


def test_registration():
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "personal_data",
                                                     "best_fit_packing"]
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {f"op{n}_" for n in range(1, 11)} <= {k[:k.index("_") + 1] for k in q if k.startswith("op")} and "pipeline" in q
    assert set(queries.ORACLE) <= set(sql) and set(sql) <= set(q)
