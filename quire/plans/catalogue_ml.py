"""Registered queries: embeddings, co-citation, metrics, confusion tables, classifier (M*, J3-J5, A5-A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cocitation, encode, lookup, lsa, metrics, ordering
from ..sources.tables import table
from . import standins as si
from ..session import materialize
from .registry import register

HASH_DIM = 256
_TOKENS_SQL = f"list_filter(string_split_regex(text, '{text.PY_SPACE}+'), lambda x: x <> '')"

HASH_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS_SQL}) AS tok FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {HASH_DIM} AS INTEGER) AS bucket FROM t),
c AS (SELECT doc_id, bucket, count(*) AS tf FROM b GROUP BY doc_id, bucket)
SELECT doc_id, bucket, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS weight FROM c"""


@register("hash_embed", HASH_SQL)
def hash_embed(spark, d):
    docs = table(spark, d, "documents")
    w = encode.hashed_term_weights(docs, "doc_id", "text", HASH_DIM)
    return w.select("doc_id", "bucket", "tf", F.round("weight", 6).alias("weight"))


@register("hash_embed_dense", """
SELECT doc_id, bucket, weight FROM ({})""".format(HASH_SQL))
def hash_embed_dense(spark, d):
    docs = table(spark, d, "documents")
    v = docs.select("doc_id", encode.hashed_embedding("text", HASH_DIM).alias("v"))
    x = v.select("doc_id", F.posexplode("v").alias("bucket", "weight")).where(F.col("weight") > 0)
    return x.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


_LSA_DIM = 1024


@register("lsa_frequencies", f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS_SQL}) AS tok FROM documents),
b AS (SELECT DISTINCT doc_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {_LSA_DIM} AS INTEGER) AS bucket FROM t)
SELECT bucket, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1, 9) AS idf FROM b GROUP BY bucket""")
def lsa_frequencies(spark, d):
    """M1, learned encoder: document frequencies of the hashed tokens."""
    f = lsa.document_frequencies(table(spark, d, "documents"), "text", _LSA_DIM)
    return f.withColumn("idf", F.round("idf", 9))


@register("lsa_embed")
def lsa_embed(spark, d):
    """M1: every whole document in the learned encoder's 32 dimensions (no SQL form: a singular value decomposition)."""
    docs = table(spark, d, "documents")
    encoder = lsa.fit(docs, "text", _LSA_DIM, rank=32)
    return docs.select("doc_id", encoder("text").alias("embedding"))


_WIDE = 64                                   # the width of the driver's table; the query takes it from the data


@register("embed_wide", "SELECT vec_id, " + ", ".join(
    f"embedding[{i + 1}] AS embedding_{i}" for i in range(_WIDE)) + " FROM embeddings")
def embed_wide(spark, d):
    e = table(spark, d, "embeddings")
    return encode.widen(e, "embedding", keep=["vec_id"])


@register("vector_shape", """
SELECT count(*) AS rows, max(len(embedding)) AS dim FROM embeddings""")
def vector_shape(spark, d):
    return metrics.vector_shape(table(spark, d, "embeddings"), "embedding")


@register("vector_head", """
SELECT vec_id, len(embedding) AS size,
       array_to_string(list_transform(embedding[1:3], lambda x: format('{:.6f}', CAST(x AS DOUBLE))), ', ') AS head
FROM embeddings""")
def vector_head(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", text.vector_size("embedding").alias("size"),
                    text.vector_head("embedding", 3, 6).alias("head"))


@register("zero_fill", """
SELECT d.doc_id, len(coalesce(e.embedding, list_transform(range((SELECT max(len(embedding)) FROM embeddings)), lambda i: CAST(0 AS FLOAT)))) AS dim,
       round(coalesce(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 0), 4) AS total
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def zero_fill(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    z = lookup.zero_fill(docs, emb, "doc_id", "embedding")
    tot = F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return z.select("doc_id", F.size("embedding").cast("bigint").alias("dim"), F.round(tot, 4).alias("total"))


@register("feature_concat", f"""
WITH h AS ({HASH_SQL.replace(f'round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6)', 'tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id))')}),
hs AS (SELECT doc_id, sum(weight) AS s FROM h GROUP BY doc_id)
SELECT e.vec_id AS doc_id, len(e.embedding) + {HASH_DIM} AS dim,
       round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) + coalesce(hs.s, 0), 4) AS total
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN hs ON hs.doc_id = d.doc_id""")
def feature_concat(spark, d):
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, d, "documents").select("doc_id", "text")
    # join first: the encoder runs only on documents that have a vector block
    j = lookup.align(emb, docs, "doc_id").withColumn("h", encode.hashed_embedding("text", HASH_DIM))
    f = encode.concat_features("embedding", "h")
    tot = F.aggregate(f, F.lit(0.0), lambda a, x: a + x)
    return j.select("doc_id", F.size(f).cast("bigint").alias("dim"), F.round(tot, 4).alias("total"))


# --------------------------------------------------------------------------
# Co-citation features (lineitem = citation edges, part.p_type = category,
# training papers = the first 80% of the seeded hash space)
# --------------------------------------------------------------------------
TRAIN_HASH_BOUND = "cc"


def _train_parts(spark, d):
    p = table(spark, d, "part")
    h = ordering.seeded_hash("p_partkey", 14850)
    return p.where(h < TRAIN_HASH_BOUND).select(F.col("p_partkey").cast("string").alias("id"),
                                               F.col("p_type").alias("cat"))


@register("cocitation_features", f"""
WITH e AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem),
tr AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS cat FROM part
       WHERE md5('14850:' || CAST(p_partkey AS VARCHAR)) < '{TRAIN_HASH_BOUND}'),
x AS (SELECT a.dst AS paper, tr.cat, count(*) AS cnt
      FROM e a JOIN e b ON b.src = a.src AND b.dst <> a.dst JOIN tr ON tr.id = b.dst GROUP BY a.dst, tr.cat)
SELECT paper, cat, cnt, round(cnt / sum(cnt) OVER (PARTITION BY paper), 6) AS share
FROM x""")
def cocitation_features(spark, d):
    c = cocitation.cocitation_counts(si.citation_edges(spark, d), _train_parts(spark, d))
    return c.select("paper", "cat", "cnt", F.round("share", 6).alias("share"))


# --------------------------------------------------------------------------
# Ten scores from the whole vector (the sum of the values whose
# index leaves 0 .. 9 modulo 10), softmax of them, truth = label
# --------------------------------------------------------------------------
_TENTHS_SQL = """
WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT vec_id, label, CAST(j % 10 AS INTEGER) AS i, sum(x) AS x FROM v GROUP BY vec_id, label, j % 10)"""
_SCORES_SQL = _TENTHS_SQL + """,
m AS (SELECT vec_id, label, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM s),
p AS (SELECT vec_id, label, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM m),
t AS (SELECT vec_id, p AS pt FROM p WHERE i = label),
r AS (SELECT p.vec_id, p.label, t.pt,
             CAST(count(*) FILTER (WHERE p.p > t.pt OR (p.p = t.pt AND p.i > p.label)) AS BIGINT) AS ahead
      FROM p JOIN t USING (vec_id) GROUP BY p.vec_id, p.label, t.pt)"""


def tenths(vec):
    """Ten scores from all values of a vector."""
    def total(k):
        return F.aggregate(F.filter(vec, lambda x, j: F.pmod(j, F.lit(10)) == k), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(9)), total)


def _scored(spark, d):
    e = table(spark, d, "embeddings")
    e = e.select("vec_id", "label", tenths("embedding").alias("s"))            # a column of its own: made once per row
    return e.select("vec_id", "label", metrics.softmax("s").alias("probs"))


@register("top_n", _SCORES_SQL + """
SELECT vec_id, label, ahead, ahead < 3 AS in_top3 FROM r""")
def top_n(spark, d):
    s = _scored(spark, d)
    ahead = metrics.labels_ahead("probs", "label")
    return s.select("vec_id", "label", ahead.cast("bigint").alias("ahead"),
                    metrics.in_top_n("probs", "label", 3).alias("in_top3"))


@register("top_n_unseen", _SCORES_SQL + """,
u AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN label + 10 WHEN 1 THEN NULL WHEN 2 THEN 4 ELSE label END AS given, label FROM embeddings),
k AS (SELECT vec_id, label, i, CASE WHEN i = 4 THEN 0 ELSE p END AS p FROM p),
g AS (SELECT k.vec_id, count(*) FILTER (WHERE k.p > t.p OR (k.p = t.p AND k.i > t.i)) AS ahead
      FROM k JOIN k t ON t.vec_id = k.vec_id AND t.i = t.label GROUP BY k.vec_id)
SELECT u.vec_id, u.given, coalesce(u.given BETWEEN 0 AND 9 AND u.given <> 4, false) AS is_label,
       coalesce(u.given BETWEEN 0 AND 9 AND u.given <> 4 AND g.ahead < 3, false) AS in_top3,
       coalesce(u.given BETWEEN 0 AND 9 AND u.given <> 4, false) AS in_top10
FROM u LEFT JOIN g USING (vec_id)""")
def top_n_unseen(spark, d):
    """A6 with labels the probabilities are not for: out of range, NULL, and a
    class (4) in the middle that no training row had. None is in any top n."""
    k = F.pmod(F.col("vec_id"), F.lit(4))
    given = F.when(k == 0, F.col("label") + 10).when(k == 1, F.lit(None)).when(k == 2, 4).otherwise(F.col("label"))
    seen = F.array(*[F.lit(c).cast("bigint") for c in range(10) if c != 4])
    s = _scored(spark, d).select("vec_id", given.cast("int").alias("given"), metrics.mask_unseen("probs", seen).alias("probs"))
    return s.select("vec_id", "given", metrics.is_label("probs", "given", seen).alias("is_label"),
                    metrics.in_top_n("probs", "given", 3, seen).alias("in_top3"),
                    metrics.in_top_n("probs", "given", 10, seen).alias("in_top10"))


@register("top_labels", _TENTHS_SQL + """,
k AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) AS rk FROM s)
SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY rk) AS best3 FROM k WHERE rk <= 3 GROUP BY vec_id""")
def top_labels(spark, d):
    s = _scored(spark, d)
    best = ordering.top_labels("probs", 3)
    return s.select("vec_id", F.array_join(F.transform(best, lambda i: i.cast("string")), ",").alias("best3"))


@register("train_test_metrics", _SCORES_SQL + """
SELECT round(avg(CAST(ahead < 1 AS DOUBLE)), 6) AS top1, round(avg(CAST(ahead < 3 AS DOUBLE)), 6) AS top3,
       round(avg(CAST(ahead < 5 AS DOUBLE)), 6) AS top5, round(sum(ln(pt)), 6) AS loglikelihood,
       count(*) AS n, round(exp(-sum(ln(pt)) / count(*)), 6) AS perplexity FROM r""")
def train_test_metrics(spark, d):
    m = metrics.score_table(_scored(spark, d), "probs", "label")
    return m.select(*[F.round(c, 6).alias(c) for c in ("top1", "top3", "top5", "loglikelihood")],
                    "n", F.round("perplexity", 6).alias("perplexity"))


@register("ovr_proba", _TENTHS_SQL + """,
g AS (SELECT vec_id, i, x, 1.0 / (1.0 + exp(-x)) AS sg FROM s),
o AS (SELECT vec_id, i, sg, sum(sg) OVER (PARTITION BY vec_id) AS total,
             row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rk FROM g)
SELECT vec_id, i AS best, round(sg / total, 6) AS p_best, i AS best_raw FROM o WHERE rk = 1""")
def ovr_proba(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", tenths("embedding").alias("raw"))
    p = e.select("vec_id", "raw", metrics.ovr_probability("raw").alias("p"))
    return p.select("vec_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("best"),
                    F.round(F.array_max("p"), 6).alias("p_best"),
                    (F.array_position("raw", F.array_max("raw")) - 1).cast("int").alias("best_raw"))


# --------------------------------------------------------------------------
# Confusion tables, prediction = the largest of the ten scores
# --------------------------------------------------------------------------
_PRED_SQL = _TENTHS_SQL + """,
x AS (SELECT vec_id, label AS actual, i AS predicted FROM s
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s.x DESC, i) = 1)"""


def _pair_counts(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("actual"), tenths("embedding").alias("s"))
    return metrics.pair_counts(e.select("actual", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("predicted")),
                               "actual", "predicted")


@register("confusion_cube", _PRED_SQL + """
SELECT CASE WHEN grouping(a) = 1 THEN 'All' ELSE a END AS actual,
       CASE WHEN grouping(p) = 1 THEN 'All' ELSE p END AS predicted, count(*) AS cnt
FROM (SELECT CAST(actual AS VARCHAR) AS a, CAST(predicted AS VARCHAR) AS p FROM x)
GROUP BY CUBE (a, p)""")
def confusion_cube(spark, d):
    return metrics.confusion_cube(_pair_counts(spark, d))


_DENSE_SQL = _PRED_SQL + """,
l AS (SELECT actual AS l FROM x UNION SELECT predicted FROM x),
c AS (SELECT actual, predicted, count(*) AS cnt FROM x GROUP BY actual, predicted),
g AS (SELECT l AS actual, unnest((SELECT list(l ORDER BY l) FROM l)) AS predicted FROM l)
SELECT g.actual, g.predicted, coalesce(c.cnt, 0) AS cnt
FROM g LEFT JOIN c ON c.actual = g.actual AND c.predicted = g.predicted"""


@register("confusion_dense", _DENSE_SQL)
def confusion_dense(spark, d):
    return metrics.confusion_dense(_pair_counts(spark, d))


@register("confusion_pct", f"""
WITH dns AS ({_DENSE_SQL}),
r AS (SELECT *, sum(cnt) OVER (PARTITION BY actual) AS row_total FROM dns)
SELECT actual, predicted, cnt, CAST(row_total AS BIGINT) AS row_total,
       round(100.0::DOUBLE * cnt / row_total, 6) AS pct,
       CASE WHEN actual = predicted THEN format('{{:.1f}}%', 100.0::DOUBLE * cnt / row_total) || chr(10) || cnt || '/' || row_total
            WHEN cnt = 0 THEN ''
            ELSE format('{{:.1f}}%', 100.0::DOUBLE * cnt / row_total) || chr(10) || cnt END AS cell
FROM r""")
def confusion_pct(spark, d):
    p = metrics.confusion_percent(metrics.confusion_dense(_pair_counts(spark, d)))
    return p.withColumn("pct", F.round("pct", 6))


# --------------------------------------------------------------------------
# M4-M8: classifiers, fitted and scored on all rows. What a fit's numbers are
# is not SQL's to say; the queries return what it can say: test rows, unseen
# test rows, that top1 <= top3 <= top5, and that top1 beats always naming the
# largest class. pytest holds the accuracies against bounds.
# Stand-in corpus: documents, label = lang, "title" = source, "abstract" =
# whole text, co-citation = documents sharing a source (J5 with source as the
# citing side, training labels only).
# --------------------------------------------------------------------------
def doc_feature_table(prepared, dim: int = 64, blocks=("title_emb", "abstract_emb", "cocitation")):
    """Keyed feature table (``doc_id, lang, code, split`` + the requested
    blocks); only the requested encoders and the co-citation join are built.
    ``prepared``: stored documents with ``code`` and ``split``."""
    enc = {"title_emb": encode.hashed_embedding("source", dim),
           "abstract_emb": encode.hashed_embedding("text", dim)}
    feats = prepared.select("doc_id", "lang", "code", "split",
                            *[enc[b].alias(b) for b in blocks if b in enc])
    if "cocitation" not in blocks:
        return feats
    edges = prepared.select(F.col("source").alias("src"), F.col("doc_id").alias("dst"))
    train = prepared.where(F.col("split") == "train").select(F.col("doc_id").alias("id"),
                                                             F.col("lang").alias("cat"))
    counts = cocitation.cocitation_counts(edges, train)
    vecs = cocitation.cocitation_vectors(counts, prepared.select(F.col("lang").alias("cat")))
    vecs = vecs.select(F.col("paper").cast("bigint").alias("doc_id"), "cocitation")
    n_cats = prepared.select("lang").distinct()
    k = n_cats.agg(F.count(F.lit(1)).cast("int")).scalar()
    zeros = F.array_repeat(F.lit(0.0), k)
    return (feats.join(vecs, on="doc_id", how="left")
            .withColumn("cocitation", F.coalesce(F.col("cocitation"), zeros)))


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "text")


def _checks(scores, test, label: str = "code"):
    """n, n_unseen, ordered, beats_majority from a row of M6 scores."""
    largest = test.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n") / F.sum("n")).first()[0]
    return scores.select(*[c for c in scores.columns if c == "feature_set"], "n", "n_unseen",
                         ((F.col("top1") <= F.col("top3")) & (F.col("top3") <= F.col("top5"))).alias("ordered"),
                         (F.col("top1") > F.lit(largest)).alias("beats_majority"))


def ovr_scores(spark, d, spec=None):
    """(M6 scores, test rows): E2's split (F11, M3, T2), one-vs-rest on the hashed texts."""
    from ..operators import classify
    from . import ablation
    prepared = ablation.prepare(_documents(spark, d), "doc_id", "lang")
    t = materialize(doc_feature_table(prepared, blocks=("abstract_emb",)), "features",
                    min_partition_bytes=classify.TRAIN_PARTITION_BYTES)
    x = classify.to_vector(t, "abstract_emb")
    test = x.where(F.col("split") == "test")
    spec = spec or classify.ClassifierSpec(**classify.SUMMARY_PARAMS)
    return classify.train_test(x.where(F.col("split") == "train"), test, spec), test


_T2_TEST_SQL = """
WITH c AS (SELECT lang, count(*) AS n_class FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 2),
t AS (SELECT sum(n_class) AS n_all FROM c),
q AS (SELECT lang, n_class, n_all, n_all - CAST(ceil(n_all * 0.2::DOUBLE) AS BIGINT) AS ntrain FROM c, t),
f AS (SELECT lang, n_class, ntrain, (n_class * ntrain) // n_all AS fl, (n_class * ntrain) % n_all AS rem FROM q),
s AS (SELECT *, ntrain - sum(fl) OVER () AS short, row_number() OVER (ORDER BY rem DESC, lang) AS rk FROM f),
test AS (SELECT lang, n_class - fl - CASE WHEN rk <= short THEN 1 ELSE 0 END AS n FROM s)"""
_OVR_SQL = _T2_TEST_SQL + """
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_unseen, true AS ordered, true AS beats_majority FROM test"""


@register("train_ovr", _OVR_SQL)
def train_ovr(spark, d):
    return _checks(*ovr_scores(spark, d))


@register("train_hinge", _OVR_SQL)
def train_hinge(spark, d):
    """M8: the hinge loss in place of the log loss."""
    from ..operators import classify
    return _checks(*ovr_scores(spark, d, classify.ClassifierSpec(loss="hinge", max_iter=50, alpha=1e-4)))


def ablation_scores(spark, d, feature_sets=None):
    """(one row of M6 scores per feature set, test rows): E3 with the
    positional split of the seeded order, every class, and no rare-class filter."""
    from ..operators import classify
    from . import ablation
    prepared = materialize(ablation.prepare_positional(_documents(spark, d), "doc_id", "lang"), "prepared")
    spec = classify.ClassifierSpec(**classify.ABLATION_PARAMS)
    scores = ablation.run_ablation(doc_feature_table(prepared), feature_sets or ablation.FEATURE_SETS, spec)
    return scores, prepared.where(F.col("split") == "test")


@register("ablation", """
WITH d AS (SELECT lang, row_number() OVER (ORDER BY md5('14850:' || CAST(doc_id AS VARCHAR)), doc_id) AS pos, count(*) OVER () AS n_all
           FROM documents WHERE lang IS NOT NULL),
te AS (SELECT lang FROM d WHERE pos > n_all * 4 // 5), tr AS (SELECT DISTINCT lang FROM d WHERE pos <= n_all * 4 // 5)
SELECT unnest(['titles', 'abstracts', 'all', 'all - titles', 'all - abstracts']) AS feature_set, n, n_unseen, true AS ordered,
       unnest([NULL, true, true, true, NULL]) AS beats_majority
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE lang NOT IN (SELECT lang FROM tr)) AS n_unseen FROM te)""")
def ablation_q(spark, d):
    checks = _checks(*ablation_scores(spark, d))
    # a source name or the labels around it say nothing certain about a language
    return checks.withColumn("beats_majority", F.when(~F.col("feature_set").isin("titles", "all - abstracts"),
                                                      F.col("beats_majority")))


@register("summary_confusion", _T2_TEST_SQL + """
SELECT lang AS actual, CAST(n AS BIGINT) AS row_total, CAST((SELECT count(*) FROM test) AS BIGINT) AS cells,
       true AS sums_up, true AS mostly_right FROM test""")
def summary_confusion(spark, d):
    """The confusion table's rows; the test rows per class are T2's."""
    p = confusion_table(spark, d)
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("cnt")).otherwise(0))
    return p.groupBy("actual").agg(
        F.max("row_total").alias("row_total"), F.count(F.lit(1)).alias("cells"),
        (F.sum("cnt") == F.max("row_total")).alias("sums_up"), (right * 2 > F.max("row_total")).alias("mostly_right"))


def confusion_table(spark, d):
    from .summary import run_summary
    corpus = table(spark, d, "documents").select(
        "doc_id", "text", F.concat(F.col("lang"), F.lit("."), F.col("source"), F.lit(" x.y")).alias("categories"))
    return run_summary(corpus, "doc_id", "text", "categories", encoder=lambda c: encode.hashed_embedding(c, 128))["percent"]


# --------------------------------------------------------------------------
# M4/M8: the stochastic solver with each loss. Shards, mini-batches and their
# order follow from the hash of the key, so SQL can take the same steps: two
# epochs of three mini-batches in two shards, ten classes at once.
# --------------------------------------------------------------------------
_SGD = dict(shards=2, batches=3, epochs=2, eta0=0.05, alpha=1e-3, seed=1234)
_SLOPES_SQL = {
    "hinge": "CASE WHEN 1 - y * p > 0 THEN -y ELSE 0 END",
    "log_loss": "-y / (1 + exp(y * p))",
    "modified_huber": "CASE WHEN y * p >= -1 THEN -2 * y * greatest(1 - y * p, 0) ELSE -4 * y END",
    "squared_hinge": "-2 * y * greatest(1 - y * p, 0)",
    "perceptron": "CASE WHEN y * p <= 0 THEN -y ELSE 0 END",
    "squared_error": "p - y",
    "huber": "greatest(least(p - y, 0.1::DOUBLE), -0.1::DOUBLE)",
    "epsilon_insensitive": "CASE WHEN abs(p - y) > 0.1::DOUBLE THEN sign(p - y) ELSE 0 END",
    "squared_epsilon_insensitive": "2 * sign(p - y) * greatest(abs(p - y) - 0.1::DOUBLE, 0)",
}


def _sgd_sql(loss: str) -> str:
    """CTEs that end with ``w``: code, j (the intercept is the last one), v."""
    shards, batches, epochs, eta0, alpha, seed = _SGD.values()
    out = f"""
WITH e AS (SELECT vec_id, label, CAST(('0x' || substr(md5('{seed}:' || vec_id), 1, 8)) AS BIGINT) % {shards} AS shard,
                  CAST(('0x' || substr(md5('{seed}:' || vec_id), 9, 8)) AS BIGINT) % {batches} AS batch, embedding,
                  (SELECT max(len(embedding)) FROM embeddings) AS d FROM embeddings),
r AS MATERIALIZED (SELECT vec_id, label, shard, batch, d, unnest(range(0, d + 1)) AS j,
                          CAST(unnest(list_append(embedding, 1)) AS DOUBLE) AS x FROM e),
n AS (SELECT shard, count(*) AS n FROM e GROUP BY shard), m AS (SELECT shard, batch, count(*) AS m FROM e GROUP BY ALL),
w0 AS MATERIALIZED (SELECT shard, code, j, 0::DOUBLE AS v FROM n, (SELECT DISTINCT label AS code FROM e), (SELECT DISTINCT j FROM r))"""
    k = 0
    for epoch in range(epochs):
        for b in range(batches):
            eta = f"({eta0}::DOUBLE / sqrt(1 + {epoch * batches + b}::DOUBLE / {batches}))"
            out += f""",
p{k} AS (SELECT vec_id, r.shard, code, CASE WHEN any_value(label) = code THEN 1::DOUBLE ELSE -1::DOUBLE END AS y, sum(x * v) AS p
         FROM r JOIN w{k} w ON w.shard = r.shard AND w.j = r.j WHERE batch = {b} GROUP BY vec_id, r.shard, code),
g{k} AS (SELECT r.shard, code, j, sum(x * s) / any_value(m) AS g, any_value(d) AS d
         FROM r JOIN (SELECT vec_id, shard, code, {_SLOPES_SQL[loss]} AS s FROM p{k}) USING (vec_id, shard) JOIN m USING (shard, batch)
         WHERE batch = {b} GROUP BY r.shard, code, j),
w{k + 1} AS MATERIALIZED (SELECT shard, code, j, coalesce(v - {eta} * (g + CASE WHEN j < d THEN {alpha}::DOUBLE * v ELSE 0 END), v) AS v
         FROM w{k} LEFT JOIN g{k} USING (shard, code, j))"""
            k += 1
        out += f""",
a{epoch} AS MATERIALIZED (SELECT code, j, sum(v * n) / sum(n) AS v FROM w{k} JOIN n USING (shard) GROUP BY code, j),
w{k + 1} AS MATERIALIZED (SELECT shard, code, j, v FROM a{epoch}, n)"""
        k += 1
    return out + f""",
w AS (SELECT code, j, v FROM a{epochs - 1})"""


def _sgd_model(spark, d, loss):
    from ..operators import linear
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    models = linear.fit_sgd(e, F.col("vec_id"), F.col("x"), F.col("label"), [loss], alpha=_SGD["alpha"], max_iter=_SGD["epochs"],
                            shards=_SGD["shards"], batches=_SGD["batches"], eta0=_SGD["eta0"], seed=_SGD["seed"])
    return e, models[loss]


def _register_sgd(loss):
    @register(f"sgd_{loss}", _sgd_sql(loss) + """
SELECT CAST(code AS INTEGER) AS code, CAST(j AS INTEGER) AS feature, round(v, 8) AS weight FROM w""")
    def sgd_loss(spark, d):
        m = _sgd_model(spark, d, loss)[1]
        rows = [(c, j, float(v)) for c, w, b in zip(m.codes, m.weights, m.intercepts, strict=True) for j, v in enumerate([*w, b])]
        return spark.createDataFrame(rows, "code int, feature int, weight double").withColumn("weight", F.round("weight", 8))


for _loss in _SLOPES_SQL:
    _register_sgd(_loss)


@register("sgd_scores", _sgd_sql("log_loss") + """,
s AS (SELECT vec_id, any_value(label) AS label, code AS i, 1 / (1 + exp(-sum(x * v))) AS g FROM r JOIN w USING (j) GROUP BY vec_id, code),
q AS (SELECT vec_id, label, i, g / sum(g) OVER (PARTITION BY vec_id) AS p FROM s),
t AS (SELECT vec_id, p AS pt FROM q WHERE i = label),
k AS (SELECT q.vec_id, t.pt, count(*) FILTER (WHERE q.p > t.pt OR (q.p = t.pt AND q.i > q.label)) AS ahead FROM q JOIN t USING (vec_id) GROUP BY q.vec_id, t.pt)
SELECT round(avg(CAST(ahead < 1 AS DOUBLE)), 6) AS top1, round(avg(CAST(ahead < 3 AS DOUBLE)), 6) AS top3,
       round(avg(CAST(ahead < 5 AS DOUBLE)), 6) AS top5, round(sum(ln(pt)), 4) AS loglikelihood, count(*) AS n FROM k""")
def sgd_scores(spark, d):
    """M6 for the fixed-seed fit: its scores on all rows, not only bounds of them."""
    from ..operators import classify
    e, m = _sgd_model(spark, d, "log_loss")
    scored = e.select(F.col("label").alias("code"), m.scores(F.col("x")).alias("raw"))
    s = classify.score(scored.withColumn("probs", metrics.ovr_probability("raw")), m.codes)
    return s.select(*[F.round(c, 6).alias(c) for c in ("top1", "top3", "top5")], F.round("loglikelihood", 4).alias("loglikelihood"), "n")
