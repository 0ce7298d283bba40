"""Queries of the operators over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classlm, conversations, decontaminate, licenses, minhash, packing, pseudonyms, quality, simhash, tokenfile, topk, warc, whitening
from .common import fold, read

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 4, 2)
    feats, model = quality.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held)
    return quality.score(feats, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.protect(read(spark, sf_dir, "documents").select("doc_id", "text"), pseudonyms.DEMO_KEY, counts=True)
    return found.select("doc_id", "text", *[F.col(f"pii.{k}").alias(f"n_{k}") for k in pseudonyms.KINDS])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    file, bounds = topk.build_file(read(spark, sf_dir, "embeddings"), scale=256)
    return topk.search(file, bounds, F.col("vec_id") % 50 == 0, k=5)


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return tokenfile.read(spark, folder)


def op7_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7, 2)
    model, vocabulary = classlm.train(docs.where(~held))
    found = classlm.score(docs, model, vocabulary)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                        "perplexity")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(read(spark, sf_dir, "pages"))
    return warc.read(spark, folder).drop("url")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = minhash.near_duplicates(docs, minhash.fingerprints(docs))
    return found.select("doc_id", "n_chars", *[F.lower(F.hex(c)).alias(n) for c, n in (
        ("edited_sha256", "edited_sha256"), ("fp", "fingerprint"), ("edited_fp", "edited_fingerprint"))],
        "near_edited", "near_next", "component_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_decontaminate, op3_pseudonyms, op4_packing, op5_topk, op6_tokenfile,
                            op7_classlm, op8_simhash, op9_licenses, op10_warc, op11_minhash,
                            op12_whitening, op13_conversations)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Queries that learn a model, hash with XXH64, or depend on a tokenizer's
#: file have no SQL form; they are tested against brute force.
ORACLE: dict[str, str] = {
    "op2_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_LOWER)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, k, k + least(len(w), 13) - 1), ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT r, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
f AS (SELECT dw.r, dw.k, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g),
h AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT r, k, unnest(range(0, n)) AS j FROM f) GROUP BY r),
i AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)""",
    "op5_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
q AS (SELECT DISTINCT vec_id AS query_id, v AS q FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, CAST(list_inner_product(q, v) AS BIGINT) AS score FROM q JOIN v ON vec_id <> query_id AND len(v) = len(q)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 5""",
    "op9_licenses": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS t, {_WORDS.format(_LOWER)} AS w FROM documents),
p AS (SELECT unnest([{", ".join(_text(k) for k in licenses.PHRASES)}]) AS phrase, unnest([{", ".join(map(_text, licenses.PHRASES.values()))}]) AS label),
a AS (SELECT r, k - 1 AS place, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d), p
      WHERE array_to_string(list_slice(w, k, k + len(string_split(phrase, ' ')) - 1), ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM a GROUP BY r),
m AS (SELECT row_number() OVER () AS k, list_distinct(t) AS t, len(t) AS m, label FROM (SELECT {_WORDS.format("lower(template)")} AS t, label
      FROM (SELECT unnest([{", ".join(map(_text, licenses.TEMPLATES))}]) AS template, unnest([{", ".join(map(_text, licenses.TEMPLATES.values()))}]) AS label))),
x AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
h AS (SELECT r, k, pos, word FROM x JOIN (SELECT k, unnest(t) AS word FROM m) USING (word)),
e AS (SELECT r, k FROM h JOIN m USING (k) GROUP BY r, k HAVING count(DISTINCT word) >= {licenses.CONTAINMENT} * len(any_value(t))),
v AS (SELECT r, k, a.pos, count(DISTINCT b.word) AS n FROM h a JOIN e USING (r, k) JOIN m USING (k) JOIN h b USING (r, k)
      WHERE b.pos >= a.pos AND b.pos < a.pos + m GROUP BY r, k, a.pos),
f AS (SELECT r, label, CAST(max(n) AS DOUBLE) / len(any_value(t)) AS c FROM v JOIN m USING (k) GROUP BY r, k, label
      HAVING max(n) >= {licenses.CONTAINMENT} * len(any_value(t))),
best AS (SELECT r, max(c) AS c FROM f GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT r, label FROM a) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM a UNION SELECT r, label FROM f) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(c, CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r)""",
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
x AS (SELECT page_id, CAST(octet_length(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
y AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM x)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM y""",
}
