"""Label normalisation -> split -> classifier -> metrics, per feature set."""

from __future__ import annotations

import datetime as _dt
import os
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, encode, linear, metrics, ordering
from ..session import materialize

# --- fixed values: the reference's ablation feature sets ---------------------
FEATURE_SETS = {
    "titles": ["title_emb"],
    "abstracts": ["abstract_emb"],
    "all": ["title_emb", "abstract_emb", "cocitation"],
    "all - titles": ["abstract_emb", "cocitation"],
    "all - abstracts": ["title_emb", "cocitation"],
}
# ---------------------------------------------------------------------------


def prepare(df: DataFrame, key: str, label_col: str, test_size: float = 0.2, seed: int = 42,
            min_count: int = 2) -> DataFrame:
    """Rows with a label whose class has at least ``min_count`` rows (F11),
    their label code (M3) and a stratified split (T2): adds ``code`` and
    ``split``. One counting pass and one ranking pass over the rows
    (see :func:`ordering.stratified_split`)."""
    labelled = df.where(F.col(label_col).isNotNull())
    return ordering.stratified_split(labelled, key, label_col, test_size=test_size, seed=seed,
                                     min_count=min_count, code_col="code")


def prepare_positional(df: DataFrame, key: str, label_col: str, train_share: tuple[int, int] = (4, 5),
                       seed: int = 14850) -> DataFrame:
    """Every row with a label, its code over all labels (M3), and the
    positional split (T1) of the seeded order: the first ``train_share`` of
    the rows train. No class is dropped, so a test class may be unseen."""
    labelled = df.where(F.col(label_col).isNotNull())
    size = labelled.count() * train_share[0] // train_share[1]
    return encode.encode_labels(ordering.positional_split(labelled, key, size, seed=seed), label_col)


def run_ablation(table: DataFrame, feature_sets: dict, spec: classify.ClassifierSpec,
                 label: str = "code", split_col: str = "split", binary_fits: int = 8) -> DataFrame:
    """M7: one metrics row per feature set.

    ``table`` holds one array column per feature block plus ``code`` and
    ``split``. It is stored once (a lost executor re-reads it instead of
    recomputing the encoders). With the block solver all classes of all sets
    are then fitted and scored together: a scan per iteration, and one of the
    test rows. With other solvers each set is a fit of its own; they are
    submitted from driver threads, as ``CrossValidator(parallelism=...)`` does,
    and ``binary_fits`` bounds the binary fits that run at once.
    """
    if spec.strategy == "ovr" and spec.one_vs_rest_solver() == "block":
        return _block_ablation(table, feature_sets, spec, label, split_col)
    base = materialize(table, "features", min_partition_bytes=classify.TRAIN_PARTITION_BYTES)

    def one(item):
        name, blocks = item
        feats = encode.concat_features(*blocks)
        x = classify.to_vector(base.withColumn("_f", feats), "_f")
        tr = x.where(F.col(split_col) == "train")
        te = x.where(F.col(split_col) == "test")
        return classify.train_test(tr, te, spec, label=label).select(F.lit(name).alias("feature_set"), "*")

    items = list(feature_sets.items())
    with ThreadPool(max(1, min(binary_fits // spec.parallelism, len(items)))) as pool:
        parts = pool.map(inheritable_thread_target(base.sparkSession)(one), items)
    rows = parts[0]
    for r in parts[1:]:
        rows = rows.unionByName(r)
    return rows


def _block_ablation(table: DataFrame, feature_sets: dict, spec: classify.ClassifierSpec, label: str, split_col: str) -> DataFrame:
    blocks = list(dict.fromkeys(b for s in feature_sets.values() for b in s))
    every = encode.concat_features(*blocks).alias("_x")
    base = materialize(table.select(*[F.size(b).alias(f"_n{k}") for k, b in enumerate(blocks)], every, F.col(label).alias("code"),
                                    F.col(split_col).alias("split")), "features", min_partition_bytes=classify.TRAIN_PARTITION_BYTES)
    sizes = base.agg(*[F.max(f"_n{k}") for k in range(len(blocks))]).first()
    ends = [sum(sizes[:k + 1]) for k in range(len(blocks))]
    at = {b: (e - n, e) for b, e, n in zip(blocks, ends, sizes, strict=True)}
    train = linear.training_rows(base.where("split = 'train'"), F.col("_x"), F.col("code"))
    models = linear.fit_block(train, spec.loss, spec.alpha, spec.tol, spec.max_iter, spec.fit_intercept,
                              sets={name: [at[b] for b in s] for name, s in feature_sets.items()})
    test = base.where("split = 'test'").select("code", *[m.scores(F.col("_x")).alias(f"_s{k}") for k, m in enumerate(models.values())])
    pairs = [F.struct(F.lit(name).alias("feature_set"), F.col(f"_s{k}").alias("raw")) for k, name in enumerate(models)]
    scored = test.select("code", F.inline(F.array(*pairs))).withColumn("probs", metrics.ovr_probability("raw"))
    return classify.score(scored, next(iter(models.values())).codes, by=("feature_set",))


def write_results(results: DataFrame, out_dir: str, date: str | None = None) -> str:
    """Results as JSON under ``logistic-regression-classification-<date>``."""
    date = date or _dt.date.today().isoformat()
    path = os.path.join(out_dir, f"logistic-regression-classification-{date}")
    results.coalesce(1).write.mode("overwrite").json(path)
    return path
