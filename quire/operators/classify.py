"""Linear category classifiers and their evaluation (M4-M8).

One-vs-rest fits go through :mod:`.linear`: all classes share one scan of the
training table per iteration, smooth losses by L-BFGS and the others by the
stochastic solver. ``solver="ml"`` fits a ``pyspark.ml`` estimator per class
instead (log loss and hinge); the multinomial strategy is ``pyspark.ml``'s.
The data never moves to the driver; only the coefficients do (k x dim doubles).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear, metrics

# Smallest stored size per partition of a table that a fit scans once per
# iteration: below it the per-task overhead of every iteration dominates.
TRAIN_PARTITION_BYTES = 32 * 1024 * 1024

# --- fixed values: the reference's two classifier settings ------------------
# ablation study: loss 'log', tol 1e-6, max_iter 50, alpha 1e-7
ABLATION_PARAMS = dict(loss="log_loss", tol=1e-6, max_iter=50, alpha=1e-7, fit_intercept=True)
# summary classifier: loss 'log_loss', max_iter 1000, no intercept (default alpha 1e-4)
SUMMARY_PARAMS = dict(loss="log_loss", tol=1e-3, max_iter=1000, alpha=1e-4, fit_intercept=False)
# ---------------------------------------------------------------------------


@dataclass
class ClassifierSpec:
    loss: str = "log_loss"
    tol: float = 1e-6
    max_iter: int = 50
    alpha: float = 1e-4
    fit_intercept: bool = True
    strategy: str = "ovr"          # "ovr" (one-vs-rest, as the reference) or "multinomial"
    parallelism: int = 4           # binary fits run concurrently in one-vs-rest (solver "ml")
    solver: str = "auto"           # "block" (L-BFGS), "sgd" (any loss), "ml", or "auto": block for smooth losses, else sgd
    seed: int = 1234               # deals out the rows of the stochastic solver

    def one_vs_rest_solver(self) -> str:
        if self.solver not in ("auto", "block", "sgd", "ml"):
            raise ValueError(f"solver {self.solver!r} is not 'auto', 'block', 'sgd' or 'ml'")
        return self.solver if self.solver != "auto" else "block" if linear.LOSSES[linear.loss_name(self.loss)][2] else "sgd"


def binary_estimator(spec: ClassifierSpec, features: str = "features", label: str = "code"):
    """M4 / M8: the per-class ``pyspark.ml`` estimator for a loss name."""
    if spec.loss in ("log_loss", "log"):
        return LogisticRegression(featuresCol=features, labelCol=label, regParam=spec.alpha,
                                  elasticNetParam=0.0, maxIter=spec.max_iter, tol=spec.tol,
                                  fitIntercept=spec.fit_intercept, standardization=False,
                                  family="binomial")
    if spec.loss == "hinge":
        return LinearSVC(featuresCol=features, labelCol=label, regParam=spec.alpha,
                         maxIter=spec.max_iter, tol=spec.tol, fitIntercept=spec.fit_intercept,
                         standardization=False)
    raise ValueError(f"pyspark.ml has no estimator for the loss {spec.loss!r}; use 'log_loss' or 'hinge', or another solver")


def to_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """array<double|float> -> ML vector, JVM-side."""
    return df.withColumn(out, array_to_vector(F.transform(F.col(array_col), lambda x: x.cast("double"))))


def fit(train: DataFrame, spec: ClassifierSpec, features: str = "features", label: str = "code"):
    """M4: fit on a table with an ML-vector ``features`` column and 0..k-1 ``label`` codes."""
    if spec.strategy == "multinomial":
        if spec.loss not in ("log_loss", "log"):
            raise ValueError("multinomial strategy needs log_loss")
        est = LogisticRegression(featuresCol=features, labelCol=label, regParam=spec.alpha,
                                 maxIter=spec.max_iter, tol=spec.tol, fitIntercept=spec.fit_intercept,
                                 standardization=False, family="multinomial")
        return est.fit(train)
    solver = spec.one_vs_rest_solver()
    if solver != "ml":
        x, y = vector_to_array(features), F.col(label)
        if solver == "sgd":
            keyed = train.withColumn("_key", F.monotonically_increasing_id())
            return linear.fit_sgd(keyed, F.col("_key"), x, y, [spec.loss], spec.alpha, spec.tol, spec.max_iter, spec.fit_intercept,
                                  seed=spec.seed, name=features)[linear.loss_name(spec.loss)]
        return linear.fit_block(linear.training_rows(train, x, y), spec.loss, spec.alpha, spec.tol, spec.max_iter, spec.fit_intercept,
                                features=features)["all"]
    ovr = OneVsRest(classifier=binary_estimator(spec, features, label), featuresCol=features,
                    labelCol=label, parallelism=spec.parallelism)
    return ovr.fit(train)


def predict_proba(model, df: DataFrame, spec: ClassifierSpec) -> DataFrame:
    """M5: adds ``prediction`` and ``probs`` (array<double>). One-vs-rest has no
    probability column: probs = sigmoid(margin) normalised to sum 1."""
    out = model.transform(df)
    if spec.strategy == "multinomial":
        return out.withColumn("probs", vector_to_array("probability"))
    return out.withColumn("probs", metrics.ovr_probability(vector_to_array("rawPrediction")))


def train_test(train: DataFrame, test: DataFrame, spec: ClassifierSpec, label: str = "code",
               features: str = "features") -> DataFrame:
    """M6: fit on ``train``, score ``test``; one row ``top1, top3, top5,
    loglikelihood, perplexity, n, n_unseen``. A test class that has no training
    row (also one whose code lies between those of training classes) gets
    probability 0, is in no top n, and is counted in ``n_unseen``."""
    codes = [r[0] for r in train.select(F.col(label).cast("bigint")).distinct().collect()]   # one row per class
    model = fit(train, spec, features, label)
    return score(predict_proba(model, test, spec), codes, label)


def score(scored: DataFrame, codes: list[int], label: str = "code", by: tuple[str, ...] = ()) -> DataFrame:
    """M6's row (one per ``by``) from ``probs`` of a fit on the classes ``codes``."""
    seen = F.array(*[F.lit(c).cast("bigint") for c in sorted(codes)])
    scored = scored.withColumn("probs", metrics.mask_unseen("probs", seen))
    unseen = F.sum((~metrics.is_label("probs", label, seen)).cast("long")).alias("n_unseen")
    return metrics.score_table(scored, "probs", label, extra=[unseen], seen=seen, by=by)
