"""Baseline, logistic regression, random forest, gradient-boosted
trees; seeded random search over a fold column; out-of-fold predictions;
model importances.

Every model is a ``Pipeline([AuditPreprocessor, classifier])`` so that
cross-validation refits the preprocessing on each training fold. Scores
are read back as ``p = probability[1]`` and ``pred = prediction == 1``.
"""

from __future__ import annotations

import itertools
import random

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators.features import FeatureSet
from leakscope.operators.preprocess import AuditPreprocessor

LABEL = "label"
WEIGHT = "weight"
# depth used for an unlimited tree ("None" in the search space); Spark's
# maximum is 30, and deep trees on large data are costly, so it is a knob
UNLIMITED_DEPTH = 16


class _DummyParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    majority = Param(Params._dummy(), "majority", "fitted majority class", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol=LABEL, majority=0.0)


class MostFrequentClassifier(Estimator, _DummyParams, DefaultParamsReadable, DefaultParamsWritable):
    """M6: predicts the majority training class with probability 0 or 1
    (ties go to the smaller class, as a most-frequent baseline does)."""

    @keyword_only
    def __init__(self, *, labelCol=LABEL):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MostFrequentModel":
        lab = self.getOrDefault(self.labelCol)
        row = df.agg(F.count_if(F.col(lab) == 1.0).alias("pos"), F.count_if(F.col(lab) == 0.0).alias("neg")).first()
        majority = 1.0 if (row["pos"] or 0) > (row["neg"] or 0) else 0.0
        return MostFrequentModel(labelCol=lab, majority=majority)


class MostFrequentModel(Model, _DummyParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, labelCol=LABEL, majority=0.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        m = self.getOrDefault(self.majority)
        from pyspark.ml.functions import array_to_vector
        prob = array_to_vector(F.array(F.lit(1.0 - m), F.lit(m)))
        return df.withColumn("probability", prob).withColumn("prediction", F.lit(m))


def classifier(model_name: str, params: dict | None = None, seed: int = C.SEED, weighted: bool = True):
    """Spark estimator for a model name and one setting of its search space
    (names as in the audited search spaces)."""
    p = params or {}
    if model_name == "dummy_most_frequent":
        return MostFrequentClassifier(labelCol=LABEL)
    if model_name == "logistic_regression":
        lr = LogisticRegression(labelCol=LABEL, featuresCol="features", maxIter=int(p.get("max_iter", 2000)),
                                standardization=False, elasticNetParam=0.0, family="binomial")
        if weighted:
            lr.setWeightCol(WEIGHT)
        # sklearn's C on a weighted sum of losses equals regParam = 1 / (C * sum(w));
        # with balanced weights sum(w) = n, set at fit time by ``with_reg``
        lr._leakscope_C = float(p.get("C", 1.0))
        return lr
    if model_name == "random_forest":
        depth = p.get("max_depth", None)
        mf = p.get("max_features", "sqrt")
        rf = RandomForestClassifier(
            labelCol=LABEL, featuresCol="features", seed=seed,
            numTrees=int(p.get("n_estimators", 100)),
            maxDepth=UNLIMITED_DEPTH if depth is None else int(depth),
            minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            featureSubsetStrategy={"sqrt": "sqrt", "log2": "log2", None: "all"}.get(mf, str(mf)),
            maxBins=64)
        if weighted:
            rf.setWeightCol(WEIGHT)
        return rf
    if model_name in ("xgboost", "gbt"):
        return GBTClassifier(
            labelCol=LABEL, featuresCol="features", seed=seed,
            maxIter=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 3)),
            stepSize=float(p.get("learning_rate", 0.1)), subsamplingRate=float(p.get("subsample", 1.0)),
            featureSubsetStrategy=str(float(p.get("colsample_bytree", 1.0))) if p.get("colsample_bytree", 1.0) < 1
            else "all", maxBins=64)
    raise KeyError(f"unknown model {model_name}")


def with_reg(est, n_weight_sum: float):
    if isinstance(est, LogisticRegression):
        c = getattr(est, "_leakscope_C", 1.0)
        est.setRegParam(1.0 / (c * max(n_weight_sum, 1.0)))
    return est


def preprocessor(fs: FeatureSet) -> AuditPreprocessor:
    return AuditPreprocessor(numericCols=list(fs.numeric_features), categoricalCols=list(fs.categorical_features))


def pipeline(fs: FeatureSet, model_name: str, params: dict | None = None, seed: int = C.SEED,
             n_weight_sum: float = 1.0, weighted: bool = True) -> Pipeline:
    prep = preprocessor(fs)
    est = with_reg(classifier(model_name, params, seed, weighted), n_weight_sum)
    return Pipeline(stages=[prep, est])


def class_sizes(t) -> list:
    """Aggregates: all rows, positives and negatives of a boolean label."""
    return [F.count(F.lit(1)).alias("n"), F.count_if(t).alias("pos"), F.count_if(~t).alias("neg")]


def training_frame(df: DataFrame, label: str = C.TARGET, sizes: tuple | None = None) -> DataFrame:
    """Double label and balanced weight n / (2 n_c) as columns; the weight
    table has two rows and is broadcast. ``sizes``: all rows, positives and negatives
    of ``df``, where they are known."""
    t = F.col(label)
    n, pos, neg = sizes or df.agg(*class_sizes(t)).first()
    w_pos = n / (2.0 * pos) if pos else 0.0
    w_neg = n / (2.0 * neg) if neg else 0.0
    return df.withColumn(LABEL, t.cast("double")).withColumn(
        WEIGHT, F.when(t, F.lit(w_pos)).otherwise(F.lit(w_neg)))


def scores(pred: DataFrame) -> DataFrame:
    """p = probability of the positive class, pred = prediction == 1."""
    return pred.withColumn("p", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction") == 1.0)


def search_settings(model_name: str, n_iter: int = C.N_ITER, seed: int = C.SEED,
                    space: dict | None = None) -> list[dict]:
    """``min(n_iter, |space|)`` distinct settings from a seeded shuffle
    of the full grid. A model without a space has one empty setting."""
    space = space if space is not None else C.SEARCH_SPACES.get(model_name)
    if not space:
        return [{}]
    keys = list(space)
    grid = [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]
    rng = random.Random(seed)
    rng.shuffle(grid)
    return grid[: min(n_iter, len(grid))]


def random_search(train: DataFrame, fs: FeatureSet, model_name: str, settings: list[dict], fold_col: str = "fold",
                  seed: int = C.SEED, weighted: bool = True):
    """Cross-validated F1 of the positive class for each setting, the whole
    pipeline, its class weights included, refitted per fold; refit of the best on
    all training rows. Returns (best PipelineModel, best settings, result rows).
    ``plans.experiment.tuned`` does the same on shared, preprocessed folds."""
    from leakscope.operators.metrics import confusion, metrics_from_counts
    results = []
    if len(settings) > 1:
        scored = None
        for i, s in enumerate(settings):
            part = oof_predictions(train, fs, model_name, s, fold_col, seed, weighted).withColumn("setting", F.lit(i))
            scored = part if scored is None else scored.unionByName(part)
        f1 = metrics_from_counts(confusion(scored, group_cols=["setting", fold_col])).groupBy("setting").agg(
            F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std")).orderBy("setting").collect()
        results = [{"setting": r["setting"], "params": settings[r["setting"]], "mean_test_score": r["mean"],
                    "std_test_score": r["std"]} for r in f1]
    best = max(results, key=lambda r: (r["mean_test_score"], -r["setting"]))["params"] if results else (settings or [{}])[0]
    tf = training_frame(train)
    return pipeline(fs, model_name, best, seed, tf.count(), weighted).fit(tf), best, results


def oof_predictions(train: DataFrame, fs: FeatureSet, model_name: str, params: dict, fold_col: str = "fold",
                    seed: int = C.SEED, weighted: bool = True, id_col: str = C.ID) -> DataFrame:
    """For each fold k, fit on folds != k and score fold k; union. Every
    training id is scored once, by a model that never saw it."""
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())
    parts = []
    for k in folds:
        tr = training_frame(train.filter(F.col(fold_col) != k))
        va = train.filter(F.col(fold_col) == k).withColumn(LABEL, F.col(C.TARGET).cast("double"))
        m = pipeline(fs, model_name, params, seed, tr.count(), weighted).fit(tr)
        parts.append(scores(m.transform(va)).select(id_col, fold_col, F.col(C.TARGET).alias("y"), "p", "pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_importance(model: PipelineModel) -> list[tuple[str, float]]:
    """Tree importances or coefficients by transformed feature name;
    empty for the baseline."""
    prep, est = model.stages[0], model.stages[-1]
    names = prep.feature_names()
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    elif hasattr(est, "coefficients"):
        vals = est.coefficients.toArray().tolist()
    else:
        return []
    return list(zip(names, [float(v) for v in vals]))
