"""Preprocessing and model queries.

Fitted statistics (medians, mode, scaling, one-hot slots, the baseline's
majority class) are oracle-checked; trained models are checked by
invariants in the tests. Model queries use small default settings so the
whole registry stays quick; settings are arguments of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators import models as MD
from leakscope.operators import preprocess as PP
from leakscope.operators.features import FEATURE_SETS, checkpoint_with_lineage
from leakscope.operators.split import split_table
from leakscope.plans.q_ingest import cleaned_derived
from leakscope.plans.q_metrics import SPLIT_CTES
from leakscope.plans.registry import normalise, query
from leakscope.plans.sql_base import with_flat
from leakscope.session import input_state, run_table, written

FS_KEY = "leakage_aware"

# small default settings for the registered model queries
QUICK = {
    "logistic_regression": {"C": 1.0, "max_iter": 30},
    "random_forest": {"n_estimators": 20, "max_depth": 6, "min_samples_leaf": 2, "max_features": "sqrt"},
    "xgboost": {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0,
                "colsample_bytree": 1.0},
}


def modelling_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean derived rows with is_test and fold: built once per run and
    input, written, reused by every model query."""
    def build():
        d = cleaned_derived(spark, sf_dir).drop("_ordinal")
        sp = split_table(d.select(C.ID, C.TARGET))
        # a merge join leaves the rows in the order of their ids, on which a forest's samples depend
        return checkpoint_with_lineage(d.join(sp.drop(C.TARGET).hint("merge"), C.ID, "inner"))
    return run_table(spark, ("modelling_frame", *input_state(spark, sf_dir)), build)


def train_rows(mf: DataFrame) -> DataFrame:
    return mf.filter(~F.col("is_test"))


def test_rows(mf: DataFrame) -> DataFrame:
    return mf.filter(F.col("is_test"))


_TRN = """
, trn AS (SELECT d.* FROM derived d JOIN sp ON d.neo_id = sp.neo_id WHERE NOT sp.is_test),
tst AS (SELECT d.* FROM derived d JOIN sp ON d.neo_id = sp.neo_id WHERE sp.is_test)
"""


def with_train(body: str) -> str:
    return with_flat(SPLIT_CTES + _TRN + body)


_NUM = FEATURE_SETS[FS_KEY].numeric_features


# --- M1 ---------------------------------------------------------------------------
@query("impute_median", with_train("SELECT feature, ROUND(median, 6) AS median FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, median(CAST({f} AS DOUBLE)) AS median FROM trn" for f in _NUM) + ")"))
def q_impute_median(spark, sf_dir):
    tr = train_rows(modelling_frame(spark, sf_dir))
    med = PP.fit_medians(tr, _NUM)
    return normalise(spark.createDataFrame(list(med.items()), "feature STRING, median DOUBLE"))


# --- M2 ---------------------------------------------------------------------------
@query("impute_mode", with_train("""
SELECT 'orbit_class_type' AS feature, orbit_class_type AS mode, CAST(count(*) AS BIGINT) AS n
FROM trn WHERE orbit_class_type IS NOT NULL GROUP BY orbit_class_type
ORDER BY count(*) DESC, orbit_class_type ASC LIMIT 1
"""))
def q_impute_mode(spark, sf_dir):
    tr = train_rows(modelling_frame(spark, sf_dir))
    return PP.mode_table(tr, "orbit_class_type").select(
        F.lit("orbit_class_type").alias("feature"), F.col("orbit_class_type").alias("mode"),
        F.col("n").cast("bigint"))


# --- M3 ---------------------------------------------------------------------------
@query("standard_scale", with_train(", med AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, median(CAST({f} AS DOUBLE)) AS m FROM trn" for f in _NUM) + "), st AS (" +
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg(COALESCE(CAST({f} AS DOUBLE), (SELECT m FROM med WHERE feature = '{f}'))) AS mean,"
        f" stddev_pop(COALESCE(CAST({f} AS DOUBLE), (SELECT m FROM med WHERE feature = '{f}'))) AS sd FROM trn"
        for f in _NUM) + """)
SELECT feature, ROUND(mean, 6) AS mean, ROUND(CASE WHEN sd = 0 OR sd IS NULL THEN 1.0 ELSE sd END, 6) AS scale FROM st
"""))
def q_standard_scale(spark, sf_dir):
    tr = train_rows(modelling_frame(spark, sf_dir))
    med = PP.fit_medians(tr, _NUM)
    means, scales = PP.fit_scaler(PP.impute(tr.select(*_NUM), med, {}), _NUM)
    return normalise(spark.createDataFrame([(f, means[f], scales[f]) for f in _NUM],
                                           "feature STRING, mean DOUBLE, scale DOUBLE"))


# --- M4 ---------------------------------------------------------------------------
@query("one_hot", with_train("""
, md AS (SELECT orbit_class_type AS m FROM trn WHERE orbit_class_type IS NOT NULL GROUP BY orbit_class_type
         ORDER BY count(*) DESC, orbit_class_type ASC LIMIT 1),
cats AS (SELECT DISTINCT COALESCE(orbit_class_type, (SELECT m FROM md)) AS category FROM trn)
SELECT t.neo_id, c.category,
       CASE WHEN COALESCE(t.orbit_class_type, (SELECT m FROM md)) = c.category THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS value
FROM tst t, cats c
"""))
def q_one_hot(spark, sf_dir):
    mf = modelling_frame(spark, sf_dir)
    tr, te = train_rows(mf), test_rows(mf)
    modes = PP.fit_modes(tr, ["orbit_class_type"])
    cats = PP.fit_categories(PP.impute(tr.select("orbit_class_type"), {}, modes), ["orbit_class_type"])
    v = F.coalesce(F.col("orbit_class_type"), F.lit(modes["orbit_class_type"]))
    slots = F.array(*[F.struct(F.lit(c).alias("category"), F.when(v == F.lit(c), 1.0).otherwise(0.0).alias("value"))
                      for c in cats["orbit_class_type"]])
    return te.select(C.ID, F.explode(slots).alias("s")).select(C.ID, "s.category", "s.value")


# --- M5 ---------------------------------------------------------------------------
@query("preprocess")
def q_preprocess(spark, sf_dir):
    """Rows-only: the fitted preprocessor applied to the holdout, one column
    per transformed feature."""
    mf = modelling_frame(spark, sf_dir)
    fs = FEATURE_SETS[FS_KEY]
    m = PP.AuditPreprocessor(numericCols=fs.numeric_features, categoricalCols=fs.categorical_features) \
        .fit(train_rows(mf))
    return normalise(m.transformed_columns(test_rows(mf).select(C.ID, *fs.feature_columns))
                     .select(C.ID, *[F.col(f"`{n}`") for n in m.feature_names()]))


# --- M6 ---------------------------------------------------------------------------
@query("dummy_baseline", with_train("""
, mj AS (SELECT CASE WHEN count(*) FILTER (WHERE is_potentially_hazardous_asteroid)
                          > count(*) FILTER (WHERE NOT is_potentially_hazardous_asteroid) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS m
         FROM trn)
SELECT neo_id, (SELECT m FROM mj) AS p, (SELECT m FROM mj) = 1.0 AS pred FROM tst
"""))
def q_dummy_baseline(spark, sf_dir):
    mf = modelling_frame(spark, sf_dir)
    model = MD.pipeline(FEATURE_SETS[FS_KEY], "dummy_most_frequent").fit(MD.training_frame(train_rows(mf)))
    return normalise(MD.scores(model.transform(test_rows(mf))).select(C.ID, "p", "pred"))


def _fit_predict(spark, sf_dir, model_name: str, fs_key: str = FS_KEY) -> DataFrame:
    mf = modelling_frame(spark, sf_dir)
    tr = MD.training_frame(train_rows(mf))
    model = MD.pipeline(FEATURE_SETS[fs_key], model_name, QUICK[model_name], n_weight_sum=tr.count(),
                        weighted=model_name != "xgboost").fit(tr)
    return normalise(MD.scores(model.transform(test_rows(mf))).select(
        C.ID, F.col(C.TARGET).alias("y"), "p", "pred"))


# --- M7 / M8 / M9 ------------------------------------------------------------------
@query("logistic")
def q_logistic(spark, sf_dir):
    return _fit_predict(spark, sf_dir, "logistic_regression")


@query("random_forest")
def q_random_forest(spark, sf_dir):
    return _fit_predict(spark, sf_dir, "random_forest")


@query("gbt")
def q_gbt(spark, sf_dir):
    return _fit_predict(spark, sf_dir, "xgboost")


# --- M10 / W6 ------------------------------------------------------------------------
def folds(spark, sf_dir):
    """The preprocessed folds of the leakage-aware set, made once per run and input."""
    from leakscope.plans.experiment import Folds, fits_at_once

    def build():
        mf = modelling_frame(spark, sf_dir)
        return Folds(mf, FEATURE_SETS[FS_KEY], parallel=fits_at_once(mf.count()))
    return run_table(spark, ("folds", *input_state(spark, sf_dir)), build)


def search_results(spark, sf_dir) -> DataFrame:
    return run_table(spark, ("search_results", *input_state(spark, sf_dir)), lambda: _search_results(spark, sf_dir))


def _search_results(spark, sf_dir) -> DataFrame:
    """The whole space of the logistic regression on shared, preprocessed folds."""
    from leakscope.plans.experiment import fits_at_once, tuned
    shared = folds(spark, sf_dir)
    settings = [{**s, "max_iter": 100} for s in MD.search_settings("logistic_regression")]
    _, best, rows, _ = tuned(shared, "logistic_regression", settings, parallel=fits_at_once(shared.n))
    return spark.createDataFrame(
        [(r["setting"], str(r["params"]), r["mean_test_score"], r["std_test_score"]) for r in rows],
        "setting INT, params STRING, mean_test_score DOUBLE, std_test_score DOUBLE")


def search_rank(results: DataFrame) -> DataFrame:
    """Rank by mean fold score, ties share the least rank (a window over
    at most n_iter rows)."""
    return results.withColumn("rank_test_score",
                              F.rank().over(Window.orderBy(F.col("mean_test_score").desc())).cast("bigint"))


@query("random_search")
def q_random_search(spark, sf_dir):
    return normalise(search_rank(search_results(spark, sf_dir)))


@query("search_rank")
def q_search_rank(spark, sf_dir):
    return normalise(search_rank(search_results(spark, sf_dir)).select("setting", "rank_test_score"))


# --- M11 ---------------------------------------------------------------------------
@query("oof_predictions")
def q_oof_predictions(spark, sf_dir):
    mf = modelling_frame(spark, sf_dir)
    return normalise(MD.oof_predictions(train_rows(mf), FEATURE_SETS[FS_KEY], "logistic_regression",
                                        QUICK["logistic_regression"]))


# --- M13 ---------------------------------------------------------------------------
@query("model_importance")
def q_model_importance(spark, sf_dir):
    mf = modelling_frame(spark, sf_dir)
    rows = []
    for name in ("logistic_regression", "random_forest"):
        tr = MD.training_frame(train_rows(mf))
        m = MD.pipeline(FEATURE_SETS[FS_KEY], name, QUICK[name], n_weight_sum=tr.count()).fit(tr)
        rows += [(name, f, v) for f, v in MD.model_importance(m)]
    return normalise(spark.createDataFrame(rows, "model STRING, feature STRING, importance DOUBLE"))


# --- M16 / A22 ---------------------------------------------------------------------
def anomaly_table(spark, sf_dir) -> DataFrame:
    """Unsupervised: the preprocessor and the forest are fitted on every
    clean row (the label is not used)."""
    def build():
        from leakscope.operators.outlier import isolation_forest
        d = cleaned_derived(spark, sf_dir).drop("_ordinal")
        prep = PP.AuditPreprocessor(numericCols=C.ALL_NUMERIC, categoricalCols=C.CATEGORICAL).fit(d)
        return written(isolation_forest(prep.transform(d), keep=[C.ID, "name"]))
    return run_table(spark, ("anomaly", *input_state(spark, sf_dir)), build)


@query("anomaly_scores")
def q_anomaly_scores(spark, sf_dir):
    return normalise(anomaly_table(spark, sf_dir))


@query("anomaly_summary")
def q_anomaly_summary(spark, sf_dir):
    a = anomaly_table(spark, sf_dir)
    return a.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"),
                 F.count_if("ml_flagged_outlier").cast("bigint").alias("flagged_outlier_count"))


# --- M14 / A17 ---------------------------------------------------------------------
def fitted(spark, sf_dir, model_name: str, fs_key: str = FS_KEY):
    def build():
        mf = modelling_frame(spark, sf_dir)
        tr = MD.training_frame(train_rows(mf))
        return MD.pipeline(FEATURE_SETS[fs_key], model_name, QUICK[model_name], n_weight_sum=tr.count(),
                           weighted=model_name != "xgboost").fit(tr)
    return run_table(spark, ("model", *input_state(spark, sf_dir), model_name, fs_key), build)


@query("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    from leakscope.operators.attribution import permutation_importance
    mf = modelling_frame(spark, sf_dir)
    fs = FEATURE_SETS[FS_KEY]
    m = fitted(spark, sf_dir, "random_forest")
    return normalise(permutation_importance(m, test_rows(mf), fs.feature_columns, n_repeats=20))


# --- M15 / A16 / L4 / R8 --------------------------------------------------------------
def attribution_table(spark, sf_dir) -> DataFrame:
    def build():
        from leakscope.operators.attribution import tree_attributions
        mf = modelling_frame(spark, sf_dir)
        m = fitted(spark, sf_dir, "random_forest")
        prep, rf = m.stages[0], m.stages[-1]
        feats = prep.transform(test_rows(mf))
        return written(tree_attributions(feats, rf, prep.feature_names()))
    return run_table(spark, ("attribution", *input_state(spark, sf_dir)), build)


@query("attribution_local")
def q_attribution_local(spark, sf_dir):
    from leakscope.operators.attribution import local_top
    names = fitted(spark, sf_dir, "random_forest").stages[0].feature_names()
    return normalise(local_top(attribution_table(spark, sf_dir), names, 5))


@query("attribution_global")
def q_attribution_global(spark, sf_dir):
    """A16 + R8: mean |attribution| per feature, transformer prefix stripped,
    largest first."""
    from leakscope.functions.scalar import strip_prefix
    from leakscope.operators.attribution import global_mean_abs
    names = fitted(spark, sf_dir, "random_forest").stages[0].feature_names()
    g = global_mean_abs(attribution_table(spark, sf_dir), names, "random_forest")
    return normalise(g.select("model", strip_prefix("feature").alias("feature"), "mean_abs_attribution")
                     .orderBy(F.col("mean_abs_attribution").desc()))


@query("attribution_check")
def q_attribution_check(spark, sf_dir):
    """Local accuracy per row: base + sum(contributions) - prediction."""
    a = attribution_table(spark, sf_dir)
    return normalise(a.select(C.ID, (F.col("base_value") + F.aggregate("contributions", F.lit(0.0),
                                                                         lambda acc, v: acc + v)
                                     - F.col("prediction")).alias("residual")))


@query("attribution_boosted")
def q_attribution_boosted(spark, sf_dir):
    """M15 for boosted trees: per holdout row the margin, the base value, and how
    far base + contributions is from the margin that the model itself gives."""
    from leakscope.operators.attribution import boosted_margin, tree_attributions
    m = fitted(spark, sf_dir, "xgboost")
    feats = m.stages[0].transform(test_rows(modelling_frame(spark, sf_dir)))
    own = m.stages[-1].transform(feats).select(F.col(C.ID).alias("own_id"), boosted_margin(m.stages[-1]).alias("margin"))
    a = tree_attributions(feats, m.stages[-1], m.stages[0].feature_names())
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda acc, v: acc + v)
    return normalise(a.join(own, a[C.ID] == own["own_id"]).select(C.ID, "margin", "base_value", (total - F.col("margin")).alias("residual")))
