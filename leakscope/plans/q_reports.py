"""Artifact, registry and report queries (S7–S9, M17–M20, R1–R3, R6–R8,
A18, J3, J5, W7, L3, L8), and the label correlation extra (2.14).

The report queries read the artifact tables of a full grid on the analog,
built once per Spark application and input and written under the checkpoint
folder.
"""

from __future__ import annotations

import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.functions.scalar import strip_prefix
from leakscope.plans import experiment as EX
from leakscope.plans.q_ingest import cleaned_derived, q_clean_report, q_null_profile
from leakscope.plans.q_models import QUICK, anomaly_table, folds, modelling_frame
from leakscope.plans.q_metrics import PROFILE_FEATURES, split_scored, with_split
from leakscope.plans.registry import ORACLE, normalise, query, round_half_up
from leakscope.plans.sql_base import with_flat
from leakscope.session import input_state, run_table, scratch_path

# One combination is trained for the registered queries (the grid runs through
# experiment.run_all); the report queries read a full grid of fixed scores, which
# goes through the same artifact writer and which SQL can restate.
ONE = ("leakage_aware", "random_forest")
COMBOS = [(e, m, 20000.0 * (1 + 0.25 * i + 0.1 * j)) for i, e in enumerate(C.EXPERIMENTS) for j, m in enumerate(C.MODELS)]


def one_root(spark: SparkSession, sf_dir: str) -> str:
    def build():
        root = scratch_path(spark, f"runs/{uuid.uuid4().hex}")
        EX.run_one(spark, modelling_frame(spark, sf_dir), root, *ONE, settings={ONE[1]: [QUICK[ONE[1]]]},
                   dataset_path=sf_dir, prepared={ONE[0]: folds(spark, sf_dir)})
        return root
    return run_table(spark, ("one_root", *input_state(spark, sf_dir)), build)


def scorer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed scores of every combination on the split table: a function of the
    closest distance with the combination's own scale. Each row meets its
    combinations in a literal array."""
    sp = split_scored(spark, sf_dir)
    combos = F.array(*[F.struct(F.lit(e).alias("experiment"), F.lit(m).alias("model"), F.lit(k).alias("k")) for e, m, k in COMBOS])
    p = F.floor(1000.0 * F.col("c.k") / (F.col("c.k") + F.col("closest_miss_distance_km"))) / 1000
    return sp.withColumn("c", F.explode(combos)).select(
        "c.experiment", "c.model", F.when(F.col("is_test"), F.lit("holdout")).otherwise(F.lit("oof")).alias("part"), "fold", C.ID, "y",
        p.alias("p"), (p >= 0.5).alias("pred"), *PROFILE_FEATURES)


def scorer_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An importance per combination and feature: the feature's mean over
    positive less negative training rows, over the combination's scale."""
    sp = split_scored(spark, sf_dir).filter(~F.col("is_test"))
    diff = sp.agg(*[(F.avg(F.when(F.col("y"), F.col(f).cast("double"))) - F.avg(F.when(~F.col("y"), F.col(f).cast("double"))))
                    .alias(f) for f in PROFILE_FEATURES])
    cells = [F.struct(F.lit(e).alias("experiment"), F.lit(m).alias("model"), F.lit(f"numeric__{f}").alias("feature"),
                      (F.col(f) / F.lit(k)).alias("importance"))
             for e, m, k in COMBOS if m != "dummy_most_frequent" for f in PROFILE_FEATURES]
    return diff.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def run_root(spark: SparkSession, sf_dir: str) -> str:
    def build():
        root = scratch_path(spark, f"runs/{uuid.uuid4().hex}")
        # a row-local function of a written table: each pass works it out again
        arts = EX.artifacts_from_scores(scorer_scores(spark, sf_dir), PROFILE_FEATURES)
        n = split_scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).first()
        arts["metadata"] = EX.metadata(spark, [{"experiment": e, "model": m, "best": {"scale": k}} for e, m, k in COMBOS],
                                       n["n"], n["t"], dataset_path=sf_dir)
        arts["feature_importance"] = scorer_importance(spark, sf_dir)
        EX.write_artifacts(arts, root)
        return root
    return run_table(spark, ("run_root", *input_state(spark, sf_dir)), build)


def registry_root(spark: SparkSession, sf_dir: str) -> str:
    def build():
        root = scratch_path(spark, f"registry/{uuid.uuid4().hex}")
        EX.train_legacy(spark, modelling_frame(spark, sf_dir), root)  # with the legacy trainer's own settings
        return root
    return run_table(spark, ("registry_root", *input_state(spark, sf_dir)), build)


def art(spark, sf_dir, name) -> DataFrame:
    return EX.read_artifact(spark, run_root(spark, sf_dir), name)


def expected_grid(spark: SparkSession, experiments=None, models=None) -> DataFrame:
    """Every experiment x model pair, from a literal array (no join)."""
    pairs = [(e, m) for e in (experiments or C.EXPERIMENTS) for m in (models or C.MODELS)]
    return spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(e).alias("experiment"), F.lit(m).alias("model")) for e, m in pairs])).alias("g")) \
        .select("g.*")


# --- the fixed scores in SQL ------------------------------------------------------------
_COMBO = ", ".join(f"('{e}', '{m}', {k!r})" for e, m, k in COMBOS)
_SCORED_SQL = f"""
, combo AS (SELECT * FROM (VALUES {_COMBO}) v(experiment, model, k)),
hs0 AS (SELECT experiment, model, is_test, fold, neo_id, y,
               floor(1000.0 * CAST(k AS DOUBLE) / (CAST(k AS DOUBLE) + closest_miss_distance_km)) / 1000 AS p FROM sp, combo),
hs AS (SELECT *, p >= 0.5 AS pred FROM hs0),
hold AS (SELECT * FROM hs WHERE is_test),
oof AS (SELECT * FROM hs WHERE NOT is_test)
"""


def _grouped_sql(src: str, keys: str, tag: str) -> str:
    """CTEs m_<tag>: counts, metrics and curve areas per ``keys``."""
    on = " AND ".join(f"c.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    return f"""
, g_{tag} AS (SELECT {keys}, p, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg
             FROM {src} WHERE p IS NOT NULL GROUP BY {keys}, p),
p_{tag} AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {keys}) AS P_,
                   sum(neg) OVER (PARTITION BY {keys}) AS N_ FROM g_{tag}
            WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a_{tag} AS (SELECT {keys}, CASE WHEN max(P_) > 0 AND max(N_) > 0
                  THEN sum(pos * (N_ - fp) + 0.5 * pos * neg) / (max(P_) * max(N_)) END AS roc_auc,
                  CASE WHEN max(P_) > 0 AND max(N_) > 0 THEN sum((pos / P_) * (tp / (tp + fp))) END AS pr_auc
           FROM p_{tag} GROUP BY {keys}),
c_{tag} AS (SELECT {keys}, count(*) FILTER (WHERE NOT y AND NOT pred) AS tn, count(*) FILTER (WHERE NOT y AND pred) AS fp,
                  count(*) FILTER (WHERE y AND NOT pred) AS fn, count(*) FILTER (WHERE y AND pred) AS tp
           FROM {src} GROUP BY {keys}),
m_{tag} AS (SELECT c.*, (tp + tn) / (tn + fp + fn + tp) AS accuracy,
                  COALESCE(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 0) AS precision,
                  COALESCE(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 0) AS recall,
                  COALESCE(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0) AS f1, roc_auc, pr_auc
           FROM c_{tag} c LEFT JOIN a_{tag} a ON {on})
"""


_METRICS = EX.FOLD_METRICS
_RUN_SQL = (_SCORED_SQL + _grouped_sql("oof", "experiment, model, fold", "f") + _grouped_sql("hold", "experiment, model", "t") + """
, cvl AS (""" + " UNION ALL ".join(f"SELECT experiment, model, '{m}' AS metric, {m} AS value FROM m_f" for m in _METRICS) + """),
cv AS (SELECT experiment, model, metric, avg(value) AS mean,
              CASE WHEN count(value) > 1 THEN stddev_samp(value) WHEN count(value) = 1 THEN 0.0 END AS std
       FROM cvl GROUP BY experiment, model, metric),
summ AS (SELECT t.experiment, t.model, cv.mean AS cv_f1_mean, cv.std AS cv_f1_std, t.f1 AS test_f1, t.precision AS test_precision,
                t.recall AS test_recall, t.roc_auc AS test_roc_auc, t.pr_auc AS test_pr_auc
         FROM m_t t LEFT JOIN cv ON cv.experiment = t.experiment AND cv.model = t.model AND cv.metric = 'f1')
""")
_SUMM = ["cv_f1_mean", "cv_f1_std", "test_f1", "test_precision", "test_recall", "test_roc_auc", "test_pr_auc"]
_SUMM_SQL = ", ".join(f"ROUND({c}, 6) AS {c}" for c in _SUMM)


def run_sql(body: str) -> str:
    return with_split(_RUN_SQL + body)


# --- S7 / S8 / U5 -----------------------------------------------------------------------
@query("artifacts", run_sql(f"""
, n AS (SELECT experiment, model, 'metadata' AS artifact, 1 AS n_rows FROM combo
  UNION ALL SELECT experiment, model, 'fold_metrics', count(*) FROM m_f GROUP BY ALL
  UNION ALL SELECT experiment, model, 'cv_metrics', count(*) FROM cv GROUP BY ALL
  UNION ALL SELECT experiment, model, 'test_metrics', 1 FROM m_t
  UNION ALL SELECT experiment, model, 'confusion_matrix', 1 FROM m_t
  UNION ALL SELECT experiment, model, 'roc_curve', count(*) + 1 FROM p_t WHERE P_ > 0 AND N_ > 0 GROUP BY ALL
  UNION ALL SELECT experiment, model, 'pr_curve', count(*) + 1 FROM p_t WHERE P_ > 0 AND N_ > 0 GROUP BY ALL
  UNION ALL SELECT experiment, model, 'threshold_analysis', {len(C.THRESHOLD_GRID)} FROM m_t
  UNION ALL SELECT experiment, model, 'predictions', count(*) FROM hold GROUP BY ALL
  UNION ALL SELECT experiment, model, 'error_records', sum(least(50, c)) FROM (
      SELECT experiment, model, y, count(*) AS c FROM hold WHERE y != pred GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT experiment, model, 'feature_importance', {len(PROFILE_FEATURES)} FROM combo WHERE model != 'dummy_most_frequent')
SELECT experiment, model, artifact, CAST(n_rows AS BIGINT) AS n_rows FROM n
"""))
def q_artifacts(spark, sf_dir):
    """Rows of every artifact table of the run, except those of SQL-free
    content (calibration bins, error profile); tables that a run has no
    content for are not written and not listed."""
    out = None
    for name in EX.ARTIFACT_TABLES:
        if name in ("calibration", "error_analysis", "permutation_importance", "shap_summary"):
            continue
        t = (art(spark, sf_dir, name).groupBy("experiment", "model").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
             .withColumn("artifact", F.lit(name)))
        out = t if out is None else out.unionByName(t)
    return out


@query("run_summary", run_sql(f"SELECT experiment, model, {_SUMM_SQL} FROM summ"))
def q_run_summary(spark, sf_dir):
    return normalise(EX.run_summary(spark, run_root(spark, sf_dir)))


@query("run_one")
def q_run_one(spark, sf_dir):
    """M20 for one trained combination (random forest on the leakage-aware
    set) as its summary row."""
    return normalise(EX.run_summary(spark, one_root(spark, sf_dir)))


# One setting a model, so that the whole grid trains within minutes on one machine;
# ``EX.run_all`` without ``settings`` searches the spaces. Attributions are of a fixed
# sample of 50 holdout rows (L7), as in the audited runs.
GRID_SETTINGS = {m: [QUICK[m]] for m in ("logistic_regression", "random_forest", "xgboost")}


def trained_root(spark: SparkSession, sf_dir: str) -> str:
    def build():
        root = scratch_path(spark, f"runs/{uuid.uuid4().hex}")
        mf = modelling_frame(spark, sf_dir)
        EX.run_grid(spark, mf, root, C.EXPERIMENTS, C.MODELS, settings=GRID_SETTINGS,
                    permutation_repeats=0, shap_rows=50, dataset_path=sf_dir, parallel=EX.fits_at_once(mf.count()))
        return root
    return run_table(spark, ("trained_root", *input_state(spark, sf_dir)), build)


@query("trained_grid")
def q_trained_grid(spark, sf_dir):
    """All 16 combinations trained, fold by fold and on all training rows, as their summary rows."""
    return normalise(EX.run_summary(spark, trained_root(spark, sf_dir)))


# --- J3 / R2 / A18 / R1 / R3 ---------------------------------------------------------------
@query("experiment_grid", run_sql(f"""
SELECT c.experiment, c.model, {_SUMM_SQL}, s.experiment IS NOT NULL AS executed
FROM combo c LEFT JOIN summ s ON c.experiment = s.experiment AND c.model = s.model
"""))
def q_experiment_grid(spark, sf_dir):
    """The summary has a row per combination, so it is broadcast."""
    summ = EX.run_summary(spark, run_root(spark, sf_dir)).withColumn("executed", F.lit(True))
    return normalise(expected_grid(spark).join(F.broadcast(summ), ["experiment", "model"], "left").fillna(False, ["executed"]))


@query("execution_matrix", run_sql(", ex AS (SELECT c.experiment, c.model, s.experiment IS NOT NULL AS e FROM combo c "
       "LEFT JOIN summ s ON c.experiment = s.experiment AND c.model = s.model)\nSELECT experiment, "
       + ", ".join(f"bool_or(e) FILTER (WHERE model = '{m}') AS {m}" for m in C.MODELS)
       + ", CAST(count(*) FILTER (WHERE e) AS BIGINT) AS n_executed FROM ex GROUP BY experiment"))
def q_execution_matrix(spark, sf_dir):
    g = q_experiment_grid(spark, sf_dir)
    return g.groupBy("experiment").pivot("model", C.MODELS).agg(F.max("executed")).join(
        g.groupBy("experiment").agg(F.count_if("executed").cast("bigint").alias("n_executed")), "experiment")


_LINE = [("CV F1 ", "cv_f1_mean"), (" ± ", "cv_f1_std"), ("; test F1 ", "test_f1"), (" precision ", "test_precision"),
         (" recall ", "test_recall"), (" roc_auc ", "test_roc_auc"), (" pr_auc ", "test_pr_auc")]


@query("results_report", run_sql("SELECT c.experiment, c.model, s.experiment IS NOT NULL AS executed, "
       "CASE WHEN s.experiment IS NULL THEN 'Not yet executed.' ELSE "
       + " || ".join(f"'{t}' || COALESCE(printf('%.3f', ROUND(ROUND({c}, 6), 3)), 'n/a')" for t, c in _LINE)
       + " END AS summary FROM combo c LEFT JOIN summ s ON c.experiment = s.experiment AND c.model = s.model"))
def q_results_report(spark, sf_dir):
    """One line per combination; missing cells say not executed."""
    g = q_experiment_grid(spark, sf_dir)
    fmt = lambda c: F.coalesce(F.format_string("%.3f", round_half_up(F.col(c), 3)), F.lit("n/a"))
    line = F.when(~F.col("executed"), F.lit("Not yet executed.")).otherwise(
        F.concat(*[x for t, c in _LINE for x in (F.lit(t), fmt(c))]))
    return g.select("experiment", "model", "executed", line.alias("summary"))


EXPECTED_FILES = ["cv_metrics", "fold_metrics", "test_metrics", "confusion_matrix", "roc_curve", "pr_curve",
                  "predictions", "metadata"]


@query("artifact_check", run_sql("SELECT c.experiment, c.model, f.artifact, s.experiment IS NOT NULL AS present FROM combo c, (VALUES "
       + ", ".join(f"('{f}')" for f in EXPECTED_FILES)
       + ") f(artifact) LEFT JOIN summ s ON c.experiment = s.experiment AND c.model = s.model"))
def q_artifact_check(spark, sf_dir):
    """Expected artifact per combination and whether it is present."""
    present = None
    for name in EXPECTED_FILES:
        t = art(spark, sf_dir, name).select("experiment", "model").distinct().withColumn("artifact", F.lit(name))
        present = t if present is None else present.unionByName(t)
    exp = expected_grid(spark).select(
        "*", F.explode(F.array(*[F.lit(n) for n in EXPECTED_FILES])).alias("artifact"))
    return exp.join(present.withColumn("present", F.lit(True)), ["experiment", "model", "artifact"], "left").fillna(False, ["present"])


# --- R7 -------------------------------------------------------------------------------------
@query("model_compare", run_sql(", tl AS (" + " UNION ALL ".join(
    f"SELECT experiment, model, '{m}' AS metric, {m} AS test_value FROM m_t" for m in _METRICS) + """)
SELECT tl.experiment, tl.model, tl.metric, ROUND(test_value, 6) AS test_value, ROUND(mean, 6) AS cv_mean, ROUND(std, 6) AS cv_std
FROM tl LEFT JOIN cv ON tl.experiment = cv.experiment AND tl.model = cv.model AND tl.metric = cv.metric
"""))
def q_model_compare(spark, sf_dir):
    tm = art(spark, sf_dir, "test_metrics")
    long = tm.select("experiment", "model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("test_value")) for m in _METRICS]))
        .alias("s")).select("experiment", "model", "s.*")
    cv = art(spark, sf_dir, "cv_metrics").select("experiment", "model", "metric", F.col("mean").alias("cv_mean"),
                                                 F.col("std").alias("cv_std"))
    return normalise(long.join(cv, ["experiment", "model", "metric"], "left"))


# --- J5 / W7 / L8 / L3 / R8 -----------------------------------------------------------------
def importance_long(spark, sf_dir) -> DataFrame:
    return art(spark, sf_dir, "feature_importance").select(
        "experiment", "model", strip_prefix("feature").alias("feature"), F.col("importance").alias("value"))


_IMP_SQL = """
, diff AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CASE WHEN y THEN CAST({f} AS DOUBLE) END) - avg(CASE WHEN NOT y THEN CAST({f} AS DOUBLE) END) AS d "
    f"FROM sp WHERE NOT is_test" for f in PROFILE_FEATURES) + """),
imp AS (SELECT experiment, model, feature, d / CAST(k AS DOUBLE) AS value FROM diff, combo WHERE model != 'dummy_most_frequent')
"""


@query("importance_compare", run_sql(_IMP_SQL + """
, sc_ AS (SELECT model, feature, value, abs(value) / max(abs(value)) OVER (PARTITION BY model) AS scaled
          FROM imp WHERE experiment = 'leakage_aware')
SELECT feature, ROUND(max(abs(value)), 6) AS max_abs, """ + ", ".join(
    f"ROUND(max(scaled) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in C.MODELS if m != "dummy_most_frequent") + """
FROM sc_ GROUP BY feature ORDER BY max(abs(value)) DESC, feature LIMIT 15
"""))
def q_importance_compare(spark, sf_dir):
    """Per feature and model: importance scaled by the largest absolute value
    within the model (W7), models side by side (pivot = full outer join, J5),
    top 15 features by the largest absolute value over models (L8)."""
    fi = importance_long(spark, sf_dir).filter(F.col("experiment") == "leakage_aware")
    w = Window.partitionBy("model")
    scaled = fi.withColumn("scaled", F.try_divide(F.abs("value"), F.max(F.abs("value")).over(w)))
    wide = scaled.groupBy("feature").pivot("model", [m for m in C.MODELS if m != "dummy_most_frequent"]) \
        .agg(F.first("scaled"))
    top = fi.groupBy("feature").agg(F.max(F.abs("value")).alias("max_abs")) \
        .orderBy(F.col("max_abs").desc(), F.col("feature")).limit(15)
    return normalise(top.join(wide, "feature", "left"))


@query("top_importance", run_sql(_IMP_SQL + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY experiment, model ORDER BY abs(value) DESC, feature) AS rank FROM imp)
SELECT experiment, model, feature, ROUND(value, 6) AS value, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 15
"""))
def q_top_importance(spark, sf_dir):
    """L3: top 15 features by absolute importance per experiment and model."""
    fi = importance_long(spark, sf_dir)
    w = Window.partitionBy("experiment", "model").orderBy(F.abs("value").desc(), F.col("feature"))
    return normalise(fi.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 15))


@query("shap_summary")
def q_shap_summary(spark, sf_dir):
    """Attribution summary of the trained forest over all holdout rows,
    prefix stripped."""
    s = EX.read_artifact(spark, one_root(spark, sf_dir), "shap_summary")
    return normalise(s.select("experiment", "model", strip_prefix("feature").alias("feature"),
                              "mean_abs_attribution"))


# --- S9 / M17 / M18 / M19 ------------------------------------------------------------------
@query("train_legacy")
def q_train_legacy(spark, sf_dir):
    root = registry_root(spark, sf_dir)
    reg = EX.registered_models(spark, root)
    return reg.select("model_name", "version",
                      F.get_json_object("metadata", "$.metrics.f1").cast("double").alias("f1"),
                      F.get_json_object("metadata", "$.metrics.roc_auc").cast("double").alias("roc_auc"))


@query("registry")
def q_registry(spark, sf_dir):
    return EX.registered_models(spark, registry_root(spark, sf_dir)).select(
        "model_name", "version", F.get_json_object("metadata", "$.test_size").cast("double").alias("test_size"))


@query("batch_predict")
def q_batch_predict(spark, sf_dir):
    root = registry_root(spark, sf_dir)
    r = EX.registered_models(spark, root).filter(F.col("model_name") == "random_forest").first()
    model = EX.load_model(root, r["model_name"], r["version"])
    rows = cleaned_derived(spark, sf_dir).select(*[c for c in C.FLAT_COLUMNS if c != C.TARGET])
    return normalise(EX.batch_predict(model, rows, r["version"]))


@query("reevaluate")
def q_reevaluate(spark, sf_dir):
    return normalise(EX.reevaluate(spark, registry_root(spark, sf_dir), modelling_frame(spark, sf_dir)))


# --- R6 ----------------------------------------------------------------------------------
@query("repro_record")
def q_repro_record(spark, sf_dir):
    """R6 for the trained run: fixed parameters, versions, dataset path and
    provenance, and the chosen settings of each combination."""
    root = one_root(spark, sf_dir)
    meta = EX.read_artifact(spark, root, "metadata")
    return meta.select(
        "experiment", "model", "random_seed", "n_cv_folds", "outer_test_size", "dataset_path", "provenance", "purpose",
        "dataset_row_count", "feature_columns", "best_hyperparameters", F.lit(",".join(C.EXPERIMENTS)).alias("feature_sets"),
        F.lit(",".join(C.MODELS)).alias("models"), "python", "spark", F.col("trained_at_utc").alias("first_run_utc"),
        F.lit(pyspark.__version__).alias("session_spark"), F.count(F.lit(1)).over(Window.partitionBy("random_seed")).alias("n_executed"))


# --- S6 / S10 sinks -------------------------------------------------------------------------
def validation_root(spark: SparkSession, sf_dir: str) -> str:
    """The whole written report, the cleaning counts and the null profile of the cleaned table."""
    def build():
        root = scratch_path(spark, f"reports/{uuid.uuid4().hex}")
        q_clean_report(spark, sf_dir).write.parquet(f"{root}/validation_report")
        q_null_profile(spark, sf_dir).write.parquet(f"{root}/null_profile")
        return root
    return run_table(spark, ("validation_root", *input_state(spark, sf_dir)), build)


@query("validation_report", ORACLE["clean_report"])
def q_validation_report(spark, sf_dir):
    """The cleaning counts as written, read again."""
    return spark.read.parquet(f"{validation_root(spark, sf_dir)}/validation_report")


@query("validation_null_profile", ORACLE["null_profile"])
def q_validation_null_profile(spark, sf_dir):
    """The null profile as written, read again."""
    return spark.read.parquet(f"{validation_root(spark, sf_dir)}/null_profile")


@query("anomaly_sink")
def q_anomaly_sink(spark, sf_dir):
    """The anomaly scores as a Parquet table."""
    path = scratch_path(spark, f"reports/{uuid.uuid4().hex}/anomaly_scores")
    anomaly_table(spark, sf_dir).write.parquet(path)
    return normalise(spark.read.parquet(path))


# --- 2.14 label correlation ----------------------------------------------------------------
CORR_FEATURES = list(C.PHYSICAL_KINEMATIC_NUMERIC)


@query("label_correlation", with_flat("SELECT feature, ROUND(r, 6) AS correlation, n FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr(CAST({f} AS DOUBLE), CAST(is_potentially_hazardous_asteroid AS DOUBLE)) AS r, "
    f"CAST(count({f}) AS BIGINT) AS n FROM derived" for f in CORR_FEATURES) + ")"))
def q_label_correlation(spark, sf_dir):
    """Pearson correlation of each physical/kinematic feature with the label
    over the clean table: one aggregate pass."""
    d = cleaned_derived(spark, sf_dir)
    y = F.col(C.TARGET).cast("double")
    row = d.agg(*[F.corr(F.col(f).cast("double"), y).alias(f"r{i}") for i, f in enumerate(CORR_FEATURES)],
                *[F.count(f).alias(f"n{i}") for i, f in enumerate(CORR_FEATURES)])
    return normalise(row.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("correlation"), F.col(f"n{i}").cast("bigint").alias("n"))
        for i, f in enumerate(CORR_FEATURES)])).alias("s")).select("s.*"))
