"""Split and metric queries on a given score (W4, W5, J6, L7, A25, A6–A13,
A15, A23, W2, W3, M12, L5, P9, F6, L9, R9, U3).

The score is a fixed function of the closest distance on the analog,
``p = floor(1000 * 20000 / (20000 + closest)) / 1000`` (exact in both
engines, with ties), and ``pred = p >= 0.5``. Metrics are computed on the
holdout rows; fold metrics on the training folds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.functions.scalar import label_text, outcome
from leakscope.operators import metrics as M
from leakscope.operators.bootstrap import bootstrap_scores
from leakscope.operators import split as S
from leakscope.operators.rank import grouped_medians
from leakscope.plans.q_ingest import cleaned_derived
from leakscope.plans.registry import normalise, query
from leakscope.plans.sql_base import hash_bits_sql, with_flat
from leakscope.session import input_state, materialize, run_table, written

PROFILE_FEATURES = list(C.PHYSICAL_KINEMATIC_NUMERIC)


def score_col() -> F.Column:
    return F.floor(F.lit(20000000.0) / (F.lit(20000.0) + F.col("closest_miss_distance_km"))) / 1000


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cleaned_derived(spark, sf_dir)
    return d.select(C.ID, F.col(C.TARGET).alias("y"), score_col().alias("p"), *PROFILE_FEATURES) \
        .withColumn("pred", F.col("p") >= 0.5)


def split_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with is_test and fold (the split table joined back on id:
    both sides are hash-partitioned on the id, a co-partitioned join)."""
    def build():
        sc = written(scored(spark, sf_dir))
        sp = S.split_table(sc.select(C.ID, F.col("y").alias(C.TARGET)))
        return written(sc.join(sp.drop(C.TARGET), C.ID, "inner"))
    return run_table(spark, ("split_scored", *input_state(spark, sf_dir)), build)


def test_rows(spark, sf_dir) -> DataFrame:
    return split_scored(spark, sf_dir).filter(F.col("is_test"))


# --- SQL restatement ----------------------------------------------------------------
_FEATS = ", ".join(PROFILE_FEATURES)
SPLIT_CTES = f"""
, sc AS (SELECT neo_id, is_potentially_hazardous_asteroid AS y,
                floor(20000000.0 / (20000.0 + closest_miss_distance_km)) / 1000 AS p, {_FEATS}
         FROM derived),
sc2 AS (SELECT *, p >= 0.5 AS pred FROM sc),
cnt AS (SELECT y, count(*) AS n_c FROM sc2 GROUP BY y),
tot AS (SELECT CAST(sum(n_c) AS BIGINT) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_test FROM cnt),
a0 AS (SELECT y, n_c * n_test / n AS ex, floor(n_c * n_test / n) AS fl FROM cnt, tot),
alloc AS (SELECT y, CAST(fl AS BIGINT)
                  + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, CAST(y AS VARCHAR))
                              <= (SELECT n_test FROM tot) - (SELECT sum(fl) FROM a0) THEN 1 ELSE 0 END AS k
          FROM a0),
ho AS (SELECT sc2.*, row_number() OVER (PARTITION BY sc2.y ORDER BY {hash_bits_sql('holdout42', 'neo_id')}, neo_id)
                     <= alloc.k AS is_test
       FROM sc2 JOIN alloc ON sc2.y = alloc.y),
sp AS (SELECT ho.*, CASE WHEN is_test THEN NULL
                         ELSE CAST((row_number() OVER (PARTITION BY is_test
                                    ORDER BY y, {hash_bits_sql('fold42', 'neo_id')}, neo_id) - 1) % 5 + 1 AS INTEGER)
                    END AS fold
       FROM ho),
te AS (SELECT * FROM sp WHERE is_test)
"""


def with_split(body: str) -> str:
    return with_flat(SPLIT_CTES + body)


# --- W4 / J1 ----------------------------------------------------------------------
@query("holdout_split", with_split("""
SELECT y AS is_potentially_hazardous_asteroid, is_test, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(min(neo_id) AS VARCHAR) AS first_id
FROM sp GROUP BY y, is_test
"""))
def q_holdout_split(spark, sf_dir):
    sp = split_scored(spark, sf_dir)
    return sp.groupBy(F.col("y").alias(C.TARGET), "is_test").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.min(C.ID).alias("first_id"))


@query("holdout_ids", with_split("SELECT neo_id, y AS is_potentially_hazardous_asteroid FROM te"))
def q_holdout_ids(spark, sf_dir):
    return test_rows(spark, sf_dir).select(C.ID, F.col("y").alias(C.TARGET))


# --- W5 ---------------------------------------------------------------------------
@query("kfold", with_split("""
SELECT fold, y AS is_potentially_hazardous_asteroid, CAST(count(*) AS BIGINT) AS n_rows
FROM sp WHERE NOT is_test GROUP BY fold, y
"""))
def q_kfold(spark, sf_dir):
    sp = split_scored(spark, sf_dir).filter(~F.col("is_test"))
    return sp.groupBy("fold", F.col("y").alias(C.TARGET)).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("kfold_ids", with_split("SELECT neo_id, fold FROM sp WHERE NOT is_test"))
def q_kfold_ids(spark, sf_dir):
    return split_scored(spark, sf_dir).filter(~F.col("is_test")).select(C.ID, "fold")


# --- J6 ---------------------------------------------------------------------------
@query("split_disjoint", with_split("""
SELECT f AS fold, CAST((SELECT count(*) FROM sp a WHERE NOT a.is_test AND a.fold <> f
                        AND a.neo_id IN (SELECT neo_id FROM sp b WHERE b.fold = f)) AS BIGINT) AS n_overlap
FROM (VALUES (1), (2), (3), (4), (5)) t(f)
UNION ALL
SELECT 0, CAST((SELECT count(*) FROM sp a WHERE NOT a.is_test AND a.neo_id IN (SELECT neo_id FROM te)) AS BIGINT)
"""))
def q_split_disjoint(spark, sf_dir):
    sp = split_scored(spark, sf_dir).select(C.ID, "is_test", "fold")
    return S.disjoint_check(sp)


# --- L7 ---------------------------------------------------------------------------
@query("fixed_sample", with_flat(f"""
SELECT neo_id, orbit_class_type FROM derived
ORDER BY {hash_bits_sql('sample42', 'neo_id')}, neo_id LIMIT 50
"""))
def q_fixed_sample(spark, sf_dir):
    return S.fixed_sample(cleaned_derived(spark, sf_dir).select(C.ID, "orbit_class_type"), 50)


# --- A25 --------------------------------------------------------------------------
@query("class_weights", with_split("""
, tr AS (SELECT * FROM sp WHERE NOT is_test),
st AS (SELECT count(*) AS n, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM tr)
SELECT false AS is_potentially_hazardous_asteroid, CAST(neg AS BIGINT) AS n_class,
       ROUND(CASE WHEN neg = 0 THEN NULL ELSE n / (2.0 * neg) END, 6) AS balanced_weight,
       ROUND(CASE WHEN pos = 0 THEN 1.0 ELSE neg / pos END, 6) AS scale_pos_weight FROM st
UNION ALL
SELECT true, CAST(pos AS BIGINT), ROUND(CASE WHEN pos = 0 THEN NULL ELSE n / (2.0 * pos) END, 6),
       ROUND(CASE WHEN pos = 0 THEN 1.0 ELSE neg / pos END, 6) FROM st
"""))
def q_class_weights(spark, sf_dir):
    tr = split_scored(spark, sf_dir).filter(~F.col("is_test")).select(F.col("y").alias(C.TARGET))
    return normalise(S.class_weights(tr))


# --- A6 / A23 ---------------------------------------------------------------------
_CM_SQL = """
cm AS (SELECT CAST(count(*) FILTER (WHERE NOT y AND NOT pred) AS BIGINT) AS tn,
              CAST(count(*) FILTER (WHERE NOT y AND pred) AS BIGINT) AS fp,
              CAST(count(*) FILTER (WHERE y AND NOT pred) AS BIGINT) AS fn,
              CAST(count(*) FILTER (WHERE y AND pred) AS BIGINT) AS tp FROM te)
"""


def _r(expr: str, name: str) -> str:
    return f"ROUND({expr}, 6) AS {name}"


@query("confusion", with_split(", " + _CM_SQL + f"""
SELECT tn, fp, fn, tp,
  {_r('CASE WHEN tn+fp+fn+tp = 0 THEN NULL ELSE tn / (tn+fp+fn+tp) END', 'tn_share')},
  {_r('CASE WHEN tn+fp+fn+tp = 0 THEN NULL ELSE fp / (tn+fp+fn+tp) END', 'fp_share')},
  {_r('CASE WHEN tn+fp+fn+tp = 0 THEN NULL ELSE fn / (tn+fp+fn+tp) END', 'fn_share')},
  {_r('CASE WHEN tn+fp+fn+tp = 0 THEN NULL ELSE tp / (tn+fp+fn+tp) END', 'tp_share')},
  {_r('CASE WHEN tn+fp = 0 THEN NULL ELSE tn / (tn+fp) END', 'tn_row_share')},
  {_r('CASE WHEN tn+fp = 0 THEN NULL ELSE fp / (tn+fp) END', 'fp_row_share')},
  {_r('CASE WHEN fn+tp = 0 THEN NULL ELSE fn / (fn+tp) END', 'fn_row_share')},
  {_r('CASE WHEN fn+tp = 0 THEN NULL ELSE tp / (fn+tp) END', 'tp_row_share')},
  {_r('CASE WHEN tn+fp+fn+tp = 0 THEN NULL ELSE (tp+fn) / (tn+fp+fn+tp) END', 'prevalence')}
FROM cm
"""))
def q_confusion(spark, sf_dir):
    return normalise(M.confusion_shares(M.confusion(test_rows(spark, sf_dir))))


# --- A7 ---------------------------------------------------------------------------
_METRIC_EXPRS = """
  ROUND(COALESCE(CASE WHEN tn+fp+fn+tp = 0 THEN NULL ELSE (tp+tn) / (tn+fp+fn+tp) END, 0), 6) AS accuracy,
  ROUND(COALESCE(CASE WHEN tp+fp = 0 THEN NULL ELSE tp / (tp+fp) END, 0), 6) AS precision,
  ROUND(COALESCE(CASE WHEN tp+fn = 0 THEN NULL ELSE tp / (tp+fn) END, 0), 6) AS recall,
  ROUND(COALESCE(CASE WHEN 2*tp+fp+fn = 0 THEN NULL ELSE 2*tp / (2*tp+fp+fn) END, 0), 6) AS f1
"""


@query("class_metrics", with_split(", " + _CM_SQL + f"SELECT tn, fp, fn, tp, {_METRIC_EXPRS} FROM cm"))
def q_class_metrics(spark, sf_dir):
    return normalise(M.metrics_from_counts(M.confusion(test_rows(spark, sf_dir))))


# --- curve points in SQL ------------------------------------------------------------
def _points_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
, grp AS (SELECT {g}p AS score, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg
          FROM {src} WHERE p IS NOT NULL GROUP BY {g}p),
pts AS (SELECT {g}score, pos, neg,
               sum(pos) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
               sum(pos) OVER ({part.strip()}) AS P_, sum(neg) OVER ({part.strip()}) AS N_
        FROM grp)
"""


# --- A8 ---------------------------------------------------------------------------
@query("roc_auc", with_split(_points_sql("te") + """
SELECT ROUND(CASE WHEN max(P_) > 0 AND max(N_) > 0
                  THEN sum(pos * (N_ - fp) + 0.5 * pos * neg) / (max(P_) * max(N_)) END, 6) AS roc_auc
FROM pts
"""))
def q_roc_auc(spark, sf_dir):
    return normalise(M.roc_auc(test_rows(spark, sf_dir)))


# --- A9 ---------------------------------------------------------------------------
@query("avg_precision", with_split(_points_sql("te") + """
SELECT ROUND(CASE WHEN max(P_) > 0 AND max(N_) > 0 THEN sum((pos / P_) * (tp / (tp + fp))) END, 6)
         AS average_precision
FROM pts
"""))
def q_avg_precision(spark, sf_dir):
    return normalise(M.average_precision(test_rows(spark, sf_dir)))


# --- A10 --------------------------------------------------------------------------
@query("brier", with_split("SELECT ROUND(avg(pow(p - CAST(y AS DOUBLE), 2)), 6) AS brier_score FROM te"))
def q_brier(spark, sf_dir):
    return normalise(M.brier(test_rows(spark, sf_dir)))


# --- W2 / W3 ----------------------------------------------------------------------
@query("roc_curve", with_split(_points_sql("te") + """
SELECT ROUND(score, 6) AS threshold, ROUND(fp / N_, 6) AS fpr, ROUND(tp / P_, 6) AS tpr FROM pts
WHERE P_ > 0 AND N_ > 0
UNION ALL
SELECT NULL, 0.0, 0.0 FROM (SELECT 1) WHERE (SELECT max(P_) FROM pts) > 0 AND (SELECT max(N_) FROM pts) > 0
"""))
def q_roc_curve(spark, sf_dir):
    return normalise(M.roc_curve(test_rows(spark, sf_dir)))


@query("pr_curve", with_split(_points_sql("te") + """
SELECT ROUND(score, 6) AS threshold, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / P_, 6) AS recall FROM pts
WHERE P_ > 0 AND N_ > 0
UNION ALL
SELECT NULL, 1.0, 0.0 FROM (SELECT 1) WHERE (SELECT max(P_) FROM pts) > 0 AND (SELECT max(N_) FROM pts) > 0
"""))
def q_pr_curve(spark, sf_dir):
    return normalise(M.pr_curve(test_rows(spark, sf_dir)))


# --- A11 --------------------------------------------------------------------------
@query("calibration", with_split("""
, q AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM te),
b AS (SELECT te.*, (SELECT count(*) FROM unnest((SELECT e FROM q)) u(x) WHERE x < te.p) AS bin FROM te)
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, ROUND(avg(CAST(y AS DOUBLE)), 6) AS prob_true,
       ROUND(avg(p), 6) AS prob_pred
FROM b GROUP BY bin
"""))
def q_calibration(spark, sf_dir):
    return normalise(M.calibration(test_rows(spark, sf_dir)))


# --- M12 / L5 ---------------------------------------------------------------------
_GRID_SQL = ", ".join(f"({t})" for t in C.THRESHOLD_GRID)
_SWEEP_SQL = f"""
, tr AS (SELECT * FROM sp WHERE NOT is_test),
grid AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES {_GRID_SQL}) g(t)),
sw0 AS (SELECT threshold,
               count(*) FILTER (WHERE y AND p >= threshold) AS tp,
               count(*) FILTER (WHERE NOT y AND p >= threshold) AS fp,
               count(*) FILTER (WHERE y) AS P_
        FROM grid, tr GROUP BY threshold),
sw AS (SELECT threshold,
              COALESCE(CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END, 0) AS precision,
              COALESCE(CASE WHEN P_ = 0 THEN NULL ELSE tp / P_ END, 0) AS recall,
              COALESCE(CASE WHEN tp + fp + P_ = 0 THEN NULL ELSE 2 * tp / (tp + fp + P_) END, 0) AS f1
       FROM sw0)
"""


def oof_rows(spark, sf_dir) -> DataFrame:
    """Training rows only: the sweep never sees the holdout."""
    return split_scored(spark, sf_dir).filter(~F.col("is_test"))


@query("threshold_sweep", with_split(_SWEEP_SQL + """
SELECT ROUND(threshold, 6) AS threshold, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
       ROUND(f1, 6) AS f1 FROM sw
"""))
def q_threshold_sweep(spark, sf_dir):
    return normalise(M.threshold_sweep(oof_rows(spark, sf_dir)))


@query("best_threshold", with_split(_SWEEP_SQL + """
SELECT ROUND(threshold, 6) AS threshold, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
       ROUND(f1, 6) AS f1 FROM sw ORDER BY f1 DESC, threshold ASC LIMIT 1
"""))
def q_best_threshold(spark, sf_dir):
    return normalise(M.best_threshold(M.threshold_sweep(oof_rows(spark, sf_dir))))


# --- A15 --------------------------------------------------------------------------
def _mix_sql(x: str) -> str:
    step = lambda v: f"((xor({v} >> 16, {v}) * {M.MIX}) % {M.TWO32})"
    y = step(step(x))
    return f"xor({y} >> 16, {y})"


def poisson_sql(n: str, cell: int, seed: int = C.SEED) -> str:
    u = [f"(({_mix_sql(f'((replicate * 8 + {2 * cell + j}) * {M.GOLDEN} + {seed}) % {M.TWO32}')}) + 0.5) / {float(M.TWO32)}"
         for j in (0, 1)]
    z = f"(sqrt(-2.0 * ln({u[0]})) * cos({2 * math.pi!r} * ({u[1]})))"
    return (f"CASE WHEN replicate = 0 THEN {n} WHEN {n} > 0 THEN greatest(0, floor({n} + sqrt({n}) * {z} "
            f"+ ({z} * {z} - 1.0) / 6.0 + 0.5)) ELSE 0 END")


def boot_sql(cm: str, group: str = "") -> str:
    """CTE ``boot`` (point_estimate, ci_low, ci_high of F1, per group) from a table of counts."""
    g = f"{group}, " if group else ""
    draws = ", ".join(f"{poisson_sql(f'CAST({c} AS DOUBLE)', i)} AS {c}" for i, c in enumerate(M.CELLS))
    return f"""
, draws AS (SELECT {g}replicate, {draws} FROM {cm}, range(0, 1001) r(replicate)),
bf AS (SELECT {g}replicate, COALESCE(CASE WHEN 2 * tp + fp + fn = 0 THEN NULL ELSE 2.0 * tp / (2 * tp + fp + fn) END, 0)
              AS f1 FROM draws),
boot AS (SELECT {g}max(CASE WHEN replicate = 0 THEN f1 END) AS point_estimate,
                quantile_cont(CASE WHEN replicate > 0 THEN f1 END, 0.025) AS ci_low,
                quantile_cont(CASE WHEN replicate > 0 THEN f1 END, 0.975) AS ci_high
         FROM bf {f"GROUP BY {group}" if group else ""})
"""


@query("bootstrap_ci", with_split(", " + _CM_SQL + boot_sql("cm") + """
SELECT ROUND(point_estimate, 6) AS point_estimate, ROUND(ci_low, 6) AS ci_low, ROUND(ci_high, 6) AS ci_high,
       CAST(0.95 AS DOUBLE) AS ci_level, CAST(1000 AS BIGINT) AS n_bootstrap FROM boot
"""))
def q_bootstrap_ci(spark, sf_dir):
    return normalise(M.bootstrap_f1(test_rows(spark, sf_dir)))


# --- A15 for metrics of the scores: intervals from replicate vectors -------------------
_KS_BRIER = """
, each AS (SELECT 'roc_auc' AS metric, CASE WHEN max(P_) > 0 AND max(N_) > 0
                  THEN sum(pos * (N_ - fp) + 0.5 * pos * neg) / (max(P_) * max(N_)) END AS v FROM pts
  UNION ALL SELECT 'average_precision', CASE WHEN max(P_) > 0 AND max(N_) > 0 THEN sum((pos / P_) * (tp / (tp + fp))) END FROM pts
  UNION ALL SELECT 'ks_statistic', CASE WHEN max(P_) > 0 AND max(N_) > 0 THEN max(abs(tp / P_ - fp / N_)) END FROM pts
  UNION ALL SELECT 'brier_score', avg(pow(p - CAST(y AS DOUBLE), 2)) FROM te)
"""


@query("bootstrap_scores", with_split(_points_sql("te") + _KS_BRIER + """
SELECT metric, ROUND(v, 6) AS point_estimate, true AS ordered, CAST(1000 AS BIGINT) AS n_defined, CAST(1000 AS BIGINT) AS n_bootstrap FROM each
"""))
def q_bootstrap_scores(spark, sf_dir):
    """The point estimates, and that each lies within its interval; the intervals' ends are in ``bootstrap_intervals``."""
    b = score_intervals(spark, sf_dir)
    inside = (F.col("ci_low") <= F.col("point_estimate")) & (F.col("point_estimate") <= F.col("ci_high"))
    return normalise(b.select("metric", "point_estimate", inside.alias("ordered"), "n_defined", "n_bootstrap"))


@query("bootstrap_intervals")
def q_bootstrap_intervals(spark, sf_dir):
    return normalise(score_intervals(spark, sf_dir))


def score_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_table(spark, ("score_intervals", *input_state(spark, sf_dir)),
                     lambda: materialize(bootstrap_scores(test_rows(spark, sf_dir))))


# --- A12 / A14: metrics per training fold, then mean/std/n/min/max -------------------
def fold_metrics(sp: DataFrame) -> DataFrame:
    val = sp.filter(~F.col("is_test"))
    cm = M.metrics_from_counts(M.confusion(val, group_cols=["fold"]))
    areas = M.curve_areas(M.curve_points(val, group_cols=["fold"]), ["fold"])
    return cm.join(areas.withColumnRenamed("average_precision", "pr_auc"), "fold", "left")


FOLD_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


@query("fold_metrics", with_split(_points_sql("(SELECT * FROM sp WHERE NOT is_test)", "fold") + f"""
, cmf AS (SELECT fold, count(*) FILTER (WHERE NOT y AND NOT pred) AS tn, count(*) FILTER (WHERE NOT y AND pred) AS fp,
                 count(*) FILTER (WHERE y AND NOT pred) AS fn, count(*) FILTER (WHERE y AND pred) AS tp
          FROM sp WHERE NOT is_test GROUP BY fold),
aucf AS (SELECT fold, CASE WHEN max(P_) > 0 AND max(N_) > 0
                          THEN sum(pos * (N_ - fp) + 0.5 * pos * neg) / (max(P_) * max(N_)) END AS roc_auc,
                CASE WHEN max(P_) > 0 AND max(N_) > 0 THEN sum((pos / P_) * (tp / (tp + fp))) END AS pr_auc
         FROM pts GROUP BY fold)
SELECT CAST(cmf.fold AS BIGINT) AS fold, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tp AS BIGINT) AS tp, {_METRIC_EXPRS}, ROUND(roc_auc, 6) AS roc_auc, ROUND(pr_auc, 6) AS pr_auc
FROM cmf LEFT JOIN aucf ON cmf.fold = aucf.fold
"""))
def q_fold_metrics(spark, sf_dir):
    return normalise(fold_metrics(split_scored(spark, sf_dir)))


@query("fold_aggregate", with_split(_points_sql("(SELECT * FROM sp WHERE NOT is_test)", "fold") + f"""
, cmf AS (SELECT fold, count(*) FILTER (WHERE NOT y AND NOT pred) AS tn, count(*) FILTER (WHERE NOT y AND pred) AS fp,
                 count(*) FILTER (WHERE y AND NOT pred) AS fn, count(*) FILTER (WHERE y AND pred) AS tp
          FROM sp WHERE NOT is_test GROUP BY fold),
aucf AS (SELECT fold, CASE WHEN max(P_) > 0 AND max(N_) > 0
                          THEN sum(pos * (N_ - fp) + 0.5 * pos * neg) / (max(P_) * max(N_)) END AS roc_auc,
                CASE WHEN max(P_) > 0 AND max(N_) > 0 THEN sum((pos / P_) * (tp / (tp + fp))) END AS pr_auc
         FROM pts GROUP BY fold),
fm AS (SELECT cmf.fold,
         COALESCE(CASE WHEN tn+fp+fn+tp = 0 THEN NULL ELSE (tp+tn) / (tn+fp+fn+tp) END, 0) AS accuracy,
         COALESCE(CASE WHEN tp+fp = 0 THEN NULL ELSE tp / (tp+fp) END, 0) AS precision,
         COALESCE(CASE WHEN tp+fn = 0 THEN NULL ELSE tp / (tp+fn) END, 0) AS recall,
         COALESCE(CASE WHEN 2*tp+fp+fn = 0 THEN NULL ELSE 2*tp / (2*tp+fp+fn) END, 0) AS f1,
         roc_auc, pr_auc
       FROM cmf LEFT JOIN aucf ON cmf.fold = aucf.fold),
lng AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM fm" for m in FOLD_METRICS)})
SELECT metric, ROUND(avg(value), 6) AS mean,
       ROUND(CASE WHEN count(value) > 1 THEN stddev_samp(value) WHEN count(value) = 1 THEN 0.0 END, 6) AS std,
       CAST(count(value) AS BIGINT) AS n_folds, ROUND(min(value), 6) AS min, ROUND(max(value), 6) AS max
FROM lng GROUP BY metric
"""))
def q_fold_aggregate(spark, sf_dir):
    fm = fold_metrics(split_scored(spark, sf_dir))
    return normalise(M.fold_aggregate(fm, FOLD_METRICS))


# --- P9 / J2: error table on the holdout ------------------------------------------------
def error_table(te: DataFrame, features: list[str], id_col: str = C.ID, keep: list[str] | None = None) -> DataFrame:
    """Features + id (and ``keep``), actual and predicted text labels, probability, outcome."""
    return te.select(
        *(keep or []), id_col, *features,
        label_text("y").alias("actual_label"),
        label_text("pred").alias("predicted_label"),
        F.col("p").alias("model_probability"),
        outcome("y", "pred").alias("outcome"),
    )


_ERR_SQL = f"""
, et AS (SELECT neo_id, {_FEATS},
                CASE WHEN y THEN 'potentially_hazardous' ELSE 'not_hazardous' END AS actual_label,
                CASE WHEN pred THEN 'potentially_hazardous' ELSE 'not_hazardous' END AS predicted_label,
                p AS model_probability,
                CASE WHEN y AND pred THEN 'true_positive' WHEN NOT y AND NOT pred THEN 'true_negative'
                     WHEN NOT y AND pred THEN 'false_positive' ELSE 'false_negative' END AS outcome
         FROM te)
"""


@query("error_table", with_split(_ERR_SQL + "SELECT neo_id, " + ", ".join(
    f"ROUND({f}, 6) AS {f}" for f in PROFILE_FEATURES) +
    ", actual_label, predicted_label, ROUND(model_probability, 6) AS model_probability, outcome FROM et"))
def q_error_table(spark, sf_dir):
    return normalise(error_table(test_rows(spark, sf_dir), PROFILE_FEATURES))


# --- F6 / L9 ------------------------------------------------------------------------
@query("error_records", with_split(_ERR_SQL + """
SELECT neo_id, outcome, ROUND(model_probability, 6) AS model_probability FROM et
WHERE outcome = 'false_positive' ORDER BY model_probability DESC NULLS LAST, neo_id LIMIT 50
"""))
def q_error_records(spark, sf_dir):
    et = error_table(test_rows(spark, sf_dir), PROFILE_FEATURES)
    return normalise(error_records(et, "false_positive", 50))


def error_records(et: DataFrame, which: str, limit: int = 50, id_col: str = C.ID) -> DataFrame:
    """F6 + L9: rows of one outcome, most confident first, at most ``limit``."""
    return et.filter(F.col("outcome") == which).orderBy(
        F.col("model_probability").desc_nulls_last(), F.col(id_col)).limit(limit).select(
        id_col, "outcome", "model_probability")


def grouped_error_records(et: DataFrame, group_cols: list[str], limit: int = 50, id_col: str = C.ID) -> DataFrame:
    """F6 + L9 for both kinds of error of every group. Spark keeps the first
    ``limit`` rows of each window before the shuffle (a group limit)."""
    w = Window.partitionBy(*group_cols, "outcome").orderBy(F.col("model_probability").desc_nulls_last(), F.col(id_col))
    return (et.filter(F.col("outcome").isin("false_positive", "false_negative"))
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
            .select(*group_cols, id_col, "outcome", "model_probability"))


# --- A13 / U3 / R9 ------------------------------------------------------------------
def error_profile(et: DataFrame, features: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """Per outcome and feature (and group): count, mean, median, sample std (0
    for one value), min, max; nulls skipped; plus n_rows of the outcome.
    Medians are exact; their rows are not stacked by feature."""
    g = [*(group_cols or []), "outcome"]
    aggs = []
    for i, f in enumerate(features):
        v = F.col(f).cast("double")
        aggs += [F.count(v).cast("bigint").alias(f"_n{i}"), F.avg(v).alias(f"_m{i}"), F.stddev_samp(v).alias(f"_s{i}"),
                 F.min(v).alias(f"_l{i}"), F.max(v).alias(f"_h{i}")]
    wide = et.groupBy(*g).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), *aggs)
    stats = wide.select(*g, "n_rows", F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"_n{i}").alias("count"), F.col(f"_m{i}").alias("mean"),
        F.when(F.col(f"_n{i}") > 1, F.col(f"_s{i}")).otherwise(F.lit(0.0)).alias("std"),
        F.col(f"_l{i}").alias("min"), F.col(f"_h{i}").alias("max")) for i, f in enumerate(features)])).alias("s")
    ).select(*g, "s.*", "n_rows").filter(F.col("count") > 0)
    med = grouped_medians(et, g, features).withColumnRenamed("value", "median")
    return stats.join(F.broadcast(med), [*g, "feature"], "left").select(
        *g, "feature", "count", "mean", "std", "min", "max", "median", "n_rows")


@query("error_profile", with_split(_ERR_SQL + ", lng AS (" + " UNION ALL ".join(
    f"SELECT outcome, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM et" for f in PROFILE_FEATURES) + """),
nr AS (SELECT outcome, count(*) AS n_rows FROM et GROUP BY outcome)
SELECT l.outcome, feature, CAST(count(*) AS BIGINT) AS count, ROUND(avg(value), 6) AS mean,
       ROUND(CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0.0 END, 6) AS std,
       ROUND(min(value), 6) AS min, ROUND(max(value), 6) AS max, ROUND(median(value), 6) AS median,
       CAST(max(nr.n_rows) AS BIGINT) AS n_rows
FROM lng l JOIN nr ON l.outcome = nr.outcome WHERE value IS NOT NULL GROUP BY l.outcome, feature
"""))
def q_error_profile(spark, sf_dir):
    et = error_table(test_rows(spark, sf_dir), PROFILE_FEATURES)
    return normalise(error_profile(et, PROFILE_FEATURES))


@query("error_profile_matrix", with_split(_ERR_SQL + """
SELECT outcome, """ + ", ".join(f"ROUND(avg({f}), 6) AS {f}" for f in PROFILE_FEATURES) + """
FROM et GROUP BY outcome
"""))
def q_error_profile_matrix(spark, sf_dir):
    """Mean feature value by outcome, features as columns (pivot of A13)."""
    et = error_table(test_rows(spark, sf_dir), PROFILE_FEATURES)
    prof = error_profile(et, PROFILE_FEATURES)
    return normalise(prof.groupBy("outcome").pivot("feature", PROFILE_FEATURES).agg(F.first("mean")))


@query("error_features", with_split(_ERR_SQL + ", lng AS (" + " UNION ALL ".join(
    f"SELECT outcome, '{f}' AS feature FROM et WHERE {f} IS NOT NULL" for f in PROFILE_FEATURES) + """)
SELECT DISTINCT feature FROM lng ORDER BY feature
"""))
def q_error_features(spark, sf_dir):
    """Feature names present over all outcomes, union, sorted."""
    et = error_table(test_rows(spark, sf_dir), PROFILE_FEATURES)
    prof = error_profile(et, PROFILE_FEATURES)
    parts = [prof.filter(F.col("outcome") == o).select("feature") for o in C.OUTCOMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct().orderBy("feature")
