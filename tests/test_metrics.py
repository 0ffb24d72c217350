import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from leakscope.operators import metrics as M
from leakscope.plans.q_metrics import error_profile, error_records, error_table


def _pred(spark, y, pred, p=None):
    p = p or [None] * len(y)
    return spark.createDataFrame([(str(i), bool(a), bool(b), c) for i, (a, b, c) in enumerate(zip(y, pred, p))],
                                 "id STRING, y BOOLEAN, pred BOOLEAN, p DOUBLE")


def test_hand_computed_metrics(spark):
    r = M.metrics_from_counts(M.confusion(_pred(spark, [1, 1, 0, 0], [1, 0, 0, 0]))).first()
    assert (r["accuracy"], r["precision"], r["recall"]) == (0.75, 1.0, 0.5)
    assert (r["tp"], r["fn"], r["tn"], r["fp"]) == (1, 1, 2, 0)


def test_zero_denominators_give_zero(spark):
    r = M.metrics_from_counts(M.confusion(_pred(spark, [0, 0], [0, 0]))).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_sweep_keeps_threshold_order_and_recall(spark):
    df = _pred(spark, [1, 0, 1, 0, 1], [0] * 5, [0.9, 0.2, 0.6, 0.4, 0.55])
    rows = M.threshold_sweep(df, thresholds=[0.1, 0.5, 0.9]).orderBy("threshold").collect()
    assert [r["threshold"] for r in rows] == [0.1, 0.5, 0.9]
    assert rows[0]["recall"] == 1.0
    assert rows[1]["precision"] == 1.0 and rows[1]["recall"] == 1.0
    assert rows[2]["recall"] == pytest.approx(1 / 3)
    best = M.best_threshold(M.threshold_sweep(df, thresholds=[0.1, 0.5, 0.9])).first()
    assert best["threshold"] == 0.5


def test_auc_matches_spark_evaluator_with_ties(spark):
    y = [1, 0, 1, 0, 1, 1, 0, 0, 1, 0]
    p = [0.9, 0.2, 0.6, 0.6, 0.55, 0.3, 0.3, 0.1, 0.9, 0.9]
    df = _pred(spark, y, [0] * 10, p)
    ours = M.roc_auc(df).first()["roc_auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", metricName="areaUnderROC", numBins=0)
    assert ours == pytest.approx(ev.evaluate(df.withColumn("label", F.col("y").cast("double"))))
    pts = M.roc_curve(df).collect()
    assert any(r["threshold"] is None and r["fpr"] == 0.0 and r["tpr"] == 0.0 for r in pts)
    assert max(r["tpr"] for r in pts) == 1.0


def test_average_precision_is_step_sum_not_trapezoid(spark):
    df = _pred(spark, [1, 0, 1, 0, 1], [0] * 5, [0.9, 0.2, 0.6, 0.4, 0.55])
    ap = M.average_precision(df).first()["average_precision"]
    assert ap == pytest.approx(1.0)
    df2 = _pred(spark, [0, 1, 0, 1, 1], [0] * 5, [0.9, 0.8, 0.7, 0.2, 0.1])
    ap2 = M.average_precision(df2).first()["average_precision"]
    assert ap2 == pytest.approx((1 / 3) * (1 / 2) + (1 / 3) * (2 / 4) + (1 / 3) * (3 / 5))
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", metricName="areaUnderPR", numBins=0)
    assert ap2 != pytest.approx(ev.evaluate(df2.withColumn("label", F.col("y").cast("double"))))


def test_one_class_gives_null_auc(spark):
    df = _pred(spark, [1, 1], [1, 1], [0.2, 0.8])
    assert M.roc_auc(df).first()["roc_auc"] is None
    assert M.roc_curve(df).count() == 0


def test_bootstrap_brackets_point(spark):
    import random
    rnd = random.Random(0)
    y = [rnd.random() < 0.4 for _ in range(200)]
    pred = [a if rnd.random() > 0.2 else not a for a in y]
    r = M.bootstrap_f1(_pred(spark, y, pred), n_boot=200).first()
    assert r["ci_low"] <= r["point_estimate"] <= r["ci_high"]
    empty = M.bootstrap_f1(_pred(spark, [], []).limit(0), n_boot=10).first()
    assert empty["point_estimate"] is None and empty["ci_low"] is None


def test_calibration_quantile_bins(spark):
    p = [i / 100 for i in range(100)]
    y = [i % 3 == 0 for i in range(100)]
    rows = M.calibration(_pred(spark, y, [0] * 100, p)).collect()
    assert len(rows) == 10 and sum(r["n"] for r in rows) == 100


def test_error_outcomes_and_profile(spark):
    df = spark.createDataFrame([("1", True, True, 0.9, 10.0), ("2", True, False, 0.4, 20.0),
                                ("3", False, True, 0.6, 30.0), ("4", False, False, 0.1, 40.0)],
                               "neo_id STRING, y BOOLEAN, pred BOOLEAN, p DOUBLE, f DOUBLE")
    et = error_table(df, ["f"])
    got = {r["neo_id"]: r["outcome"] for r in et.collect()}
    assert got == {"1": "true_positive", "2": "false_negative", "3": "false_positive", "4": "true_negative"}
    prof = {r["outcome"]: r for r in error_profile(et, ["f"]).collect()}
    assert prof["true_positive"]["mean"] == 10.0 and prof["false_negative"]["mean"] == 20.0
    assert prof["true_positive"]["std"] == 0.0 and prof["true_positive"]["n_rows"] == 1
    assert [r["neo_id"] for r in error_records(et, "false_positive").collect()] == ["3"]


def test_fold_aggregate_one_fold_std_zero(spark):
    fm = spark.createDataFrame([(1, 0.5), (2, 0.7)], "fold INT, f1 DOUBLE")
    r = M.fold_aggregate(fm, ["f1"]).first()
    assert r["mean"] == pytest.approx(0.6) and r["std"] == pytest.approx(0.1414213562)
    one = M.fold_aggregate(fm.limit(1), ["f1"]).first()
    assert one["std"] == 0.0 and one["n_folds"] == 1


def test_cells_of_scores_give_what_the_rows_give(spark):
    """Alike scores counted once: every measure equals that of the rows, with nulls and ties."""
    rng = np.random.default_rng(5)
    rows = [(["a", "b"][int(i % 3 == 0)], bool(rng.random() < 0.4), None if i % 17 == 0 else round(float(rng.random()), 2),
             bool(rng.random() < 0.5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g STRING, y BOOLEAN, p DOUBLE, pred BOOLEAN")
    cells = M.score_cells(df, ["g", "y", "p", "pred"])
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(M.confusion(df, group_cols=["g"]), M.confusion(cells, group_cols=["g"], n="n"))
    assert same(M.curve_points(df, group_cols=["g"]), M.curve_points(cells, group_cols=["g"], n="n"))
    assert same(M.threshold_sweep(df, group_cols=["g"]), M.threshold_sweep(cells, group_cols=["g"], n="n"))
    got = {(r["g"], r["bin"]): r for r in M.calibration(cells, group_cols=["g"], n="n").collect()}
    seen = 0
    for g in "ab":
        own = [(y, p) for k, y, p, _ in rows if k == g and p is not None]
        edges = np.percentile([p for _, p in own], [10 * i for i in range(1, 10)])
        for b in range(10):
            part = [(y, p) for y, p in own if (edges < p).sum() == b]
            if part:
                r = got[g, b]
                seen += 1
                assert r["n"] == len(part)
                assert abs(r["prob_true"] - np.mean([y for y, _ in part])) < 1e-12
                assert abs(r["prob_pred"] - np.mean([p for _, p in part])) < 1e-12
    assert seen == len(got)


def test_grouped_medians_equal_numpy(spark):
    """Groups of one row, ties, nulls and NaN; a feature that a group lacks has no row."""
    from leakscope.operators.rank import grouped_medians
    rng = np.random.default_rng(6)
    rows = [("big", float(v), float(i % 4)) for i, v in enumerate(rng.normal(size=5001))] + [
        ("big", None, float("nan")), ("one", 2.5, None), ("two", 1.0, 7.0), ("two", 2.0, 7.0)]
    got = {(r["g"], r["feature"]): r["value"] for r in grouped_medians(
        spark.createDataFrame(rows, "g STRING, a DOUBLE, b DOUBLE"), ["g"], ["a", "b"]).collect()}
    want = {}
    for g in ("big", "one", "two"):
        for i, f in ((1, "a"), (2, "b")):
            own = [r[i] for r in rows if r[0] == g and r[i] is not None and not np.isnan(r[i])]
            if own:
                want[g, f] = float(np.median(own))
    assert got == want


def test_artifacts_read_features_of_holdout_rows_only(spark):
    from leakscope.plans.experiment import artifacts_from_scores
    rows = [("e", "m", "oof" if i % 3 else "holdout", i % 2 if i % 3 else None, str(i), i % 4 == 0, i / 40, i >= 20) for i in range(40)]
    scored = spark.createDataFrame(rows, "experiment STRING, model STRING, part STRING, fold INT, neo_id STRING, y BOOLEAN, p DOUBLE, pred BOOLEAN")
    held = scored.filter("part = 'holdout'").withColumn("f", scored["p"] * 2)
    out = artifacts_from_scores(scored, ["f"], rows=held)
    assert out["predictions"].count() == 14 and out["error_analysis"].count() > 0
    cm = out["confusion_matrix"].first()
    assert cm["tn"] + cm["fp"] + cm["fn"] + cm["tp"] == 14
    assert sum(r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in out["fold_metrics"].collect()) == 26
