import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.operators import bootstrap as B
from leakscope.operators import metrics as M


def scored(spark, n=400, groups=2):
    u = (F.xxhash64("id") % 1000 + 1000) / 2000
    return spark.range(n).select(
        (F.col("id") % groups).cast("string").alias("g"), (F.floor(u * 40) / 40).alias("p"),
        ((F.xxhash64("id", F.lit(1)) % 1000 + 1000) / 2000 < u).alias("y"))


def plain(rows, n_boot, seed):
    """Replicate values of each metric, from weighted rows one replicate at a time."""
    scores = np.array(sorted({p for p, _ in rows}, reverse=True))
    pos = np.array([sum(1 for p, y in rows if p == s and y) for s in scores])
    neg = np.array([sum(1 for p, y in rows if p == s and not y) for s in scores])
    wp, wn = (B.weights(scores, c, k, n_boot, seed) for k, c in enumerate((pos, neg)))
    out = {m.name: [] for m in B.METRICS}
    for b in range(n_boot + 1):
        P, N, tp, fp = wp[:, b].sum(), wn[:, b].sum(), 0.0, 0.0
        auc = ap = brier = ks = 0.0
        for s, a, c in zip(scores, wp[:, b], wn[:, b]):
            tp, fp = tp + a, fp + c
            auc += a * (N - fp) + a * c / 2
            ap += a / P * (tp / (tp + fp)) if a else 0
            brier += a * (1 - s) ** 2 + c * s ** 2
            ks = max(ks, abs(tp / P - fp / N))
        for k, v in zip(out, (auc / (P * N), ap, brier / (P + N), ks)):
            out[k].append(v)
    return out


def test_intervals_equal_the_replicates_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(B, "PER_PARTITION", 7)  # many partitions: running totals between them
    monkeypatch.setattr(B, "CHUNK", 3)
    df = scored(spark).cache()
    got = {(r["g"], r["metric"]): r for r in B.bootstrap_scores(df, n_boot=60, seed=5, group_cols=["g"]).collect()}
    assert len(got) == 2 * len(B.METRICS)
    for g in ("0", "1"):
        want = plain([(r["p"], r["y"]) for r in df.where(F.col("g") == g).collect()], 60, 5)
        for name, values in want.items():
            r = got[g, name]
            assert r["point_estimate"] == pytest.approx(values[0], abs=1e-12) and r["n_defined"] == 60
            assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(values[1:], [0.025, 0.975])), abs=1e-12)


def test_points_equal_the_plain_operators_and_do_not_depend_on_partitions(spark, monkeypatch):
    df = scored(spark, 2000, 1).drop("g").cache()
    one = {r["metric"]: r for r in B.bootstrap_scores(df, n_boot=50).collect()}
    assert one["roc_auc"]["point_estimate"] == pytest.approx(M.roc_auc(df).first()["roc_auc"])
    assert one["average_precision"]["point_estimate"] == pytest.approx(M.average_precision(df).first()["average_precision"])
    assert one["brier_score"]["point_estimate"] == pytest.approx(M.brier(df).first()["brier_score"])
    for r in one.values():
        assert r["ci_low"] <= r["point_estimate"] <= r["ci_high"] and r["ci_low"] < r["ci_high"]
    monkeypatch.setattr(B, "PER_PARTITION", 5)
    for r in B.bootstrap_scores(df.repartition(7), n_boot=50).collect():
        assert r["ci_low"] == pytest.approx(one[r["metric"]]["ci_low"]) and r["ci_high"] == pytest.approx(one[r["metric"]]["ci_high"])


def test_one_class_missing_scores_empty_input_and_an_own_metric(spark):
    df = scored(spark, 50, 1).drop("g")
    got = {r["metric"]: r for r in B.bootstrap_scores(df.where("y").union(df.limit(3).selectExpr("cast(null as double)", "false")), n_boot=20).collect()}
    assert got["roc_auc"]["point_estimate"] is None and got["roc_auc"]["n_defined"] == 0 and got["roc_auc"]["ci_low"] is None
    assert got["brier_score"]["n_defined"] == 20
    assert B.bootstrap_scores(df.where("false"), n_boot=20).count() == 0
    recall = B.metric_at(0.5, "recall", lambda t, P, N: F.try_divide(t, P))
    r = B.bootstrap_scores(df, metrics=(recall,), n_boot=100).first()
    own = df.agg(F.avg(F.when(F.col("y"), (F.col("p") >= 0.5).cast("double"))).alias("r")).first()["r"]
    assert r["metric"] == "recall" and r["point_estimate"] == pytest.approx(own) and r["ci_low"] <= own <= r["ci_high"]
