"""Classification metrics over a prediction table with a boolean label
``y``, a boolean prediction ``pred`` and an optional score ``p``.

Everything is a DataFrame aggregate. Curves reduce the rows to one row per
distinct score first (a partial aggregate: skew-safe), then take running
sums with the bucketed primitive; no unpartitioned window ever sees data
rows. Metric rows may be grouped by ``group_cols`` (fold, model, ...).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators.rank import counted_quantiles, exact_quantiles, running_totals


def _z(c: Column) -> Column:
    """A ratio with a zero denominator is 0, as in the audited metrics."""
    return F.coalesce(c, F.lit(0.0))


def _rows(of: Column, n: str | None) -> Column:
    """Rows for which ``of`` holds; each counts ``n`` times where that column is given."""
    return F.count_if(of).cast("bigint") if n is None else F.coalesce(F.sum(F.when(of, F.col(n))), F.lit(0)).cast("bigint")


def score_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that are alike in ``cols``, with their number ``n``: what every measure of
    the scores needs of them."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", group_cols: list[str] | None = None,
              n: str | None = None) -> DataFrame:
    """Tn, fp, fn, tp in one pass; zeros are always emitted."""
    yc, pc = F.col(y), F.col(pred)
    aggs = [
        _rows(~yc & ~pc, n).alias("tn"),
        _rows(~yc & pc, n).alias("fp"),
        _rows(yc & ~pc, n).alias("fn"),
        _rows(yc & pc, n).alias("tp"),
    ]
    return df.groupBy(*(group_cols or [])).agg(*aggs)


def metrics_from_counts(cm: DataFrame) -> DataFrame:
    """A7 + A23 from confusion counts."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    precision = _z(F.try_divide(tp, tp + fp))
    recall = _z(F.try_divide(tp, tp + fn))
    f1 = _z(F.try_divide(2 * tp, 2 * tp + fp + fn))
    return cm.select(
        "*",
        _z(F.try_divide(tp + tn, n)).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
    )


def confusion_shares(cm: DataFrame) -> DataFrame:
    """Each cell as a share of all rows and of its actual class, and
    prevalence."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return cm.select(
        "*",
        F.try_divide(tn, n).alias("tn_share"), F.try_divide(fp, n).alias("fp_share"),
        F.try_divide(fn, n).alias("fn_share"), F.try_divide(tp, n).alias("tp_share"),
        F.try_divide(tn, tn + fp).alias("tn_row_share"), F.try_divide(fp, tn + fp).alias("fp_row_share"),
        F.try_divide(fn, fn + tp).alias("fn_row_share"), F.try_divide(tp, fn + tp).alias("tp_row_share"),
        F.try_divide(tp + fn, n).alias("prevalence"),
    )


def score_counts(df: DataFrame, y: str = "y", p: str = "p", group_cols: list[str] | None = None,
                 n: str | None = None) -> DataFrame:
    """One row per (group, distinct score): positives and negatives."""
    g = group_cols or []
    return df.filter(F.col(p).isNotNull()).groupBy(*g, F.col(p).alias("score")).agg(
        _rows(F.col(y), n).alias("pos"),
        _rows(~F.col(y), n).alias("neg"),
    )


def curve_points(df: DataFrame, y: str = "y", p: str = "p", group_cols: list[str] | None = None,
                 n: str | None = None) -> DataFrame:
    """Per distinct score, descending: cumulative tp/fp at ``score >= s`` and
    the class totals. The basis of W2, W3, A8, A9."""
    g = group_cols or []
    gk = g or ["_g"]
    base = df if g else df.withColumn("_g", F.lit(0))
    sc = score_counts(base, y, p, gk, n)
    cum = running_totals(sc, gk, "score", ["pos", "neg"], descending=True)
    # one row per group (folds x models at most): broadcast
    totals = sc.groupBy(*gk).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = cum.join(F.broadcast(totals), gk, "inner")
    return j.select(*g, "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "P", "N")


def roc_from_points(pts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """W2 from curve points; groups with one class only have no points."""
    g = group_cols or []
    pts = pts.filter((F.col("P") > 0) & (F.col("N") > 0))
    body = pts.select(*g, F.col("score").alias("threshold"),
                      (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))
    # grouped even without group columns: an empty curve yields no start row
    start = pts.withColumn("_g", F.lit(0)).groupBy(*g, "_g").agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).drop("_g")
    return body.unionByName(start)


def pr_from_points(pts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """W3 from curve points."""
    g = group_cols or []
    pts = pts.filter((F.col("P") > 0) & (F.col("N") > 0))
    body = pts.select(*g, F.col("score").alias("threshold"),
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                      (F.col("tp") / F.col("P")).alias("recall"))
    end = pts.withColumn("_g", F.lit(0)).groupBy(*g, "_g").agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall")).drop("_g")
    return body.unionByName(end)


def curve_areas(pts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A8 and A9 from curve points in one aggregate: exact area under the ROC
    (trapezoids over tied score groups) and step-sum average precision,
    sum((R_i - R_{i-1}) * P_i); null when a group has one class only."""
    g = group_cols or []
    # negatives strictly above s = fp - neg; each positive at s beats those
    # below and ties half: area = sum(pos * (N - fp) + 0.5 * pos * neg) / (P N)
    part = pts.groupBy(*g).agg(
        F.sum(F.col("pos") * (F.col("N") - F.col("fp")) + 0.5 * F.col("pos") * F.col("neg")).alias("_a"),
        F.sum(F.try_divide("pos", "P") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("_ap"),
        F.first("P").alias("P"), F.first("N").alias("N"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return part.select(*g, F.when(both, F.col("_a") / (F.col("P") * F.col("N"))).alias("roc_auc"),
                       F.when(both, F.col("_ap")).alias("average_precision"))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", group_cols: list[str] | None = None) -> DataFrame:
    """(fpr, tpr, threshold) per distinct score, plus the (0, 0) start
    with a null threshold. All points are kept. Null when one class only."""
    pts = curve_points(df, y, p, group_cols)
    return roc_from_points(pts, group_cols)


def pr_curve(df: DataFrame, y: str = "y", p: str = "p", group_cols: list[str] | None = None) -> DataFrame:
    """(precision, recall, threshold) per distinct score, plus the final
    point recall 0, precision 1 with a null threshold."""
    pts = curve_points(df, y, p, group_cols)
    return pr_from_points(pts, group_cols)


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", group_cols: list[str] | None = None) -> DataFrame:
    """A8."""
    return curve_areas(curve_points(df, y, p, group_cols), group_cols).drop("average_precision")


def average_precision(df: DataFrame, y: str = "y", p: str = "p", group_cols: list[str] | None = None) -> DataFrame:
    """A9. Not the trapezoid areaUnderPR."""
    return curve_areas(curve_points(df, y, p, group_cols), group_cols).drop("roc_auc")


def brier(df: DataFrame, y: str = "y", p: str = "p", group_cols: list[str] | None = None) -> DataFrame:
    """A10."""
    return df.groupBy(*(group_cols or [])).agg(
        F.avg(F.pow(F.col(p) - F.col(y).cast("double"), 2)).alias("brier_score"))


def calibration(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 10,
                group_cols: list[str] | None = None, n: str | None = None) -> DataFrame:
    """Quantile bins (numpy-linear percentiles, exact), bin = number of
    interior edges below p, empty bins dropped; mean label and mean score per
    bin. With groups, rows are reduced to distinct scores first and the edges come
    from their running totals: n_bins - 1 of them for each group, so they are broadcast."""
    g = group_cols or []
    probs = [i / n_bins for i in range(1, n_bins)]
    bins = F.size(F.filter("_edges", lambda e: e < F.col(p)))
    if g:
        cells, n = (score_cells(df, [*g, y, p]), "n") if n is None else (df, n)
        edges = counted_quantiles(cells, g, p, n, probs)
        yc, pc, nc = F.col(y).cast("double"), F.col(p), F.col(n)
        return cells.join(F.broadcast(edges), g).filter(pc.isNotNull()).groupBy(*g, bins.alias("bin")).agg(
            F.sum(nc).cast("bigint").alias("n"),
            F.try_divide(F.sum(yc * nc), F.sum(F.when(yc.isNotNull(), nc))).alias("prob_true"),
            F.try_divide(F.sum(pc * nc), F.sum(nc)).alias("prob_pred"),
        )
    binned = df.withColumn("_edges", F.array(*[F.lit(e).cast("double") for e in exact_quantiles(df, p, probs)[1]]))
    return binned.filter(F.col(p).isNotNull()).groupBy(bins.alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg(F.col(y).cast("double")).alias("prob_true"),
        F.avg(F.col(p)).alias("prob_pred"),
    )


def threshold_sweep(df: DataFrame, y: str = "y", p: str = "p", thresholds: list[float] | None = None,
                    group_cols: list[str] | None = None, n: str | None = None) -> DataFrame:
    """Precision, recall, F1 of ``p >= t`` for each threshold.

    Each row goes to bucket = number of thresholds <= p; class counts per
    bucket (at most 20 rows per group) are suffix-summed. No data row is
    repeated per threshold."""
    ts = sorted(thresholds or C.THRESHOLD_GRID)
    g = group_cols or []
    gk = g or ["_g"]
    base = df if g else df.withColumn("_g", F.lit(0))
    bucket = F.lit(0)
    for t in ts:
        bucket = bucket + F.when(F.col(p) >= F.lit(t), 1).otherwise(0)
    counts = base.filter(F.col(p).isNotNull()).groupBy(*gk, bucket.alias("_b")).agg(
        _rows(F.col(y), n).alias("pos"), _rows(~F.col(y), n).alias("neg"))
    # bucket b counts toward every threshold j <= b (suffix sums over <= 20 rows)
    per = counts.filter(F.col("_b") >= 1).select(
        *gk, F.explode(F.sequence(F.lit(1), F.col("_b"))).alias("_j"), "pos", "neg")
    agg = per.groupBy(*gk, "_j").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("_j"), F.lit(float(t)).alias("threshold"))
                     for i, t in enumerate(ts)])
    full = counts.groupBy(*gk).agg(F.sum("pos").alias("P")).select(*gk, "P", F.explode(grid).alias("_t")) \
        .select(*gk, "P", "_t._j", "_t.threshold")
    res = full.join(agg, [*gk, "_j"], "left").fillna(0, ["tp", "fp"])
    tp, fp, P = (F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("P").cast("double"))
    return res.select(
        *g, "threshold",
        _z(F.try_divide(tp, tp + fp)).alias("precision"),
        _z(F.try_divide(tp, P)).alias("recall"),
        _z(F.try_divide(2 * tp, tp + fp + P)).alias("f1"),
    )


def best_threshold(sweep: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Best F1, the lowest threshold among equals."""
    g = group_cols or []
    if not g:
        return sweep.orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)
    w = Window.partitionBy(*g).orderBy(F.col("f1").desc(), F.col("threshold").asc())
    return sweep.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


MIX = 73244475          # 0x45d9f3b, a 32-bit integer mixing multiplier
GOLDEN = 2654435761     # 0x9e3779b1
TWO32 = 4294967296


def mix32(x: Column) -> Column:
    """A 32-bit integer hash finaliser on BIGINT arithmetic (no overflow:
    operands stay below 2^59); the same steps run in SQL for the oracle."""
    x = F.pmod(F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MIX), F.lit(TWO32))
    x = F.pmod(F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MIX), F.lit(TWO32))
    return F.shiftright(x, 16).bitwiseXOR(x)


CELLS = ("tn", "fp", "fn", "tp")


def replicate_uniform(draw: Column, seed: int) -> Column:
    """Uniform in (0, 1) for a numbered draw: integer mixing, no row data."""
    return (mix32(F.pmod(draw * F.lit(GOLDEN) + F.lit(seed), F.lit(TWO32))) + F.lit(0.5)) / F.lit(float(TWO32))


def poisson_draw(n: Column, u1: Column, u2: Column) -> Column:
    """Poisson(n) from two uniforms: a normal draw with the second-order
    (Cornish-Fisher) term of the Poisson quantile, floored at 0."""
    z = F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.floor(n + F.sqrt(n) * z + (z * z - 1.0) / 6.0 + 0.5).cast("double"))) \
        .otherwise(F.lit(0.0))


def f1_of_counts(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return _z(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn))


def bootstrap_counts(cm: DataFrame, metric=f1_of_counts, n_boot: int = 1000, ci: float = 0.95, seed: int = C.SEED,
                     group_cols: list[str] | None = None) -> DataFrame:
    """A15 for any metric of the four counts: a Poisson bootstrap gives every
    row a Poisson(1) weight, and the weights of a cell's n rows add up to
    Poisson(n). So each replicate draws four numbers from the counts and no
    data row is touched again. ``metric`` maps the columns tn, fp, fn, tp to
    the metric. Nulls on empty input."""
    g = group_cols or []
    reps = cm.select(*g, *[F.col(c).cast("double").alias(c) for c in CELLS],
                     F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_boot).cast("bigint"))).alias("replicate"))
    draw = lambda i, j: replicate_uniform(F.col("replicate") * 8 + (2 * i + j), seed)
    drawn = reps.select(*g, "replicate", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") > 0).alias("_any"), *[
        F.when(F.col("replicate") == 0, F.col(c)).otherwise(poisson_draw(F.col(c), draw(i, 0), draw(i, 1))).alias(c)
        for i, c in enumerate(CELLS)])
    value = drawn.select(*g, "replicate", "_any", metric(*[F.col(c) for c in CELLS]).alias("_m"))
    alpha = (1.0 - ci) / 2.0
    of_rep = F.when(F.col("_any") & (F.col("replicate") > 0), F.col("_m"))
    return value.groupBy(*g).agg(
        F.max(F.when(F.col("_any") & (F.col("replicate") == 0), F.col("_m"))).alias("point_estimate"),
        F.percentile(of_rep, alpha).alias("ci_low"), F.percentile(of_rep, 1 - alpha).alias("ci_high"),
    ).select(*g, "point_estimate", "ci_low", "ci_high", F.lit(ci).alias("ci_level"),
             F.lit(n_boot).cast("bigint").alias("n_bootstrap"))


def bootstrap_f1(df: DataFrame, y: str = "y", pred: str = "pred", n_boot: int = 1000,
                 ci: float = 0.95, seed: int = C.SEED) -> DataFrame:
    """A15 for F1 over a prediction table: one confusion aggregate."""
    return bootstrap_counts(confusion(df, y, pred), f1_of_counts, n_boot, ci, seed)


def fold_aggregate(fold_metrics: DataFrame, metrics: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """Per metric mean, sample std (0 with one fold), n, min, max;
    nulls ignored."""
    g = group_cols or []
    long = fold_metrics.select(*g, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")
    ).select(*g, "s.metric", "s.value")
    return long.groupBy(*g, "metric").agg(
        F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).when(F.count("value") == 1, F.lit(0.0)).alias("std"),
        F.count("value").cast("bigint").alias("n_folds"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
