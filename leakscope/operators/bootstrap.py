"""A15 for metrics of the scores themselves: Poisson bootstrap by running
totals of replicate vectors.

A replicate gives each row a Poisson(1) weight, so the positives and the
negatives of a distinct score weigh Poisson(pos) and Poisson(neg). Rows are
reduced to distinct scores once. Scores are range-partitioned in descending
order; a first pass sums the weights of all replicates per partition, whose
running totals say what stands above each partition; a second pass adds up
each metric's terms with the cumulative weights at hand. Both draw the same
weights from a counter-based generator keyed by (seed, score), so nothing but
the narrow score table and one vector per partition moves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators.metrics import score_counts
from leakscope.session import materialize

CHUNK = 256  # scores whose weights are drawn at once
PER_PARTITION = 200_000  # distinct scores of a partition


@dataclass(frozen=True)
class ScoreMetric:
    """A metric as terms over distinct scores that add up (or, with ``largest``,
    whose maximum counts).

    ``terms`` maps (score, pos, neg, tp, fp, P, N) to an array: all but score are
    weights with one column per replicate, score is a column of its own; tp and
    fp count the weights at the score or above, P and N all. ``finish`` maps the
    columns (total, P, N) to the metric; null is "undefined", as for one class.
    """
    name: str
    terms: Callable
    finish: Callable
    largest: bool = False


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


def _both(value: Column, P: Column, N: Column) -> Column:
    return F.when((P > 0) & (N > 0), value)


AUC = ScoreMetric("roc_auc", lambda s, pos, neg, tp, fp, P, N: pos * (N - fp) + 0.5 * pos * neg,
                  lambda t, P, N: _both(F.try_divide(t, P * N), P, N))
AVERAGE_PRECISION = ScoreMetric("average_precision", lambda s, pos, neg, tp, fp, P, N: _ratio(pos, P) * _ratio(tp, tp + fp), _both)
BRIER = ScoreMetric("brier_score", lambda s, pos, neg, tp, fp, P, N: pos * (1 - s) ** 2 + neg * s ** 2,
                    lambda t, P, N: F.try_divide(t, P + N))
KS = ScoreMetric("ks_statistic", lambda s, pos, neg, tp, fp, P, N: np.abs(_ratio(tp, P) - _ratio(fp, N)), _both, largest=True)
METRICS = (AUC, AVERAGE_PRECISION, BRIER, KS)


def metric_at(threshold: float, name: str, finish: Callable) -> ScoreMetric:
    """A metric of the positives found at ``threshold``: ``finish`` gets the true positives' weight as its total."""
    return ScoreMetric(name, lambda s, pos, neg, tp, fp, P, N: pos * (s >= threshold), finish)


def weights(scores: np.ndarray, counts: np.ndarray, side: int, n_boot: int, seed: int) -> np.ndarray:
    """(scores, n_boot + 1) weights; column 0 is the counts themselves. They depend
    on the score, its count and the seed alone."""
    out = np.zeros((len(scores), n_boot + 1))
    out[:, 0] = counts
    for i in np.flatnonzero(counts):
        key = np.array([(seed << 1) + side, np.float64(scores[i] + 0.0).view(np.uint64)], np.uint64)
        out[i, 1:] = np.random.Generator(np.random.Philox(key=key)).poisson(counts[i], n_boot)
    return out


def _runs(batches, n_keys: int):
    """Consecutive rows of one (partition, group) as arrays, in chunks: (key, first of its key, columns)."""
    last = None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(n_keys)]
        rest = [batch.column(i) for i in range(n_keys, batch.num_columns)]
        keys = list(zip(*columns))
        at = 0
        while at < len(keys):
            stop = at
            while stop < len(keys) and keys[stop] == keys[at] and stop - at < CHUNK:
                stop += 1
            yield keys[at], keys[at] != last, [c.slice(at, stop - at) for c in rest]
            last, at = keys[at], stop


def partition_totals(group_ddl: list, n_boot: int, seed: int):
    """Partition function: (group.., part, score, pos, neg) sorted -> (group.., part, pw, nw), the weights' sums."""
    k = len(group_ddl) + 1

    def run(batches):
        key, totals = None, None

        def row():
            columns = [pa.array([v], t) for v, t in zip(key, kinds)] + [pa.array([totals[i].tolist()], pa.list_(pa.float64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=[*group_ddl, "_part", "pw", "nw"])

        kinds = None
        for batch in batches:
            kinds = kinds or batch.schema.types[:k]
            for now, first, (score, pos, neg) in _runs([batch], k):
                if now != key:
                    if key is not None:
                        yield row()
                    key, totals = now, np.zeros((2, n_boot + 1))
                s = score.to_numpy(zero_copy_only=False)
                for side, c in enumerate((pos, neg)):
                    totals[side] += weights(s, c.to_numpy(zero_copy_only=False), side, n_boot, seed).sum(axis=0)
        if key is not None:
            yield row()
    return run


def metric_terms(group_ddl: list, metrics, n_boot: int, seed: int):
    """Partition function: a row with the weights above the partition and in all
    (score null), then the partition's scores in descending order -> (group..,
    metric number, replicate, total) summed over the partition."""
    k = len(group_ddl) + 1

    def run(batches):
        key, above, whole, sums, kinds = None, None, None, None, None

        def rows():
            for m in range(len(metrics)):
                n = n_boot + 1
                columns = [pa.array([v] * n, t) for v, t in zip(key[:-1], kinds)] + [
                    pa.array([m] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(sums[m])]
                yield pa.RecordBatch.from_arrays(columns, names=[*group_ddl, "metric", "replicate", "total"])

        for batch in batches:
            kinds = kinds or batch.schema.types[:k]
            for now, _, (score, pos, neg, *vectors) in _runs([batch], k):
                at = 0
                if score.null_count:
                    if key is not None:
                        yield from rows()
                    key = now
                    tp, fp, P, N = (np.array(v[0].as_py()) for v in vectors)
                    above, whole, sums, at = [tp, fp], (P, N), np.zeros((len(metrics), n_boot + 1)), 1
                s = score.to_numpy(zero_copy_only=False)[at:]
                if not len(s):
                    continue
                w = [weights(s, c.to_numpy(zero_copy_only=False)[at:], side, n_boot, seed) for side, c in enumerate((pos, neg))]
                upto = [a + np.cumsum(x, axis=0) for a, x in zip(above, w)]
                above = [x[-1] for x in upto]
                for m, metric in enumerate(metrics):
                    terms = metric.terms(s[:, None], *w, *upto, *whole)
                    sums[m] = np.maximum(sums[m], terms.max(axis=0)) if metric.largest else sums[m] + terms.sum(axis=0)
        if key is not None:
            yield from rows()
    return run


def bootstrap_scores(df: DataFrame, metrics=METRICS, y: str = "y", p: str = "p", n_boot: int = 1000, ci: float = 0.95,
                     seed: int = C.SEED, group_cols: list[str] | None = None) -> DataFrame:
    """(group.., metric, point_estimate, ci_low, ci_high, n_defined, ci_level, n_bootstrap).

    The point estimate is the metric of the rows themselves; the interval has the
    percentiles (linear) of the replicates in which the metric is defined, of
    which there are ``n_defined``. Rows without a score don't count, those with
    one need a label. An empty input gives no row.
    """
    g = group_cols or []
    counts = materialize(score_counts(df, y, p, g))
    parts = max(1, counts.count() // PER_PARTITION + 1)
    order = [*(F.col(c) for c in g), F.desc("score")]
    placed = materialize(counts.select(*g, F.col("score").cast("double").alias("score"), "pos", "neg")
                         .repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id().cast("long")))
    types = dict(placed.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in [*g, "_part"])
    cols = [*g, "_part", "score", "pos", "neg"]
    sums = materialize(placed.select(*cols).sortWithinPartitions(*g, "_part").mapInArrow(
        partition_totals(g, n_boot, seed), f"{keys}, pw array<double>, nw array<double>"))
    # Running totals per group and replicate: rows are partitions times replicates.
    wide = sums.select(*g, "_part", F.posexplode(F.arrays_zip("pw", "nw")).alias("b", "w")).select(*g, "_part", "b", "w.pw", "w.nw")
    every = Window.partitionBy(*g, "b")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    run = wide.select(*g, "_part", "b", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}0") for c in ("pw", "nw")),
                      *(F.sum(c).over(every).alias(f"{c}1") for c in ("pw", "nw")))
    names = ("pw0", "nw0", "pw1", "nw1")
    ordered = F.array_sort(F.collect_list(F.struct("b", *names)))
    heads = run.groupBy(*g, "_part").agg(ordered.alias("v")).select(
        *g, "_part", *(F.lit(None).cast(t).alias(c) for c, t in (("score", "double"), ("pos", "long"), ("neg", "long"))),
        *(F.col(f"v.{c}").alias(c) for c in names))
    body = placed.select(*cols, *(F.lit(None).cast("array<double>").alias(c) for c in names))
    group_types = ", ".join(f"`{c}` {types[c]}" for c in g) + ", " if g else ""
    terms = (heads.unionByName(body).repartition(parts, "_part").sortWithinPartitions(*g, "_part", F.desc_nulls_first("score"))
             .mapInArrow(metric_terms(g, metrics, n_boot, seed), f"{group_types}metric int, replicate int, total double"))
    largest = F.col("metric").isin([m for m, x in enumerate(metrics) if x.largest])
    total = terms.groupBy(*g, "metric", "replicate").agg(F.sum("total").alias("s"), F.max("total").alias("m")).select(
        *g, "metric", "replicate", F.when(largest, F.col("m")).otherwise(F.col("s")).alias("total"))
    whole = run.groupBy(*(F.col(c).alias(f"_whole_{c}") for c in g), "b").agg(F.max("pw1").alias("P"), F.max("nw1").alias("N"))
    on = total["replicate"] == whole["b"]
    for c in g:
        on = on & total[c].eqNullSafe(whole[f"_whole_{c}"])
    joined = total.join(whole, on)
    value = F.lit(None).cast("double")
    name = F.lit(None).cast("string")
    for m, x in enumerate(metrics):
        value = F.when(F.col("metric") == m, x.finish(F.col("total"), F.col("P"), F.col("N"))).otherwise(value)
        name = F.when(F.col("metric") == m, F.lit(x.name)).otherwise(name)
    alpha = (1.0 - ci) / 2.0
    of_rep = F.when(F.col("replicate") > 0, F.col("value"))
    return joined.withColumn("value", value).groupBy(*g, name.alias("metric")).agg(
        F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("point_estimate"),
        F.percentile(of_rep, alpha).alias("ci_low"), F.percentile(of_rep, 1 - alpha).alias("ci_high"),
        F.count(of_rep).alias("n_defined")).withColumns({"ci_level": F.lit(ci), "n_bootstrap": F.lit(n_boot).cast("bigint")})
