"""W4 stratified holdout, W5 stratified folds, J6 disjointness, L7 fixed
sample, A25 class weights.

Row choice is by a md5 hash of (seed, id), tie-broken by id, so the split is
stable under recomputation, repartitioning and lost executors, and the same
rows are chosen by the SQL oracle. Counts per class follow the same rule as
a stratified shuffle split: ``ceil(test_size * n)`` test rows shared by class
with the largest remainder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.functions.scalar import hash_uniform
from leakscope.operators.rank import bucketed_rank, uniform_bucket
from leakscope.session import written

HOLDOUT_SALT = "holdout"
FOLD_SALT = "fold"


def salt(kind: str, seed: int) -> str:
    return f"{kind}{seed}"


def class_counts(df: DataFrame, label: str = C.TARGET) -> dict:
    """Two-row aggregate collected to the driver."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def allocate_test(counts: dict, test_size: float) -> dict:
    """Test rows per class: total ceil(test_size * n), floors first, then the
    largest remainders (ties by class value, False before True)."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    exact = {c: counts[c] * n_test / n for c in counts} if n else {}
    alloc = {c: math.floor(v) for c, v in exact.items()}
    left = n_test - sum(alloc.values())
    for c in sorted(exact, key=lambda c: (-(exact[c] - alloc[c]), str(c)))[:left]:
        alloc[c] += 1
    return alloc


def stratified_holdout(df: DataFrame, seed: int = C.SEED, test_size: float = C.TEST_SIZE,
                       id_col: str = C.ID, label: str = C.TARGET, buckets: int = 4096,
                       alloc: dict | None = None) -> DataFrame:
    """Adds ``is_test``; each class's first k_c rows by hash are test."""
    alloc = alloc if alloc is not None else allocate_test(class_counts(df, label), test_size)
    u = hash_uniform(salt(HOLDOUT_SALT, seed), F.col(id_col))
    ranked = bucketed_rank(df.withColumn("_u", u), [label], [F.col("_u"), F.col(id_col)],
                           uniform_bucket(F.col("_u"), buckets), "_r")
    k = F.lit(None).cast("bigint")
    for c, v in alloc.items():
        k = F.when(F.col(label) == F.lit(c), F.lit(v)).otherwise(k)
    return ranked.withColumn("is_test", F.col("_r") <= k).drop("_u", "_r")


def stratified_folds(train: DataFrame, seed: int = C.SEED, n_folds: int = C.N_FOLDS,
                     id_col: str = C.ID, label: str = C.TARGET, buckets: int = 4096,
                     counts: dict | None = None) -> DataFrame:
    """Fold 1..n by a global rank over (class, hash): within a class the
    folds cycle, so per-class fold sizes differ by at most one, and the second
    class continues the cycle so fold totals do too."""
    counts = counts if counts is not None else class_counts(train, label)
    order = sorted(counts, key=lambda c: str(c))  # False before True
    before, acc = {}, 0
    for c in order:
        before[c] = acc
        acc += counts[c]
    u = hash_uniform(salt(FOLD_SALT, seed), F.col(id_col))
    ranked = bucketed_rank(train.withColumn("_u", u), [label], [F.col("_u"), F.col(id_col)],
                           uniform_bucket(F.col("_u"), buckets), "_r")
    off = F.lit(0).cast("bigint")
    for c, v in before.items():
        off = F.when(F.col(label) == F.lit(c), F.lit(v)).otherwise(off)
    return ranked.withColumn("fold", (((F.col("_r") + off - 1) % n_folds) + 1).cast("int")).drop("_u", "_r")


def split_table(df: DataFrame, seed: int = C.SEED, test_size: float = C.TEST_SIZE,
                n_folds: int = C.N_FOLDS, id_col: str = C.ID, label: str = C.TARGET) -> DataFrame:
    """(id, label, is_test, fold): fold is null on test rows. Built once per
    run and written (pass a written input: it is read twice). One
    class-count aggregate serves both stages: the training counts are the
    class counts minus the test allocation."""
    base = df.select(id_col, label)
    counts = class_counts(base, label)
    alloc = allocate_test(counts, test_size)
    train_counts = {c: counts[c] - alloc.get(c, 0) for c in counts}
    # both union branches read the same holdout ranking; the exchange is reused
    ho = stratified_holdout(base, seed, test_size, id_col, label, alloc=alloc)
    train = stratified_folds(ho.filter(~F.col("is_test")), seed, n_folds, id_col, label, counts=train_counts)
    test = ho.filter(F.col("is_test")).withColumn("fold", F.lit(None).cast("int"))
    return written(train.unionByName(test))


def disjoint_check(split: DataFrame, n_folds: int = C.N_FOLDS, id_col: str = C.ID) -> DataFrame:
    """Per fold, the training rows whose id is also in the fold's validation
    rows (none, if the folds are disjoint); fold 0 holds the holdout against all
    training rows. One aggregate per id gives all of them."""
    is_train = ~F.col("is_test")
    per_id = split.groupBy(id_col).agg(
        F.count_if(is_train).alias("n"), F.count_if(F.col("is_test")).alias("c0"),
        *[F.count_if(is_train & (F.col("fold") == k)).alias(f"c{k}") for k in range(1, n_folds + 1)])
    others = lambda k: F.col("n") - (F.col(f"c{k}") if k else F.lit(0))
    sums = per_id.agg(*[F.coalesce(F.sum(F.when(F.col(f"c{k}") > 0, others(k))), F.lit(0)).alias(f"s{k}")
                        for k in range(n_folds + 1)])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("fold"), F.col(f"s{k}").alias("n_overlap")) for k in range(n_folds + 1)])).alias("r")).select("r.*")


def fixed_sample(df: DataFrame, n: int, seed: int = C.SEED, id_col: str = C.ID) -> DataFrame:
    """N rows without replacement, chosen by the seeded hash (a top-k, so
    each task keeps only its n best before the merge)."""
    u = hash_uniform(salt("sample", seed), F.col(id_col))
    return df.withColumn("_u", u).orderBy("_u", id_col).limit(n).drop("_u")


def class_weights(train: DataFrame, label: str = C.TARGET) -> DataFrame:
    """Balanced weight n / (2 n_c) per class and scale_pos_weight =
    neg / pos (1.0 without positives). Two rows."""
    t = F.col(label)
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))
    spw = F.when(F.col("pos") == 0, F.lit(1.0)).otherwise(F.col("neg") / F.col("pos"))
    rows = stats.select(F.explode(F.array(
        F.struct(F.lit(False).alias(label), F.col("neg").alias("n_class"), F.col("n").alias("n"), spw.alias("spw")),
        F.struct(F.lit(True).alias(label), F.col("pos").alias("n_class"), F.col("n").alias("n"), spw.alias("spw")),
    )).alias("s")).select("s.*")
    return rows.select(
        label, F.col("n_class").cast("bigint"),
        F.try_divide(F.col("n").cast("double"), F.col("n_class") * 2).alias("balanced_weight"),
        F.col("spw").cast("double").alias("scale_pos_weight"),
    )


def with_weights(train: DataFrame, label: str = C.TARGET, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight as a column: the two-row weight table is
    broadcast (size fixed by construction)."""
    w = class_weights(train, label).select(label, F.col("balanced_weight").alias(weight_col))
    return train.join(F.broadcast(w), label, "left")
