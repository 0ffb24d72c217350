import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators import split as S
from leakscope.operators.rank import (bucketed_rank, exact_order_stats, exact_quantiles, grouped_quantiles,
                                      running_totals, uniform_bucket)
from leakscope.functions.scalar import hash_uniform


def _labels(spark, pos, neg):
    rows = [(str(i), i < pos) for i in range(pos + neg)]
    return spark.createDataFrame(rows, f"{C.ID} STRING, {C.TARGET} BOOLEAN")


def test_holdout_sizes_and_stratification(spark):
    df = _labels(spark, 60, 140)
    sp = S.split_table(df)
    test = sp.filter("is_test")
    assert test.count() == 40 and sp.filter("not is_test").count() == 160
    rate = test.filter(F.col(C.TARGET)).count() / 40
    assert abs(rate - 0.3) <= 0.05


def test_folds_balanced_and_disjoint(spark):
    sp = S.split_table(_labels(spark, 20, 42))
    tr = sp.filter("not is_test")
    per = {(r["fold"], r[C.TARGET]): r["count"] for r in tr.groupBy("fold", C.TARGET).count().collect()}
    for cls in (True, False):
        sizes = [per.get((k, cls), 0) for k in range(1, 6)]
        assert max(sizes) - min(sizes) <= 1
    totals = [sum(v for (k, _), v in per.items() if k == f) for f in range(1, 6)]
    assert max(totals) - min(totals) <= 1
    assert all(r["n_overlap"] == 0 for r in S.disjoint_check(sp).collect())


def test_split_is_stable(spark):
    a = {r[C.ID] for r in S.split_table(_labels(spark, 30, 70)).filter("is_test").collect()}
    b = {r[C.ID] for r in S.split_table(_labels(spark, 30, 70).repartition(7)).filter("is_test").collect()}
    assert a == b


def test_allocate_largest_remainder():
    assert S.allocate_test({True: 60, False: 140}, 0.2) == {True: 12, False: 28}
    alloc = S.allocate_test({True: 3, False: 4}, 0.2)
    assert sum(alloc.values()) == 2


def test_bucketed_rank_equals_row_number(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2 == 0).alias("c"))
    df = df.withColumn("u", hash_uniform("t", F.col("k")))
    got = bucketed_rank(df, ["c"], [F.col("u"), F.col("k")], uniform_bucket(F.col("u"), 64), "r")
    pdf = got.toPandas()
    for c, g in pdf.groupby("c"):
        expect = g.sort_values(["u", "k"])["r"].tolist()
        assert expect == list(range(1, len(g) + 1))


def test_running_totals_match_cumsum(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 50, 400).astype(float)
    df = spark.createDataFrame([(float(v), 1) for v in vals], "s DOUBLE, n INT").groupBy("s").agg(F.sum("n").alias("n"))
    out = running_totals(df, [], "s", ["n"], descending=True, buckets=8).toPandas().sort_values("s", ascending=False)
    assert out["cum_n"].tolist() == out["n"].cumsum().tolist()


def test_exact_order_stats_and_quantiles(spark):
    rng = np.random.default_rng(2)
    vals = np.round(rng.normal(size=3001), 3)  # with ties
    df = spark.createDataFrame([(float(v),) for v in vals], "v DOUBLE")
    s = np.sort(vals)
    got = exact_order_stats(df, "v", [0, 1500, 3000], buckets=16)
    assert got == {0: s[0], 1500: s[1500], 3000: s[3000]}
    n, q = exact_quantiles(df, "v", [0.1, 0.5, 0.9], buckets=16)
    assert n == 3001
    assert q == pytest.approx(np.percentile(vals, [10, 50, 90]).tolist(), abs=1e-12)


def test_grouped_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", "b", "c") for v in rng.normal(size=200 + ord(g))]
    rows.append(("a", None))
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {r["g"]: r["value"] for r in grouped_quantiles(df, ["g"], "v", [0.5], buckets=8).collect()}
    for g in ("a", "b", "c"):
        vals = [v for gg, v in rows if gg == g and v is not None]
        assert got[g] == pytest.approx(float(np.median(vals)), abs=1e-12)


def test_fixed_sample_and_class_weights(spark):
    df = _labels(spark, 25, 75)
    s1 = [r[C.ID] for r in S.fixed_sample(df, 20).collect()]
    s2 = [r[C.ID] for r in S.fixed_sample(df.repartition(5), 20).collect()]
    assert len(set(s1)) == 20 and s1 == s2
    w = {r[C.TARGET]: r for r in S.class_weights(df).collect()}
    assert w[True]["balanced_weight"] == pytest.approx(100 / 50)
    assert w[False]["balanced_weight"] == pytest.approx(100 / 150)
    assert w[True]["scale_pos_weight"] == pytest.approx(3.0)
    none = S.class_weights(_labels(spark, 0, 10)).first()
    assert none["scale_pos_weight"] == 1.0


def test_order_stats_narrowing_path(spark):
    from leakscope.operators.rank import grouped_order_stats
    rng = np.random.default_rng(5)
    vals = np.concatenate([np.round(rng.normal(size=4000), 2), np.full(1500, 0.25)])  # heavy ties
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    want = {}
    for g in ("a", "b"):
        n = sum(1 for gg, _ in rows if gg == g)
        want[(g,)] = {0, n // 3, n // 2, n - 1}
    got = grouped_order_stats(df, ["g"], want, buckets=4, max_rows=40)
    for (g,), ranks in want.items():
        s = sorted(v for gg, v in rows if gg == g)
        for r in ranks:
            assert got[((g,), r)] == s[r]
    single = exact_order_stats(df, "v", [0, 2750, 5499], buckets=4)
    s = np.sort(vals)
    assert single == {0: s[0], 2750: s[2750], 5499: s[5499]}


def test_order_stats_with_one_heavy_value_never_sort_more_than_allowed(spark, monkeypatch):
    from leakscope.operators import rank as R
    rows = [(7.0,)] * 9_900 + [(float(i) / 100,) for i in range(100)] + [(100.0 + i,) for i in range(100)]
    df = spark.createDataFrame(rows, "v double")
    largest = []
    seen = R.grouped_order_stats

    def counted(vals, *a, **k):
        orig = type(vals).join

        def join(self, other, *b, **c):
            out = orig(self, other, *b, **c)
            if "_local" in getattr(other, "columns", []):
                largest.extend(r["n"] for r in self.groupBy("_rid").agg(F.count(F.lit(1)).alias("n")).collect())
            return out
        monkeypatch.setattr(type(vals), "join", join)
        return seen(vals, *a, **k)
    monkeypatch.setattr(R, "grouped_order_stats", counted)
    want = sorted(r[0] for r in rows)
    ranks = [0, 50, 99, 100, 5_000, 9_999, 10_000, 10_099]
    assert R.exact_order_stats(df, "v", ranks, buckets=4, max_rows=30) == {r: want[r] for r in ranks}
    assert largest and all(n <= 30 for n in largest)


def test_disjoint_check_counts_shared_ids(spark):
    from leakscope.operators import split as S
    rows = [("a", False, 1), ("a", False, 2), ("a", False, 2), ("b", True, None), ("b", False, 3), ("c", False, 1)]
    got = {r["fold"]: r["n_overlap"] for r in S.disjoint_check(
        spark.createDataFrame(rows, "neo_id string, is_test boolean, fold int")).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 0, 4: 0, 5: 0}


def test_order_stats_narrow_a_range_to_the_values_next_to_the_wanted_ranks(spark):
    from leakscope.operators.rank import grouped_order_stats, rank_probs
    probs = rank_probs([[("g",), None, None, 0, 5_000_000, [2_500_000]]], 10000, 64)
    assert 0 < len(probs) <= 4 and probs[0] < 0.5 < probs[-1] and probs[-1] - probs[0] < 0.001
    vals = spark.range(20000).selectExpr("'g' as g", "cast(pmod(id * 7919, 20011) as double) as v")
    want = sorted(r[0] for r in vals.select("v").collect())
    got = grouped_order_stats(vals, ["g"], {("g",): {0, 9999, 10000, 19999}}, max_rows=50)
    assert got == {(("g",), r): want[r] for r in (0, 9999, 10000, 19999)}


def test_medians_are_exact_with_ties_nulls_and_nans(spark):
    import random
    import statistics
    from leakscope.operators.preprocess import fit_medians
    rng = random.Random(5)
    rows = [(rng.random() if i % 5 else None, float(rng.choice([1, 2])), float(i), float("nan") if i % 3 else rng.gauss(0, 1), None)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = fit_medians(df, list("abcde"))
    for i, f in enumerate("abcd"):
        own = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert got[f] == statistics.median(own)
    assert got["e"] is None


def test_fits_run_together_on_small_inputs_only():
    from leakscope.plans.experiment import fits_at_once
    assert fits_at_once(1000) == 8 and fits_at_once(7_000_000) == 4 and fits_at_once(10**9) == 1
