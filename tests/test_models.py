"""Invariant tests for the rows-only operators (models, search, OOF,
attributions, outlier scores, registry), on a synthetic catalogue built
from spark.range with hash uniforms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators import metrics as M
from leakscope.operators import models as MD
from leakscope.operators.features import (
    FEATURE_SETS, LeakageError, add_derived_features, as_sources, checkpoint_with_lineage)
from leakscope.operators.preprocess import AuditPreprocessor, fit_medians
from leakscope.operators.split import split_table
from leakscope.plans import experiment as EX
from leakscope.session import materialize


def synthetic(spark, n=600, seed=7):
    """Label = moid <= 0.05 and h <= 22 with 3 % flips; other columns are
    hash-derived noise. A Spark expression, so it scales and repeats."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1000003)) / 1000003.0
    moid = F.least(F.greatest(-F.log1p(-u("m") * 0.999) * 0.15, F.lit(0.0001)), F.lit(3.0))
    h = F.least(F.greatest(F.lit(10.0) + u("h") * 20, F.lit(10.0)), F.lit(30.0))
    rule = (moid <= 0.05) & (h <= 22)
    label = F.when(u("flip") < 0.03, ~rule).otherwise(rule)
    cols = {c: (u(c) * 10).alias(c) for c in C.FLAT_COLUMNS}
    cols.update({
        "neo_id": F.col("id").cast("string").alias("neo_id"), "name": F.lit("x").alias("name"),
        "designation": F.lit(None).cast("string").alias("designation"),
        "moid_au": moid.alias("moid_au"), "absolute_magnitude_h": h.alias("absolute_magnitude_h"),
        "estimated_diameter_km_min": (F.lit(30.0) - h).alias("estimated_diameter_km_min"),
        "estimated_diameter_km_max": (F.lit(31.0) - h).alias("estimated_diameter_km_max"),
        C.TARGET: label.alias(C.TARGET), "is_sentry_object": F.lit(False).alias("is_sentry_object"),
        "num_recorded_close_approaches": F.floor(u("n") * 5).cast("int").alias("num_recorded_close_approaches"),
        "closest_approach_date": F.lit("2020-01-01").alias("closest_approach_date"),
        "orbit_class_type": F.element_at(F.array(F.lit("APO"), F.lit("AMO"), F.lit("ATE")),
                                         (F.floor(u("c") * 3) + 1).cast("int")).alias("orbit_class_type"),
        "eccentricity": F.when(u("e") < 0.1, F.lit(None)).otherwise(u("e")).alias("eccentricity"),
    })
    df = spark.range(n).select(*[cols[c] for c in C.FLAT_COLUMNS])
    d = materialize(add_derived_features(df))
    sp = split_table(d.select(C.ID, C.TARGET))
    return materialize(d.join(sp.drop(C.TARGET), C.ID))


@pytest.fixture(scope="module")
def mf(spark):
    return synthetic(spark)


def test_preprocessor_fits_on_training_rows_only(spark, mf):
    fs = FEATURE_SETS["leakage_aware"]
    tr = mf.filter(~F.col("is_test"))
    m = AuditPreprocessor(numericCols=fs.numeric_features, categoricalCols=fs.categorical_features).fit(tr)
    assert m.fitted()["medians"] == fit_medians(tr, fs.numeric_features)
    assert m.fitted()["medians"] != fit_medians(mf, fs.numeric_features)
    out = m.transform(mf.filter("is_test")).select("features").first()[0]
    assert len(out) == len(m.feature_names()) == 17 + 3
    unknown = mf.filter("is_test").limit(1).withColumn("orbit_class_type", F.lit("NEW"))
    wide = m.transformed_columns(unknown).first().asDict()
    assert all(wide[n] == 0.0 for n in m.feature_names() if n.startswith("categorical__"))


def test_dummy_auc_half_and_ap_prevalence(spark, mf):
    fs = FEATURE_SETS["original"]
    model = MD.pipeline(fs, "dummy_most_frequent").fit(MD.training_frame(mf.filter(~F.col("is_test"))))
    s = MD.scores(model.transform(mf.filter("is_test"))).withColumn("y", F.col(C.TARGET))
    assert M.roc_auc(s).first()["roc_auc"] == pytest.approx(0.5)
    prev = s.agg(F.avg(F.col("y").cast("double"))).first()[0]
    assert M.average_precision(s).first()["average_precision"] == pytest.approx(prev)


def _f1(spark, mf, key, name):
    tr = MD.training_frame(mf.filter(~F.col("is_test")))
    model = MD.pipeline(FEATURE_SETS[key], name, {"C": 1.0, "max_iter": 50, "n_estimators": 20, "max_depth": 5},
                        n_weight_sum=tr.count()).fit(tr)
    s = MD.scores(model.transform(mf.filter("is_test"))).withColumn("y", F.col(C.TARGET))
    return M.metrics_from_counts(M.confusion(s)).first()["f1"], model


def test_label_defining_set_beats_leakage_aware(spark, mf):
    fa, _ = _f1(spark, mf, "original", "random_forest")
    fb, _ = _f1(spark, mf, "leakage_aware", "random_forest")
    assert fa > fb


def test_oof_scores_every_training_id_once(spark, mf):
    tr = mf.filter(~F.col("is_test"))
    oof = MD.oof_predictions(tr, FEATURE_SETS["physical_kinematic_only"], "logistic_regression",
                             {"C": 1.0, "max_iter": 20})
    assert oof.count() == tr.count() == oof.select(C.ID).distinct().count()
    assert oof.join(mf.filter("is_test"), C.ID, "left_semi").count() == 0


def test_search_settings_distinct_and_bounded():
    s = MD.search_settings("random_forest")
    assert len(s) == 12 and len({str(x) for x in s}) == 12
    assert len(MD.search_settings("logistic_regression")) == 7
    assert MD.search_settings("dummy_most_frequent") == [{}]


def test_tree_attributions_local_accuracy(spark, mf):
    from leakscope.operators.attribution import tree_attributions
    _, model = _f1(spark, mf, "original", "random_forest")
    prep, rf = model.stages[0], model.stages[-1]
    test = prep.transform(mf.filter("is_test"))
    attr = tree_attributions(test, rf, prep.feature_names())
    res = attr.select((F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
                       - F.col("prediction")).alias("r")).agg(F.max(F.abs("r"))).first()[0]
    assert res < 1e-9
    probs = M.confusion  # noqa: F841
    p = {r[C.ID]: r["p"] for r in MD.scores(model.transform(mf.filter("is_test"))).select(C.ID, "p").collect()}
    a = {r[C.ID]: r["prediction"] for r in attr.collect()}
    assert max(abs(p[k] - a[k]) for k in p) < 1e-9
    used = set()
    for t in __import__("leakscope.operators.attribution", fromlist=["forest_arrays"]).forest_arrays(rf):
        used |= set(int(f) for f in t["feature"] if f >= 0)
    contrib = attr.select("contributions").collect()
    for i in range(len(prep.feature_names())):
        if i not in used:
            assert all(r[0][i] == 0.0 for r in contrib)


def test_permutation_importance_ignored_column_is_zero(spark, mf):
    from leakscope.operators.attribution import permutation_importance
    fs = FEATURE_SETS["original"]
    _, model = _f1(spark, mf, "original", "random_forest")
    rf = model.stages[-1]
    imp = rf.featureImportances.toArray()
    names = model.stages[0].feature_names()
    ignored = [n.replace("numeric__", "") for n, v in zip(names, imp) if v == 0 and n.startswith("numeric__")]
    out = {r["feature"]: r for r in permutation_importance(model, mf.filter("is_test"), fs.feature_columns,
                                                          n_repeats=3).collect()}
    assert len(out) == len(fs.feature_columns)
    for f in ignored:
        assert out[f]["importance_mean"] == 0.0
    assert out["moid_au"]["importance_mean"] > 0


def test_isolation_forest_flags_planted_outlier(spark, mf):
    from leakscope.operators.outlier import isolation_forest
    base = mf.select(C.ID, *C.ALL_NUMERIC, *C.CATEGORICAL)
    far = base.limit(1).withColumn(C.ID, F.lit("far")).withColumns({c: F.lit(1e6) for c in C.ALL_NUMERIC})
    data = materialize(base.unionByName(far))
    prep = AuditPreprocessor(numericCols=C.ALL_NUMERIC, categoricalCols=C.CATEGORICAL).fit(data)
    s1 = isolation_forest(prep.transform(data), n_trees=50).orderBy("ml_anomaly_score").collect()
    assert s1[0][C.ID] == "far"
    share = sum(r["ml_flagged_outlier"] for r in s1) / len(s1)
    assert 0 < share < 1
    s2 = {r[C.ID]: r["ml_anomaly_score"] for r in isolation_forest(prep.transform(data), n_trees=50).collect()}
    assert all(abs(s2[r[C.ID]] - r["ml_anomaly_score"]) < 1e-12 for r in s1)


def test_registry_roundtrip_and_batch_predict(spark, mf, tmp_path):
    from leakscope.plans import experiment as EX
    root = str(tmp_path / "reg")
    _, model = _f1(spark, mf, "original", "logistic_regression")
    EX.save_model(spark, model, root, "logistic_regression", "v1", {"test_size": 0.2})
    loaded = EX.load_model(root, "logistic_regression", "v1")
    rows = mf.filter("is_test").select(*[c for c in C.FLAT_COLUMNS if c != C.TARGET])
    a = {r[C.ID]: r["p"] for r in EX.batch_predict(model, rows, "v1").collect()}
    b = {r[C.ID]: r["p"] for r in EX.batch_predict(loaded, rows, "v1").collect()}
    assert a == b
    assert [r["version"] for r in EX.registered_models(spark, root).collect()] == ["v1"]
    with pytest.raises(ValueError):
        EX.batch_predict(model, rows.withColumn("unexpected", F.lit(1)), "v1")
    partial = EX.batch_predict(model, rows.select(C.ID, "moid_au"), "v1")
    assert partial.count() == rows.count()
    with pytest.raises(Exception):
        EX.load_model(root, "nope", "v0")


def checked_frame(spark):
    clean = as_sources(materialize(synthetic(spark, 300).select(*C.FLAT_COLUMNS)))
    split = split_table(clean.select(C.ID, C.TARGET)).drop(C.TARGET)
    return checkpoint_with_lineage(add_derived_features(clean).join(split, C.ID))


def test_run_one_writes_every_artifact(spark, tmp_path):
    mf = checked_frame(spark)
    settings = [{"n_estimators": 3, "max_depth": 2}, {"n_estimators": 4, "max_depth": 3}]
    EX.run_one(spark, mf, str(tmp_path), "leakage_aware", "random_forest", settings={"random_forest": settings}, permutation_repeats=2)
    for name in EX.ARTIFACT_TABLES:
        assert EX.read_artifact(spark, str(tmp_path), name).count() > 0, name
    meta = EX.read_artifact(spark, str(tmp_path), "metadata").first()
    assert meta["train_rows"] + meta["test_rows"] == mf.count()
    assert len(json.loads(meta["search_results"])) == 2
    summary = EX.run_summary(spark, str(tmp_path)).collect()
    assert [(r["experiment"], r["model"]) for r in summary] == [("leakage_aware", "random_forest")]
    with pytest.raises(LeakageError):
        bad = checkpoint_with_lineage(mf.withColumn("eccentricity", F.col("moid_au") * 2))
        EX.run_one(spark, bad, str(tmp_path), "leakage_aware", "dummy_most_frequent")


def test_run_all_stacks_combinations_and_replaces_only_its_own(spark, tmp_path):
    mf = checked_frame(spark)
    models = ["dummy_most_frequent", "logistic_regression"]
    options = {"settings": {"logistic_regression": [{"C": 1.0, "max_iter": 5}]}, "permutation_repeats": 0}
    out = EX.run_all(spark, mf, str(tmp_path), ["original", "orbital_only"], models, **options)
    assert out.count() == 4
    EX.run_one(spark, mf, str(tmp_path), "original", "dummy_most_frequent", permutation_repeats=0)
    assert EX.run_summary(spark, str(tmp_path)).count() == 4


def test_leaf_values_are_the_shapley_values_of_the_path_dependent_game():
    import itertools
    import math

    import numpy as np
    from leakscope.operators.attribution import expected_value, leaf_paths, leaf_shap
    # a split on feature 0 that comes back below a split on feature 1
    tree = {"left": np.array([1, 3, -1, 5, -1, -1, -1]), "right": np.array([2, 4, -1, 6, -1, -1, -1]),
            "feature": np.array([0, 1, -1, 0, -1, -1, -1]), "threshold": np.array([0.5, 0.3, 0, 0.2, 0, 0, 0]),
            "value": np.array([0, 0, 0.9, 0, 0.4, 0.1, 0.6]), "cover": np.array([100.0, 60, 40, 45, 15, 20, 25])}

    def game(x, known, node=0):
        if tree["left"][node] < 0:
            return tree["value"][node]
        a, b = tree["left"][node], tree["right"][node]
        if tree["feature"][node] in known:
            return game(x, known, a if x[tree["feature"][node]] <= tree["threshold"][node] else b)
        return (tree["cover"][a] * game(x, known, a) + tree["cover"][b] * game(x, known, b)) / tree["cover"][node]

    X = np.array([[0.1, 0.1, 5], [0.3, 0.1, 5], [0.4, 0.9, 5], [0.8, 0.2, 5]])
    phi = np.zeros(X.shape)
    pred = sum(leaf_shap(X, leaf, phi) for leaf in leaf_paths(tree))
    for x, got, p in zip(X, phi, pred):
        assert abs(p - game(x, {0, 1, 2})) < 1e-12 and abs(expected_value(tree) + got.sum() - p) < 1e-12
        for j in range(3):
            rest = [i for i in range(3) if i != j]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (game(x, {*s, j}) - game(x, set(s)))
                       for n in range(3) for s in itertools.combinations(rest, n))
            assert abs(got[j] - want) < 1e-12


def test_boosted_attributions_add_up_to_the_margin_and_are_shapley_values(spark, mf):
    import itertools
    import math

    import numpy as np
    from pyspark.ml.functions import vector_to_array

    from leakscope.operators.attribution import boosted_arrays, boosted_margin, leaf_paths, tree_attributions
    fs = FEATURE_SETS["physical_kinematic_only"]
    tr = MD.training_frame(mf.filter("not is_test"))
    model = MD.pipeline(fs, "xgboost", {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3}).fit(tr)
    prep, gbt = model.stages[0], model.stages[-1]
    feats = prep.transform(mf.filter("is_test"))
    attr = {r[C.ID]: r for r in tree_attributions(feats, gbt, prep.feature_names()).collect()}
    trees = boosted_arrays(gbt)

    def game(x, known):
        """The margin when only ``known`` features are known, over all trees."""
        def value(t, node=0):
            if t["left"][node] < 0:
                return t["value"][node]
            a, b, f = t["left"][node], t["right"][node], t["feature"][node]
            if f in known:
                return value(t, a if x[f] <= t["threshold"][node] else b)
            return (t["cover"][a] * value(t, a) + t["cover"][b] * value(t, b)) / t["cover"][node]
        return sum(value(t) for t in trees)

    rows = gbt.transform(feats).select(C.ID, vector_to_array("features").alias("x"), boosted_margin(gbt).alias("margin")).collect()
    for i, r in enumerate(rows):
        got = attr[r[C.ID]]
        assert abs(got["base_value"] + sum(got["contributions"]) - r["margin"]) < 1e-9
        assert abs(got["prediction"] - r["margin"]) < 1e-9 and abs(got["base_value"] - game(r["x"], set())) < 1e-9
        if i < 5:
            k = len(r["x"])
            for j in range(k):
                rest = [f for f in range(k) if f != j]
                want = sum(math.factorial(len(s)) * math.factorial(k - 1 - len(s)) / math.factorial(k)
                           * (game(r["x"], {*s, j}) - game(r["x"], set(s))) for n in range(k) for s in itertools.combinations(rest, n))
                assert abs(got["contributions"][j] - want) < 1e-9
    assert any(np.abs(list(r["contributions"])).max() > 0.01 for r in attr.values()) and leaf_paths(trees[0])


def test_readers_see_whole_runs_only(spark, tmp_path, monkeypatch):
    from leakscope.plans import runs as R
    root = str(tmp_path)
    table = lambda v, combos: spark.createDataFrame([(e, m, v) for e, m in combos], "experiment string, model string, v int")
    both, one = [("a", "x"), ("b", "x")], [("a", "x")]
    EX.write_artifacts({"metadata": table(1, both), "scores": table(1, both)}, root)

    def broken(tables, at, run):
        tables["metadata"].write.partitionBy(*R.KEYS).parquet(f"{at}/metadata/run={run}")
        raise OSError("stopped between two tables")
    with monkeypatch.context() as patch:
        patch.setattr(R, "stage", broken)
        with pytest.raises(OSError):
            EX.write_artifacts({"metadata": table(2, both), "scores": table(2, both)}, root)
    values = lambda name: sorted(tuple(r) for r in EX.read_artifact(spark, root, name).select("experiment", "model", "v").collect())
    assert values("metadata") == values("scores") == [("a", "x", 1), ("b", "x", 1)]
    EX.write_artifacts({"metadata": table(3, one), "extra": table(3, one)}, root)
    assert values("metadata") == [("a", "x", 3), ("b", "x", 1)]
    assert values("scores") == [("b", "x", 1)] and values("extra") == [("a", "x", 3)]
    with pytest.raises(Exception, match="not found"):
        EX.read_artifact(spark, root, "never")
    scan = EX.read_artifact(spark, root, "scores")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan


def test_two_writers_do_not_lose_each_other(spark, tmp_path, monkeypatch):
    from leakscope.plans import runs as R
    root = str(tmp_path)
    real_put, late = R.Files.put, []

    def put(self, name, value, still):
        if not late:  # another writer commits first
            late.append(1)
            R.commit(spark, root, "r-other", [("b", "x")], ["t"])
        return real_put(self, name, value, still)
    monkeypatch.setattr(R.Files, "put", put)
    monkeypatch.setattr(R, "CLAIM_WAIT", 0.5)
    R.commit(spark, root, "r-mine", [("a", "x")], ["t"])
    # a writer that stopped between its claim and its manifest holds up nobody for long
    files = R.Files(spark, root)
    files.fs.createNewFile(files.at(f"{R.MANIFESTS}/000000003.json.claim"))
    R.commit(spark, root, "r-last", [("c", "x")], ["t"])
    assert R.numbers(files) == [1, 2, 4] and ["c", "x", "r-last"] in R.manifest(spark, root)["combinations"]
    assert R.ledger_key(model="m", seed=1) == R.ledger_key(seed=1, model="m") != R.ledger_key(model="m", seed=2)
    assert sorted(map(tuple, R.manifest(spark, root)["combinations"]))[:2] == [("a", "x", "r-mine"), ("b", "x", "r-other")]


def test_a_stopped_grid_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    mf = checked_frame(spark)
    trained = []
    real_run = EX.run_combination

    def counting(s, m, f, experiment, model, *rest):
        trained.append((experiment, model))
        if len(trained) == 2:
            raise RuntimeError("stopped")
        return real_run(s, m, f, experiment, model, *rest)
    monkeypatch.setattr(EX, "run_combination", counting)
    options = {"settings": {"random_forest": [{"n_estimators": 3, "max_depth": 2}]}, "permutation_repeats": 0, "parallel": 3}
    combos = (["leakage_aware"], ["random_forest", "dummy_most_frequent"])
    with pytest.raises(RuntimeError, match="stopped"):
        EX.run_all(spark, mf, str(tmp_path), *combos, **options)
    with pytest.raises(Exception, match="not found"):
        EX.run_summary(spark, str(tmp_path))
    assert EX.run_all(spark, mf, str(tmp_path), *combos, **options).count() == 2
    assert trained == [("leakage_aware", "random_forest"), ("leakage_aware", "dummy_most_frequent"), ("leakage_aware", "dummy_most_frequent")]


def test_shap_patterns_are_worked_out_once():
    """Looked-up values of a path equal those of the rows' own patterns."""
    from leakscope.operators.attribution import leaf_shap, small_patterns
    rng = np.random.default_rng(3)
    leaf = (0.7, np.array([2, 0, 3]), np.array([-np.inf, 0.1, -0.5]), np.array([0.4, np.inf, 0.5]), np.array([0.3, 0.6, 0.2]))
    X = rng.normal(size=(300, 4))
    X[::7, 0] = np.nan
    a, b = np.zeros(X.shape), np.zeros(X.shape)
    known = small_patterns(leaf)
    assert known.shape == (8, 3)
    assert np.array_equal(leaf_shap(X, leaf, a), leaf_shap(X, leaf, b, known))
    assert np.allclose(a, b, atol=1e-15) and not a[:, 1].any() and a.any()


def test_legacy_models_share_one_preprocessor(spark, tmp_path, monkeypatch):
    from leakscope.operators.preprocess import AuditPreprocessor
    from leakscope.plans import experiment as EX
    from leakscope.plans.q_models import modelling_frame
    fits, fit = [], AuditPreprocessor._fit
    monkeypatch.setattr(AuditPreprocessor, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    mf = modelling_frame(spark, "/root/testdata/sf0.001")
    out = EX.train_legacy(spark, mf, str(tmp_path), params={
        "logistic_regression": {"C": 1.0, "max_iter": 3}, "random_forest": {"n_estimators": 2, "max_depth": 2}})
    assert len(fits) == 1 and out.count() == 2


def test_forest_samples_are_drawn_once_and_walks_end_in_leaves(spark, monkeypatch):
    from leakscope.operators import outlier as O
    calls, keep = [], O.written
    monkeypatch.setattr(O, "written", lambda df: calls.append(1) or keep(df))
    rng = np.random.default_rng(4)
    X = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(X)], "neo_id STRING, x ARRAY<DOUBLE>")
    forest, psi = O.fit_forest(df, n_trees=5, psi=64)
    assert len(calls) == 1

    def walk(tree, x):
        n = tree.iloc[0]
        while n["feature"] >= 0:
            n = tree.iloc[int(n["left_child"] if x[int(n["feature"])] < n["threshold"] else n["right_child"])]
        return n["depth"] + O.c_factor(n["size"])
    trees = [t.sort_values("node") for _, t in forest.groupby("tree")]
    want = [np.mean([walk(t, x) for t in trees]) for x in X[:40]]
    assert np.allclose(O._path_lengths(O.pack(forest), X[:40]), want, atol=1e-12)


def test_sets_of_a_grid_share_the_constants_of_their_folds(spark, tmp_path, monkeypatch):
    """One preprocessor a fold for all sets, which gives each set what a fit on its own
    columns gives; models equal those of whole pipelines; no copy of rows is left."""
    from leakscope.operators.preprocess import AuditPreprocessor
    mf = checked_frame(spark)
    kept = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    fits, fit, before = [], AuditPreprocessor._fit, kept()
    monkeypatch.setattr(AuditPreprocessor, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    setting = {"C": 1.0, "max_iter": 5}
    sets, models = ["leakage_aware", "orbital_only"], ["dummy_most_frequent", "logistic_regression"]
    fitted = EX.run_grid(spark, mf, str(tmp_path), sets, models, settings={"logistic_regression": [setting]},
                         permutation_repeats=0, parallel=4)
    assert len(fits) == C.N_FOLDS + 1
    assert kept() == before
    train = MD.training_frame(mf.filter(~F.col("is_test")))
    for key in sets:
        own = MD.pipeline(FEATURE_SETS[key], models[1], setting, n_weight_sum=train.count()).fit(train)
        got = fitted[key, models[1]]
        assert got.stages[0].feature_names() == own.stages[0].feature_names()
        a, b = got.stages[0].fitted(), own.stages[0].fitted()
        assert (a["medians"], a["modes"], a["categories"]) == (b["medians"], b["modes"], b["categories"])
        for k in ("means", "scales"):
            assert a[k] == pytest.approx(b[k], rel=1e-12)
        assert got.stages[-1].coefficients.toArray() == pytest.approx(own.stages[-1].coefficients.toArray(), rel=1e-6, abs=1e-9)


def test_registered_models_are_trained_with_the_legacy_settings(spark, monkeypatch):
    from leakscope.plans import q_reports as QR
    mf, seen, classifier = synthetic(spark, n=200), {}, MD.classifier

    def small(name, params=None, *args, **options):
        seen[name] = params
        return classifier(name, {"n_estimators": 2, "max_depth": 2, "max_iter": 2}, *args, **options)

    monkeypatch.setattr(MD, "classifier", small)
    monkeypatch.setattr(QR, "modelling_frame", lambda spark, sf_dir: mf)
    monkeypatch.setattr(QR, "run_table", lambda spark, key, build: build())
    root = QR.registry_root(spark, "/root/testdata/sf0.001")
    assert seen == EX.LEGACY
    assert [r["model_name"] for r in EX.registered_models(spark, root).collect()] == sorted(EX.LEGACY)
    assert classifier("logistic_regression", EX.LEGACY["logistic_regression"]).getMaxIter() == 1000
    forest, boosted = (classifier(m, EX.LEGACY[m]) for m in ("random_forest", "xgboost"))
    assert (forest.getNumTrees(), forest.getMaxDepth(), boosted.getMaxIter()) == (200, MD.UNLIMITED_DEPTH, 100)


def test_swapped_features_of_a_forest_are_looked_up(spark, mf, monkeypatch):
    from pyspark.ml import PipelineModel
    from leakscope.operators import attribution as A
    fs = FEATURE_SETS["leakage_aware"]
    tr, test = MD.training_frame(mf.filter(~F.col("is_test"))), mf.filter("is_test")
    model = MD.pipeline(fs, "random_forest", {"n_estimators": 5, "max_depth": 4}).fit(tr)
    # values that are missing, NaN or of an unknown category, and a feature that the model ignores
    n = F.xxhash64(C.ID) % 7
    odd = test.withColumns({
        "inclination_deg": F.when(n == 0, F.lit(None)).when(n == 1, F.lit(float("nan"))).otherwise(F.col("inclination_deg")),
        "orbit_class_type": F.when(n == 2, "new").when(n == 3, F.lit(None)).otherwise(F.col("orbit_class_type"))})
    features = [*fs.feature_columns, "moid_au"]
    run = lambda: sorted(map(tuple, A.permutation_importance(model, odd, features, n_repeats=3).collect()))
    with monkeypatch.context() as m:
        m.setattr(A, "swap_tables", lambda *args: None)
        scored = run()
    monkeypatch.setattr(PipelineModel, "transform", lambda *args: pytest.fail("rows are scored"))
    found = run()
    assert [r[0] for r in found] == [r[0] for r in scored] and np.allclose([r[1:] for r in found], [r[1:] for r in scored], 0, 1e-12)
    assert any(r[1] != 0 for r in found) and dict((r[0], r[1]) for r in found)["moid_au"] == 0.0


def test_constants_of_all_folds_come_from_shared_passes(spark, monkeypatch):
    from leakscope.operators import preprocess as PP
    rng = np.random.default_rng(5)

    def row(i):
        a, b = float(rng.normal()), float(rng.integers(0, 3))
        return (i % 3 + 1, None if i % 5 == 0 else float("nan") if i % 31 == 0 else a, b, 0.5, None,
                float(i % 3 * 100 + i), None if i % 11 == 0 else "xyz"[i % 7 % 3])

    # a third fold of its own values (f), whose absence moves the median far; g is null but for one fold
    rows = [(*r, 1.5 * k if r[0] == 2 else None) for k, r in enumerate(map(row, range(300)))]
    df = materialize(spark.createDataFrame(rows, "fold INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, f DOUBLE, t STRING, g DOUBLE"))
    num, fits, fit = list("abcdfg"), [], PP.fit_medians
    own = {k: PP.AuditPreprocessor(numericCols=num, categoricalCols=["t"]).fit(df if k is None else df.filter(F.col("fold") != k)).fitted()
           for k in (1, 2, 3, None)}
    monkeypatch.setattr(PP, "fit_medians", lambda df, features: fits.append(features) or fit(df, features))
    got = PP.fold_statistics(df, "fold", num, ["t"], 300)
    assert list(got) == list(own)
    for k in own:
        for part in ("medians", "modes", "categories"):
            assert got[k][part] == own[k][part]
        for part in ("means", "scales"):
            known = {f: v for f, v in own[k][part].items() if v is not None}
            assert {f for f, v in got[k][part].items() if v is not None} == set(known)
            assert [got[k][part][f] for f in known] == pytest.approx(list(known.values()), rel=1e-12, nan_ok=True)
    assert all(set(f) <= {"f", "g"} for f in fits)
    mf = checked_frame(spark)
    fits.clear()
    EX.FoldConstants(mf, [FEATURE_SETS["leakage_aware"]])
    assert not fits


def test_settings_of_a_search_are_scored_in_one_pass_a_fold(spark, monkeypatch):
    mf, settings, plans, keep = checked_frame(spark), [{"C": c, "max_iter": 8} for c in (0.01, 10.0)], [], EX.written
    monkeypatch.setattr(EX, "written", lambda df: plans.append(df) or keep(df))
    kept = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    folds, before, held_before = EX.Folds(mf, FEATURE_SETS["leakage_aware"]), kept(), []  # sets of rows kept at each fit
    fit = MD.LogisticRegression._fit
    monkeypatch.setattr(MD.LogisticRegression, "_fit", lambda self, df: held_before.append(sum(
        rows.storageLevel.useMemory for rows in (folds.train, *(p[1] for p in folds.parts)))) or fit(self, df))
    model, best, search, oof = EX.tuned(folds, "logistic_regression", settings, parallel=2)
    assert plans[0]._jdf.queryExecution().optimizedPlan().collectLeaves().size() == C.N_FOLDS
    assert set(held_before) == {1} and kept() == before
    train = mf.filter(~F.col("is_test"))
    _, own_best, own = MD.random_search(train, FEATURE_SETS["leakage_aware"], "logistic_regression", settings)
    assert best["params"] == own_best
    assert [r["mean_test_score"] for r in search] == pytest.approx([r["mean_test_score"] for r in own], abs=1e-12)
    assert oof.count() == oof.select(C.ID).distinct().count() == train.count()
