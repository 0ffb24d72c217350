"""One experiment x model combination end to end, the grid,
artifact tables, the model registry, batch scoring and re-evaluation.

Artifacts are Parquet tables partitioned by ``experiment`` and ``model``, staged
by run and made visible by one commit (``plans.runs``): re-running a combination
replaces only its partitions, and readers see whole runs only. Models are saved
with Spark ML persistence. The driver holds only specs, fitted models and small
result rows.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import platform
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyspark
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators import metrics as M
from leakscope.operators import models as MD
from leakscope.operators import preprocess as PP
from leakscope.operators.features import FEATURE_SETS, add_derived_features, assert_no_lineage_leakage, get_feature_set
from leakscope.plans import runs as R
from leakscope.plans.q_metrics import error_profile, error_table, grouped_error_records
from leakscope.sources.raw import MissingInputError
from leakscope.session import one_row, written

KEYS = ["experiment", "model"]
ARTIFACT_TABLES = ["metadata", "fold_metrics", "cv_metrics", "test_metrics", "confusion_matrix", "roc_curve",
                   "pr_curve", "threshold_analysis", "calibration", "error_analysis", "error_records",
                   "feature_importance", "permutation_importance", "predictions", "shap_summary"]
FOLD_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
METADATA_DDL = ("experiment STRING, model STRING, experiment_name STRING, purpose STRING, dataset_path STRING, "
                "provenance STRING, feature_columns STRING, random_seed INT, n_cv_folds INT, outer_test_size DOUBLE, "
                "dataset_row_count BIGINT, train_rows BIGINT, test_rows BIGINT, best_hyperparameters STRING, "
                "search_results STRING, tuned BOOLEAN, trained_at_utc STRING, python STRING, spark STRING")


def metadata(spark: SparkSession, specs: list[dict], n_rows: int, n_test: int, seed: int = C.SEED,
             dataset_path: str | None = None, provenance: dict | None = None) -> DataFrame:
    """One row per combination; the driver holds the specs only."""
    now = dt.datetime.now(dt.timezone.utc).isoformat()
    rows = []
    for s in specs:
        fs = FEATURE_SETS[s["experiment"]]
        rows.append((s["experiment"], s["model"], fs.display_name, s.get("purpose", fs.display_name), dataset_path,
                     json.dumps(provenance, default=str), json.dumps(fs.feature_columns), seed, C.N_FOLDS, C.TEST_SIZE,
                     n_rows, n_rows - n_test, n_test, json.dumps(s.get("best", {}), default=str),
                     json.dumps(s.get("search", []), default=str), s["model"] in C.TUNABLE_MODELS, now,
                     platform.python_version(), pyspark.__version__))
    return spark.createDataFrame(rows, METADATA_DDL)


def artifacts_from_scores(scored: DataFrame, features: list[str], seed: int = C.SEED,
                          rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every score-derived artifact of all combinations at once.

    ``scored`` holds experiment, model, part ('oof' or 'holdout'), fold, id, y,
    p and pred; ``rows`` the holdout's, with ``features`` (default: those of
    ``scored``). Each artifact is one grouped plan over (experiment, model), so the
    number of Spark jobs does not grow with the number of combinations. The scores
    are read once, as counts of alike ones; the features are read of holdout rows
    only. Thresholds come from out-of-fold scores only.
    """
    rows = scored.filter("part = 'holdout'") if rows is None else rows
    by_fold = [*KEYS, "fold"]
    cells = written(M.score_cells(scored, [*by_fold, "part", "y", "p", "pred"]))
    oof, hold = cells.filter("part = 'oof'"), cells.filter("part = 'holdout'")
    fold_areas = M.curve_areas(M.curve_points(oof, group_cols=by_fold, n="n"), by_fold)
    fold_m = M.metrics_from_counts(M.confusion(oof, group_cols=by_fold, n="n")).join(
        fold_areas.withColumnRenamed("average_precision", "pr_auc"), by_fold, "left")
    fold_m = written(fold_m)
    sweep = written(M.threshold_sweep(oof, group_cols=KEYS, n="n"))
    best = M.best_threshold(sweep, KEYS).select(*KEYS, "threshold", F.lit(True).alias("best_by_f1"))
    points = written(M.curve_points(hold, group_cols=KEYS, n="n"))
    cm = written(M.confusion(hold, group_cols=KEYS, n="n"))
    boot = M.bootstrap_counts(cm, seed=seed, group_cols=KEYS).select(
        *KEYS, F.col("point_estimate").alias("f1_point"), F.col("ci_low").alias("f1_ci_low"),
        F.col("ci_high").alias("f1_ci_high"))
    areas = M.curve_areas(points, KEYS).withColumnRenamed("average_precision", "pr_auc")
    et = error_table(rows, features, keep=KEYS)
    return {
        "fold_metrics": fold_m,
        "cv_metrics": M.fold_aggregate(fold_m, FOLD_METRICS, KEYS),
        "test_metrics": M.metrics_from_counts(cm).join(areas, KEYS, "left").join(boot, KEYS, "left"),
        "confusion_matrix": M.confusion_shares(cm),
        "roc_curve": M.roc_from_points(points, KEYS),
        "pr_curve": M.pr_from_points(points, KEYS),
        "threshold_analysis": sweep.join(best, [*KEYS, "threshold"], "left").fillna(False, ["best_by_f1"]),
        "calibration": M.calibration(hold, group_cols=KEYS, n="n"),
        "error_analysis": error_profile(et, features, KEYS),
        "error_records": grouped_error_records(et, KEYS),
        "predictions": et,
    }


def own_features(df: DataFrame) -> DataFrame:
    """Rows of a feature that belongs to its experiment's feature set."""
    sets = F.create_map(*[x for e in C.EXPERIMENTS for x in (
        F.lit(e), F.array(*[F.lit(f) for f in FEATURE_SETS[e].feature_columns]))])
    return df.filter(F.array_contains(F.element_at(sets, F.col("experiment")), F.col("feature")))


def in_parallel(spark: SparkSession, fn, items: list, parallel: int) -> list:
    """``fn`` of each item, in order; up to ``parallel`` at a time, each in a thread
    of its own that only submits Spark jobs."""
    if parallel <= 1:
        return list(map(fn, items))
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))


class FoldConstants:
    """What the folds of several feature sets share, per fold and for all training
    rows: class sizes, and one preprocessor over the columns of all sets, of which
    each set takes its own. With ``cached``, the rows' columns in use are kept by
    column until ``release``; the order of rows and partitions stays."""

    def __init__(self, mf: DataFrame, sets: list, fold_col: str = "fold", parallel: int = 1, cached: bool = False):
        numeric = list(dict.fromkeys(f for fs in sets for f in fs.numeric_features))
        categorical = list(dict.fromkeys(f for fs in sets for f in fs.categorical_features))
        self.fold_col, self.cached = fold_col, cached
        columns = list(dict.fromkeys([C.ID, C.TARGET, "is_test", fold_col, *(c for fs in sets for c in fs.feature_columns)]))
        self.mf = mf.select(*columns).persist() if cached else mf
        self.train = self.mf.filter(~F.col("is_test"))
        sizes = {r[fold_col]: tuple(r)[1:] for r in self.train.groupBy(fold_col).agg(*MD.class_sizes(F.col(C.TARGET))).collect()}
        self.folds = sorted(sizes)
        self.all = tuple(map(sum, zip(*sizes.values())))
        # rows, positives and negatives of the other folds
        self.others = {k: tuple(a - b for a, b in zip(self.all, sizes[k])) for k in self.folds}
        # the constants of all folds come from the same few passes over the rows
        stats = PP.fold_statistics(self.train, fold_col, numeric, categorical, self.all[0] if self.all else 0)
        fit = lambda k, rows: PP.AuditPreprocessor(numericCols=numeric, categoricalCols=categorical).knowing(stats[k]).fit(rows)
        *self.preps, self.prep = [*(fit(k, self.own(k)) for k in self.folds), fit(None, self.train)]

    def own(self, k) -> DataFrame:
        return self.train.filter(F.col(self.fold_col) != k)

    def release(self) -> None:
        if self.cached:
            self.mf.unpersist()


class Folds:
    """The preprocessing of one feature set, fitted once per fold and once on all
    training rows, then shared by all models and settings. Only the fitted
    constants are kept: they are literals in each fold's plan over the one table
    of rows. ``shared`` holds them where several sets share them. With ``cached``,
    the training rows of each fold are kept from the first fit on until ``release``,
    for each model reads them several times; without, only while ``kept``."""

    def __init__(self, mf: DataFrame, fs, fold_col: str = "fold", parallel: int = 1, shared: FoldConstants | None = None,
                 cached: bool = False):
        self.fs, self.cached = fs, cached
        shared = shared or FoldConstants(mf, [fs], fold_col, parallel)
        self.n = shared.all[0] if shared.all else 0
        mine = [list(fs.numeric_features), list(fs.categorical_features)]
        self.prep = shared.prep.restricted(*mine)

        def training(prep, own, sizes):
            # class weights and labels from the fold's own training rows
            rows = prep.transform(MD.training_frame(own, sizes=sizes)).select(MD.LABEL, MD.WEIGHT, "features")
            return rows.persist() if cached else rows

        self.parts = []
        for k, prep in zip(shared.folds, shared.preps):
            prep = prep.restricted(*mine)
            held = prep.transform(shared.train.filter(F.col(fold_col) == k)).select(C.ID, fold_col, C.TARGET, "features")
            self.parts.append((k, training(prep, shared.own(k), shared.others[k]), shared.others[k][0], held))
        self.train = training(self.prep, shared.train, shared.all)
        self.test = self.prep.transform(shared.mf.filter(F.col("is_test"))).select(C.ID, C.TARGET, "features")

    @contextmanager
    def kept(self, rows: DataFrame):
        """The training rows of a fold, kept while models are fitted to them: each fit
        reads them two or three times. With ``cached`` they are kept longer."""
        if self.cached:
            yield
            return
        rows.persist()
        try:
            yield
        finally:
            rows.unpersist()

    def release(self) -> None:
        if self.cached:
            for rows in [self.train, *(p[1] for p in self.parts)]:
                rows.unpersist()


def fits_at_once(rows: int) -> int:
    """How many fits may run at a time, each of which keeps its own rows in memory:
    short jobs of small inputs wait on each other, large ones fill the cores alone."""
    return max(1, min(8, 30_000_000 // max(rows, 1)))


LOGISTIC_ROWS = 250_000


def setting_scores(models: list, held: DataFrame) -> DataFrame:
    """The held rows with the scores of each setting's model: one pass for all of them."""
    rows = [C.ID, "fold", F.col(C.TARGET).alias("y")]
    if len(models) == 1:
        return MD.scores(models[0].transform(held)).select(*rows, "p", "pred", F.lit(0).alias("setting"))
    scored, cells = held, []
    for i, m in enumerate(models):
        m.setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_probability{i}").setPredictionCol(f"_prediction{i}")
        scored = m.transform(scored)
        cells.append(F.struct(vector_to_array(f"_probability{i}")[1].alias("p"), (F.col(f"_prediction{i}") == 1.0).alias("pred"),
                              F.lit(i).alias("setting")))
    return scored.select(*rows, F.explode(F.array(*cells)).alias("s")).select(C.ID, "fold", "y", "s.p", "s.pred", "s.setting")


def tuned(folds: Folds, model_name: str, settings: list[dict], seed: int = C.SEED, parallel: int = 1):
    """M10 + M11: out-of-fold scores of every setting; the setting with the best
    mean fold F1 is refitted on all training rows, and its out-of-fold scores
    are kept (they need no second pass). Fits of settings and folds are
    independent: up to ``parallel`` run at a time, sharing the executors (fairly
    where spark.scheduler.mode is FAIR). Returns (model, best, search rows, oof)."""
    weighted = model_name in ("logistic_regression", "random_forest")

    def fit(i, rows, n):
        est = MD.with_reg(MD.classifier(model_name, settings[i], seed, weighted), n)
        # a line search step is one short job: few tasks, where the rows are few. A forest
        # depends on the partitions of its rows, which stay
        return est.fit(rows.coalesce(max(1, math.ceil(n / LOGISTIC_ROWS))) if model_name == "logistic_regression" else rows)

    # the settings of a fold share its kept rows; the folds take turns as far as fits fill the cores
    inner = max(1, min(parallel, len(settings)))

    def run(part):
        if part is None:
            with folds.kept(folds.train):
                return fit(0, folds.train, folds.n)
        _, rows, n, held = part
        with folds.kept(rows):
            models = in_parallel(held.sparkSession, lambda i: fit(i, rows, n), list(range(len(settings))), inner)
        return setting_scores(models, held)

    # the best of one setting is known: its last fit need not wait for those of the folds
    parts = in_parallel(folds.train.sparkSession, run, [*folds.parts, *[None] * (len(settings) == 1)], max(1, parallel // inner))
    refit = parts.pop() if len(settings) == 1 else None
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    scored = written(scored)
    f1 = M.metrics_from_counts(M.confusion(scored, group_cols=["setting", "fold"])).groupBy("setting").agg(
        F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std")).orderBy("setting").collect()
    search = [{"setting": r["setting"], "params": settings[r["setting"]], "mean_test_score": r["mean"],
               "std_test_score": r["std"]} for r in f1]
    best = max(search, key=lambda r: (r["mean_test_score"], -r["setting"]))
    if refit is None:
        with folds.kept(folds.train):
            refit = fit(best["setting"], folds.train, folds.n)
    model = PipelineModel(stages=[folds.prep, refit])
    return model, best, (search if len(settings) > 1 else []), scored.filter(F.col("setting") == best["setting"]).drop("setting")


def run_combination(spark: SparkSession, mf: DataFrame, folds: Folds, experiment: str, model_name: str, settings: list[dict],
                    seed: int, shap_rows: int | None, permutation_repeats: int, parallel: int) -> tuple:
    """One combination tuned, scored and explained: (spec, pipeline, {table: rows})."""
    from leakscope.operators.attribution import global_mean_abs, permutation_importance, tree_attributions
    from leakscope.operators.split import fixed_sample
    test = mf.filter(F.col("is_test"))
    model, best, search, oof = tuned(folds, model_name, settings, seed, parallel)
    hold = MD.scores(model.stages[-1].transform(folds.test)).select(
        C.ID, F.lit(None).cast("int").alias("fold"), F.col(C.TARGET).alias("y"), "p", "pred")
    tables = {"scores": oof.withColumn("part", F.lit("oof")).unionByName(hold.withColumn("part", F.lit("holdout")))}
    imp = MD.model_importance(model)
    if imp:
        tables["feature_importance"] = spark.createDataFrame(imp, "feature STRING, importance DOUBLE")
    if permutation_repeats and model_name != "dummy_most_frequent":
        tables["permutation_importance"] = permutation_importance(
            model, test, folds.fs.feature_columns, n_repeats=permutation_repeats, seed=seed)
    if model_name in ("random_forest", "xgboost"):
        rows = test if shap_rows is None else fixed_sample(test, shap_rows, seed)
        names = folds.prep.feature_names()
        tables["shap_summary"] = global_mean_abs(tree_attributions(folds.prep.transform(rows), model.stages[-1], names), names)
    spec = {"experiment": experiment, "model": model_name, "best": best["params"], "search": search}
    return spec, model, {k: _tag(t, experiment, model_name) for k, t in tables.items()}


def rows_digest(mf: DataFrame) -> list:
    """Count and checksum of the modelling rows, for the ledger's key."""
    return list(mf.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*sorted(mf.columns)))).first())


def run_grid(spark: SparkSession, mf: DataFrame, root: str, experiments: list[str], models: list[str],
             settings: dict | None = None, seed: int = C.SEED, n_iter: int = C.N_ITER, shap_rows: int | None = None,
             permutation_repeats: int = 20, dataset_path: str | None = None, provenance: dict | None = None,
             prepared: dict | None = None, parallel: int = 1) -> dict:
    """Tune, score and explain each combination, then write all artifacts
    in one grouped pass and commit them as one run. A combination's outputs go to
    the ledger when it is done; a grid that was stopped takes them from there if
    rows, settings and seed are the same. ``prepared`` may hold ``Folds`` of ``mf``
    by experiment. Up to ``parallel`` fits run at a time. Returns {(experiment, model):
    fitted pipeline}."""
    from leakscope.operators.clean import verify_grain
    verify_grain(mf, [C.ID])
    digest = rows_digest(mf)
    for e in experiments:
        assert_no_lineage_leakage(mf, get_feature_set(e))

    def ledger(e: str, m: str) -> tuple:
        own = (settings or {}).get(m) or MD.search_settings(m, n_iter, seed)
        return own, R.Ledger(spark, root, R.ledger_key(
            rows=digest, experiment=e, features=get_feature_set(e).feature_columns, model=m, settings=own, seed=seed, folds=C.N_FOLDS,
            shap_rows=shap_rows, repeats=permutation_repeats))

    entries = {e: [(m, *ledger(e, m)) for m in models] for e in experiments}
    unfinished = [e for e in experiments if any(entry.done() is None for _, _, entry in entries[e])]
    fresh = [e for e in unfinished if e not in (prepared or {})]
    # two fits of each experiment at a time, if that many may run; copies of rows are
    # kept where several fits may run at a time, so not of large inputs
    at_once = max(1, min(len(experiments), parallel // 2))
    inner, cached = max(1, parallel // at_once), parallel > 1
    shared = FoldConstants(mf, [get_feature_set(e) for e in fresh], parallel=parallel, cached=cached) if fresh else None

    def train(e: str) -> None:
        """Trains the combinations of one experiment that the ledger lacks."""
        rows = shared.mf if e in fresh else mf
        folds = Folds(mf, get_feature_set(e), shared=shared, cached=cached) if e in fresh else prepared[e]
        try:
            for m, own, entry in entries[e]:
                if entry.done() is None:
                    entry.keep(*run_combination(spark, rows, folds, e, m, own, seed, shap_rows, permutation_repeats, inner))
        finally:
            if e in fresh:
                folds.release()

    try:
        in_parallel(spark, train, unfinished, at_once)
    finally:
        if shared:
            shared.release()
    fitted, specs, tables = {}, [], {}
    for e in experiments:
        for _, _, entry in entries[e]:
            spec = entry.done()
            fitted[spec["experiment"], spec["model"]] = entry.model()
            specs.append(spec)
            for name in spec["tables"]:
                tables.setdefault(name, []).append(entry.table(name))
    features = list(dict.fromkeys(f for e in experiments for f in FEATURE_SETS[e].numeric_features))
    stacked = {name: _stacked(parts) for name, parts in tables.items()}
    scored = stacked.pop("scores")
    rows = written(scored.filter("part = 'holdout'").join(mf.filter("is_test").select(C.ID, *features), C.ID))
    out = artifacts_from_scores(scored, features, seed, rows) | stacked
    out["error_analysis"] = own_features(out["error_analysis"])
    counts = mf.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).first()
    out["metadata"] = metadata(spark, specs, counts["n"], counts["t"], seed, dataset_path, provenance)
    write_artifacts(out, root, fitted)
    return fitted


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_one(spark: SparkSession, mf: DataFrame, root: str, experiment: str, model_name: str, **options) -> PipelineModel:
    """M20 for one combination; see ``run_grid``."""
    return run_grid(spark, mf, root, [experiment], [model_name], **options)[experiment, model_name]


def run_all(spark: SparkSession, mf: DataFrame, root: str, experiments: list[str] | None = None,
            models: list[str] | None = None, **options) -> DataFrame:
    """M20 grid + S8: every requested combination, then the summary."""
    run_grid(spark, mf, root, experiments or C.EXPERIMENTS, models or C.MODELS, **options)
    return run_summary(spark, root)


def _tag(df: DataFrame, experiment: str, model: str) -> DataFrame:
    return df.withColumn("experiment", F.lit(experiment)).withColumn("model", F.lit(model))


def write_artifacts(artifacts: dict[str, DataFrame], root: str, models: dict | None = None) -> None:
    """All tables (and models by combination) of a run, then one commit; the
    combinations are those of the ``metadata`` table."""
    spark = artifacts["metadata"].sparkSession
    run = R.new_run()
    R.stage(artifacts, root, run)
    for (e, m), model in (models or {}).items():
        model.write().save(f"{root}/models/run={run}/{e}/{m}")
    combinations = [tuple(r) for r in artifacts["metadata"].select(*KEYS).collect()]
    R.commit(spark, root, run, combinations, list(artifacts))


def read_artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The committed rows of an artifact table; a missing table is an error."""
    return R.read_table(spark, root, name)


def run_summary(spark: SparkSession, root: str) -> DataFrame:
    """One row per executed combination (stacked partitions)."""
    tm = read_artifact(spark, root, "test_metrics")
    cv = read_artifact(spark, root, "cv_metrics").filter(F.col("metric") == "f1")
    return tm.join(cv.select("experiment", "model", F.col("mean").alias("cv_f1_mean"), F.col("std").alias("cv_f1_std")),
                   ["experiment", "model"], "left").select(
        "experiment", "model", "cv_f1_mean", "cv_f1_std", F.col("f1").alias("test_f1"),
        F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"),
        F.col("roc_auc").alias("test_roc_auc"), F.col("pr_auc").alias("test_pr_auc"))


# --- S9 registry -----------------------------------------------------------------------------
def new_model_version() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")


def save_model(spark: SparkSession, model: PipelineModel, root: str, name: str, version: str, metadata: dict) -> str:
    path = f"{root}/registry/{name}/{version}"
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(name, version, json.dumps(metadata, default=str))],
                          "model_name STRING, version STRING, metadata STRING") \
        .write.mode("overwrite").parquet(f"{path}/metadata")
    return path


def load_model(root: str, name: str, version: str) -> PipelineModel:
    path = f"{root}/registry/{name}/{version}/model"
    try:
        return PipelineModel.load(path)
    except (AnalysisException, Py4JJavaError) as exc:
        if "does not exist" not in str(exc) and "PATH_NOT_FOUND" not in str(exc):
            raise
        raise MissingInputError(f"registry: no model {name}/{version}") from exc


def registered_models(spark: SparkSession, root: str) -> DataFrame:
    """(model_name, version, metadata) of every entry that has a model,
    sorted; metadata without a saved model beside it is left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/registry/*/*/model/metadata")
    models = {tuple(s.getPath().toString().split("/")[-4:-2]) for s in at.getFileSystem(conf).globStatus(at) or []}
    ddl = "model_name STRING, version STRING, metadata STRING"
    if not models:
        return spark.createDataFrame([], ddl)
    meta = spark.read.schema(ddl).parquet(f"{root}/registry/*/*/metadata")
    have = spark.createDataFrame(sorted(models), "model_name STRING, version STRING")
    return meta.join(have, ["model_name", "version"], "left_semi").orderBy("model_name", "version")


# --- M17 batch scoring -------------------------------------------------------------------
def batch_predict(model: PipelineModel, rows: DataFrame, version: str, allowed: list[str] | None = None) -> DataFrame:
    """Score raw flat rows: unknown columns are rejected, missing ones become
    null, derived features are added, then the saved pipeline is applied."""
    allowed = allowed or [c for c in C.FLAT_COLUMNS if c != C.TARGET]
    extra = sorted(set(rows.columns) - set(allowed))
    if extra:
        raise ValueError(f"unknown input field(s): {extra}")
    from leakscope.sources.schemas import FLAT_DDL
    types = {f.split(" ")[0]: f.split(" ")[1] for f in FLAT_DDL.split(", ")}
    full = rows.select(*[F.col(c).cast(types[c]).alias(c) if c in rows.columns
                         else F.lit(None).cast(types[c]).alias(c) for c in allowed])
    scored = MD.scores(model.transform(add_derived_features(full)))
    return scored.select(C.ID, "p", "pred", F.when(F.col("pred"), C.LABEL_TRUE).otherwise(C.LABEL_FALSE)
                         .alias("predicted_class"), F.lit(version).alias("model_version"))


# --- M18 / M19 -----------------------------------------------------------------------------
def reevaluate(spark: SparkSession, root: str, mf: DataFrame) -> DataFrame:
    """Re-score every registered classifier that recorded a test size on the
    re-derived holdout (the hash split is stable by construction)."""
    out = []
    for r in registered_models(spark, root).collect():
        meta = json.loads(r["metadata"])
        if "test_size" not in meta:
            continue
        model = load_model(root, r["model_name"], r["version"])
        s = MD.scores(model.transform(mf.filter(F.col("is_test")))).withColumn("y", F.col(C.TARGET))
        m = one_row(M.metrics_from_counts(M.confusion(s)), M.roc_auc(s))
        out.append(m.select(F.lit(r["model_name"]).alias("model_name"), F.lit(r["version"]).alias("version"), "*"))
    if not out:
        return spark.createDataFrame([], "model_name STRING, version STRING")
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


LEGACY = {"logistic_regression": {"C": 1.0, "max_iter": 1000},
          "random_forest": {"n_estimators": 200},
          "xgboost": {}}


def train_legacy(spark: SparkSession, mf: DataFrame, root: str, seed: int = C.SEED,
                 params: dict | None = None) -> DataFrame:
    """Three untuned models on set A, one split, holdout metrics,
    each saved to the registry. The boosted model weights positives by
    neg/pos (1.0 without positives)."""
    fs = FEATURE_SETS["original"]
    train, test = mf.filter(~F.col("is_test")), mf.filter(F.col("is_test"))
    tf = MD.training_frame(train)
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(C.TARGET)).alias("pos"), F.count_if(~F.col(C.TARGET)).alias("neg")).first()
    spw = stats["neg"] / stats["pos"] if stats["pos"] else 1.0
    n, prep = stats["n"], MD.preprocessor(fs).fit(train)  # the same for every model
    held = prep.transform(test)
    version = new_model_version()
    rows = []
    for name, p in (params or LEGACY).items():
        if name == "xgboost":
            frame = tf.withColumn(MD.WEIGHT, F.when(F.col(C.TARGET), F.lit(spw)).otherwise(F.lit(1.0)))
            est = MD.classifier(name, p, seed, weighted=False)
            est.setWeightCol(MD.WEIGHT)
        else:
            frame = tf
            est = MD.with_reg(MD.classifier(name, p, seed), n)
        model = PipelineModel(stages=[prep, est.fit(prep.transform(frame))])
        s = written(M.score_cells(MD.scores(model.stages[-1].transform(held)).withColumn("y", F.col(C.TARGET)), ["y", "p", "pred"]))
        m = one_row(M.metrics_from_counts(M.confusion(s, n="n")), M.curve_areas(M.curve_points(s, n="n"))).first().asDict()
        save_model(spark, model, root, name, version, {"test_size": C.TEST_SIZE, "seed": seed, "metrics": m,
                                                         "feature_columns": fs.feature_columns})
        rows.append((name, version, m["accuracy"], m["precision"], m["recall"], m["f1"], m["roc_auc"],
                     m["average_precision"], m["tn"], m["fp"], m["fn"], m["tp"]))
    return spark.createDataFrame(rows, "model STRING, version STRING, accuracy DOUBLE, precision DOUBLE, "
                                       "recall DOUBLE, f1 DOUBLE, roc_auc DOUBLE, pr_auc DOUBLE, tn BIGINT, "
                                       "fp BIGINT, fn BIGINT, tp BIGINT")
