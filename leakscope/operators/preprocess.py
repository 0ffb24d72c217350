"""M1–M5: imputation, scaling and one-hot encoding fitted on training rows
only, as a ``pyspark.ml`` Estimator so that ``Pipeline`` and
``CrossValidator`` refit it per fold.

Fitted statistics are plain aggregates:
* median per numeric feature, exact (numpy-linear) through the grouped
  order-statistic primitive; NaN and null are skipped;
* most frequent category, ties broken by the smallest value;
* population mean and standard deviation of the imputed values; a zero
  deviation scales by 1;
* categories seen in training, alphabetical; the category is imputed with
  the mode first, and a category never seen in training encodes as zeros.

The fitted model is a set of literals applied with column expressions
(whole-stage codegen), then one ``VectorAssembler``.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from operator import or_

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.operators.rank import grouped_order_stats, grouped_quantiles


ACCURACY = 10000


def fit_medians(train: DataFrame, features: list[str]) -> dict[str, float | None]:
    """M1: exact median per feature over the training rows. One aggregate over all
    features finds approximate quantiles on both sides of each median, a second one
    counts the values below and between them; only the values between (a few in ten
    thousand, and ties) are told apart to find the one at the median's rank."""
    if not features:
        return {}
    value = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    near = [0.5 - 3 / ACCURACY, 0.5 + 3 / ACCURACY]
    row = train.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(value.values())],
                    *[F.percentile_approx(v, near, ACCURACY).alias(f"e{i}") for i, v in enumerate(value.values())]).first()
    sizes = {f: row[f"n{i}"] for i, f in enumerate(features)}
    ends = {f: row[f"e{i}"] for i, f in enumerate(features) if sizes[f]}
    if not ends:
        return {f: None for f in features}
    inside = {f: value[f].between(lo, hi) for f, (lo, hi) in ends.items()}
    row = train.agg(*[F.count_if(value[f] < ends[f][0]).alias(f"b{i}") for i, f in enumerate(ends)],
                    *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(inside.values())]).first()
    got: dict = {}
    ranks, counts, rest = {}, {}, []
    for i, f in enumerate(ends):
        below, n = row[f"b{i}"], row[f"c{i}"]
        own = {math.floor((sizes[f] - 1) / 2), math.ceil((sizes[f] - 1) / 2)}
        if not all(below <= r < below + n for r in own):
            rest.append(f)
        elif ends[f][0] == ends[f][1]:
            got[f] = float(ends[f][0])
        else:
            ranks[f,], counts[f,] = {r - below for r in own}, n
    if ranks:
        # most rows lie between no ends and are left out before they are stacked
        close = train.filter(reduce(or_, [inside[f] for f, in ranks]))
        found = grouped_order_stats(_long(close, {f: F.when(inside[f], value[f]) for f, in ranks}), ["feature"], ranks, sizes=counts)
        for (f,), own in ranks.items():
            a, b = found[(f,), min(own)], found[(f,), max(own)]
            got[f] = float(a if a == b else b - (b - a) * 0.5)
    if rest:
        long = _long(train, {f: value[f] for f in rest})
        got |= {r["feature"]: r["value"] for r in grouped_quantiles(long, ["feature"], "v", [0.5]).collect()}
    return {f: got.get(f) for f in features}


def _median_ends(train: DataFrame, value: dict, rows: int) -> dict:
    """Per feature approximate quantiles on both sides of the medians of all rows and of
    all rows but one fold: the latter lie about 0.25 / sqrt(rows) of the ranks away."""
    reach = min(0.5, 3 / ACCURACY + 1.25 / math.sqrt(max(rows, 1)))
    row = train.agg(*[F.percentile_approx(v, [0.5 - reach, 0.5 + reach], ACCURACY).alias(f"e{i}") for i, v in enumerate(value.values())]).first()
    return {f: row[f"e{i}"] for i, f in enumerate(value) if row[f"e{i}"]}


def fold_statistics(train: DataFrame, fold_col: str, numeric: list[str], categorical: list[str], rows: int = 0) -> dict:
    """{fold: statistics of the rows of the other folds} and, under None, those of all
    rows: what ``AuditPreprocessor`` fits to each, from passes over the rows that all
    share. Counts and moments are taken once per fold and added up on the driver; the
    medians lie near one another, so one pair of ends serves all. ``rows``: about how
    many there are; medians that the ends miss are fitted by themselves."""
    x = {f: F.col(f).cast("double") for f in numeric}
    value = {f: F.when(~F.isnan(c), c) for f, c in x.items()}
    ends = _median_ends(train, value, rows) if numeric else {}
    inside = {f: value[f].between(lo, hi) for f, (lo, hi) in ends.items()}
    none = F.lit(0).cast("bigint")
    cells = [F.struct(
        F.count(value[f]).alias("n"), (F.count_if(value[f] < ends[f][0]) if f in ends else none).alias("below"),
        (F.count_if(inside[f]) if f in ends else none).alias("inside"), F.count(c).alias("own"), F.sum(c).alias("sum"),
        F.var_pop(c).alias("var"), F.min(c).alias("min"), F.max(c).alias("max")).alias(f"s{i}") for i, (f, c) in enumerate(x.items())]
    by_fold = {r[fold_col]: r for r in train.groupBy(fold_col).agg(F.count(F.lit(1)).alias("rows"), *cells).collect()}
    folds = [*sorted(k for k in by_fold if k is not None), None]
    # a row without a fold is of no fold's own rows (a comparison with null), but of all
    parts = {k: [r for j, r in by_fold.items() if k is None or (j is not None and j != k)] for k in folds}
    medians: dict = {k: {} for k in folds}
    ranks, counts, rest = {}, {}, {}
    for i, f in enumerate(numeric):
        for k in folds:
            n, below, near = (sum(r[f"s{i}"][c] for r in parts[k]) for c in ("n", "below", "inside"))
            own = {math.floor((n - 1) / 2), math.ceil((n - 1) / 2)}
            if not n:
                medians[k][f] = None
            elif not all(below <= r < below + near for r in own):
                rest.setdefault(k, []).append(f)
            elif ends[f][0] == ends[f][1]:
                medians[k][f] = float(ends[f][0])
            else:
                key = (f, -1 if k is None else k)
                ranks[key], counts[key] = {r - below for r in own}, near
    if ranks:
        open_ = list(dict.fromkeys(f for f, _ in ranks))
        close = train.filter(reduce(or_, [inside[f] for f in open_]))
        others = F.filter(F.array(*[F.lit(-1 if k is None else k) for k in folds]), lambda k: (k == -1) | (k != F.col(fold_col)))
        long = _long(close, {f: F.when(inside[f], value[f]) for f in open_}, others.alias("of"))
        found = grouped_order_stats(long.select("feature", F.explode("of").alias("of"), "v"), ["feature", "of"], ranks, sizes=counts)
        for (f, k), own in ranks.items():
            a, b = found[(f, k), min(own)], found[(f, k), max(own)]
            medians[None if k == -1 else k][f] = float(a if a == b else b - (b - a) * 0.5)
    for k, missed in rest.items():
        medians[k] |= fit_medians(train if k is None else train.filter(F.col(fold_col) != k), missed)
    seen = {c: [(r[fold_col], r[c], r["n"]) for r in train.filter(F.col(c).isNotNull()).groupBy(fold_col, c).agg(F.count(F.lit(1)).alias("n")).collect()]
            for c in categorical}
    out = {}
    for k in folds:
        stats = {"medians": {f: medians[k][f] for f in numeric}, "modes": {}, "means": {}, "scales": {}, "categories": {}}
        for i, f in enumerate(numeric):
            stats["means"][f], stats["scales"][f] = _moments([(r[f"s{i}"], r["rows"]) for r in parts[k]], medians[k][f])
        for c in categorical:
            n: dict = {}
            for j, v, m in seen[c]:
                if k is None or (j is not None and j != k):
                    n[v] = n.get(v, 0) + m
            stats["modes"][c] = min(n, key=lambda v: (-n[v], v)) if n else None
            stats["categories"][c] = sorted(n)
        out[k] = stats
    return out


def _moments(parts: list, median: float | None) -> tuple:
    """Mean and scale of the imputed values of some folds: (cell, rows) each."""
    groups = [(c["own"], c["sum"], c["var"], c["min"], c["max"]) for c, _ in parts if c["own"]]
    missing = sum(rows - c["own"] for c, rows in parts)
    if missing and median is not None:
        groups.append((missing, missing * median, 0.0, median, median))
    n = sum(g[0] for g in groups)
    if not n:
        return None, 1.0
    mean = sum(g[1] for g in groups) / n
    if min(g[3] for g in groups) == max(g[4] for g in groups):
        return mean, 1.0
    deviation = math.sqrt(sum(m * (var + (s / m - mean) ** 2) for m, s, var, _, _ in groups) / n)
    return mean, deviation if deviation != 0.0 else 1.0


def _long(df: DataFrame, columns: dict, *keep) -> DataFrame:
    """(feature, v) rows of the non-null values of some columns, with the columns ``keep``."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("v")) for f, c in columns.items()])
    return df.select(*keep, F.explode(F.filter(cells, lambda s: s["v"].isNotNull())).alias("s")).select("*", "s.feature", "s.v").drop("s")


def mode_table(train: DataFrame, col: str) -> DataFrame:
    """M2 as a query: the most frequent value and its count (ties: least value)."""
    counts = train.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(col).asc()).limit(1)


def fit_modes(train: DataFrame, cols: list[str]) -> dict[str, str | None]:
    out = {}
    for c in cols:
        row = mode_table(train, c).first()
        out[c] = None if row is None else row[c]
    return out


def impute(df: DataFrame, medians: dict, modes: dict) -> DataFrame:
    cols = {f: F.coalesce(F.col(f).cast("double"), F.lit(m).cast("double")) for f, m in medians.items()}
    cols.update({c: F.coalesce(F.col(c), F.lit(m)) for c, m in modes.items()})
    return df.withColumns(cols)


def fit_scaler(imputed: DataFrame, features: list[str]) -> tuple[dict, dict]:
    """M3: mean and population std per feature of the imputed training
    values; a zero std is replaced by 1. One aggregate pass."""
    if not features:
        return {}, {}
    row = imputed.agg(*[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
                      *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)]).first()
    means = {f: row[f"m_{i}"] for i, f in enumerate(features)}
    scales = {f: (row[f"s_{i}"] if row[f"s_{i}"] not in (None, 0.0) else 1.0) for i, f in enumerate(features)}
    return means, scales


def fit_categories(imputed: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """M4: categories per column seen in training, alphabetical (small)."""
    out = {}
    for c in cols:
        out[c] = [r[c] for r in imputed.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).collect()]
    return out


def output_names(numeric: list[str], categories: dict[str, list[str]]) -> list[str]:
    names = [f"numeric__{f}" for f in numeric]
    for c, cats in categories.items():
        names += [f"categorical__{c}_{v}" for v in cats]
    return names


class _PrepParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric input columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical input columns",
                            TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector output column", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], outputCol="features")


class AuditPreprocessor(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """M5: the preprocessor of one feature set; the categorical part only
    when the set has one."""

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, outputCol="features"):
        super().__init__()
        self._set(**self._input_kwargs)

    def knowing(self, stats: dict) -> "AuditPreprocessor":
        """An estimator whose fitted statistics of the rows to come are known (``fold_statistics``)."""
        self._known = stats
        return self

    def _fit(self, df: DataFrame) -> "AuditPreprocessorModel":
        num = self.getOrDefault(self.numericCols)
        cat = self.getOrDefault(self.categoricalCols)
        known = getattr(self, "_known", None)
        if known is not None:
            return AuditPreprocessorModel(numericCols=num, categoricalCols=cat,
                                          outputCol=self.getOrDefault(self.outputCol), stats=json.dumps(known))
        medians = fit_medians(df, num)
        modes = fit_modes(df, cat)
        imputed = impute(df.select(*num, *cat), medians, modes)
        means, scales = fit_scaler(imputed, num)
        cats = fit_categories(imputed, cat)
        stats = {"medians": medians, "modes": modes, "means": means, "scales": scales, "categories": cats}
        m = AuditPreprocessorModel(numericCols=num, categoricalCols=cat,
                                   outputCol=self.getOrDefault(self.outputCol), stats=json.dumps(stats))
        return m


class AuditPreprocessorModel(Model, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    stats = Param(Params._dummy(), "stats", "fitted statistics as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, outputCol="features", stats="{}"):
        super().__init__()
        self._setDefault(stats="{}")
        self._set(**self._input_kwargs)

    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.stats))

    def restricted(self, numeric: list[str], categorical: list[str]) -> "AuditPreprocessorModel":
        """The model of some of the columns. A column's constants do not depend on the
        others, so it is what a fit on these columns alone gives."""
        stats = self.fitted()
        own = {k: {c: v[c] for c in (categorical if k in ("modes", "categories") else numeric)} for k, v in stats.items()}
        return AuditPreprocessorModel(numericCols=numeric, categoricalCols=categorical,
                                      outputCol=self.getOrDefault(self.outputCol), stats=json.dumps(own))

    def feature_names(self) -> list[str]:
        s = self.fitted()
        return output_names(self.getOrDefault(self.numericCols), s["categories"])

    def expressions(self) -> list:
        s = self.fitted()
        exprs = []
        for f in self.getOrDefault(self.numericCols):
            x = F.coalesce(F.col(f).cast("double"), F.lit(s["medians"][f]).cast("double"))
            x = (x - F.lit(s["means"][f])) / F.lit(s["scales"][f])
            exprs.append(x.alias(f"numeric__{f}"))
        for c in self.getOrDefault(self.categoricalCols):
            v = F.coalesce(F.col(c), F.lit(s["modes"][c]))
            for cat in s["categories"][c]:
                exprs.append(F.when(v == F.lit(cat), 1.0).otherwise(0.0).alias(f"categorical__{c}_{cat}"))
        return exprs

    def transformed_columns(self, df: DataFrame) -> DataFrame:
        """The named, transformed columns (no vector) next to the input."""
        return df.select("*", *self.expressions())

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.feature_names()
        wide = self.transformed_columns(df)
        out = VectorAssembler(inputCols=names, outputCol=self.getOrDefault(self.outputCol),
                              handleInvalid="keep").transform(wide)
        return out.drop(*names)
