"""Quality classifier: a sparse rule ensemble (RuleFit).

Every text is reduced to a few statistics. Shallow trees are grown on a
labelled sample; the paths from their roots become conjunctive rules such as
"symbols > 0.1 and uppercase <= 0.4". A logistic regression with a lasso
penalty weighs the rules, most of them with zero, and the rest are compiled to
Spark column expressions, so scoring is a projection without a model object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from leakscope.session import materialize

from .common import NO_ID, fresh

STATS = ("log_words", "mean_word", "symbols", "pipes", "exclaims", "upper", "digits", "punctuation",
         "dup_lines", "distinct_words", "words_per_line", "wide_chars")
SAMPLE, TREES, DEPTH, LASSO, SEED, CUT = 20_000, 20, 3, 0.002, 7, 0.3
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>@^~=_{}[]\\", np.uint8))
PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b".,;:?!'\"()-", np.uint8))


def text_statistics(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = int(hist[65:91].sum() + hist[97:123].sum())
    share = lambda x: float(x) / chars
    return (float(np.log1p(n)), chars / n, share(hist[SYMBOLS].sum()), share(hist[124]), share(hist[33]),
            float(hist[65:91].sum()) / max(1, letters), share(hist[48:58].sum()), share(hist[PUNCTUATION].sum()),
            1 - len(set(lines)) / len(lines), len(set(words)) / n, n / len(lines), share(hist[128:].sum()))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a column per statistic), a row per row of ``docs``; a null text counts as empty."""
    schema = StructType([StructField("doc_id", LongType())] + [StructField(s, DoubleType()) for s in STATS])

    def run(batches):
        for batch in batches:
            rows = [text_statistics(t.as_py() or b"") for t in batch.column(1)]
            columns = np.array(rows, np.float64).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", *STATS])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def paths(forest) -> list[tuple[tuple[str, str, float], ...]]:
    """The distinct conjunctions on the ways from the roots to every node."""
    nodes = forest._call_java("trees")
    found: dict = {}

    def walk(node, conditions):
        if conditions:
            found.setdefault(tuple(sorted(conditions)), None)
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, at = STATS[split.featureIndex()], round(split.threshold(), 9)
        for sign, child in (("<=", node.leftChild()), (">", node.rightChild())):
            walk(child, tighter(conditions, (name, sign, at)))

    for tree in nodes:
        walk(tree.rootNode(), ())
    return list(found)


def tighter(conditions, new):
    """Conditions with ``new``; of two bounds on one side of a statistic only the narrower stays."""
    name, sign, at = new
    rest = tuple(c for c in conditions if c[:2] != (name, sign))
    bounds = [at] + [c[2] for c in conditions if c[:2] == (name, sign)]
    return (*rest, (name, sign, min(bounds) if sign == "<=" else max(bounds)))


def rule_column(rule):
    out = F.lit(True)
    for name, sign, at in rule:
        out = out & ((F.col(name) <= F.lit(at)) if sign == "<=" else (F.col(name) > F.lit(at)))
    return out.cast("double")


class RuleEnsemble:
    """Weighted rules; ``score`` is the column of their probability of label 1."""

    def __init__(self, intercept: float, rules: list[tuple[tuple, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self):
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.lit(weight) * rule_column(rule)
        return 1 / (1 + F.exp(-total))


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> RuleEnsemble:
    """From (label double, the statistics). With no label, or labels of one kind
    only, the ensemble is the constant share of label 1 (0.5 without labels)."""
    n, ones = sample.agg(F.count("label"), F.sum("label")).first()
    if not n or not 0 < ones < n:
        share = min(max((ones + 1) / (n + 2) if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleEnsemble(float(np.log(share / (1 - share))), [])
    vectors = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(sample)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5,
                                    featureSubsetStrategy="onethird").fit(vectors.select("label", "features"))
    rules = paths(forest)
    if not rules:
        return RuleEnsemble(float(np.log(ones / (n - ones))), [])
    names = [f"r{i}" for i in range(len(rules))]
    matrix = sample.select("label", *[rule_column(r).alias(c) for r, c in zip(rules, names)])
    # The rarer label weighs as much as the commoner one up to a factor, so that scores stay probabilities.
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(
        VectorAssembler(inputCols=names, outputCol="features").transform(matrix).select("label", "features"))
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def held_out(id_col="doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality", **options) -> RuleEnsemble:
    """Fit on the labelled rows that are not held out, at most ``sample`` of them
    (those with the smallest hash of their id, so any sample is the same).

    An id labelled more than once counts if its labels agree.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("lid"), F.col(label_col).cast("double").alias("label"))
             .where("lid is not null and label in (0.0, 1.0)").groupBy("lid")
             .agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
             .where(~held_out("lid")).orderBy(F.xxhash64("lid"), "lid").limit(sample))
    rows = stats.join(F.broadcast(known), F.col("doc_id") == F.col("lid")).dropDuplicates(["lid"])
    return fit(materialize(rows.select("label", *STATS).coalesce(4)), **options)


def score(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text",
          **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    Null and empty texts have zero for every statistic and get a score like
    any other. Only statistics of the text enter a score. Rows with a null id are
    scored, never learnt from.
    """
    stats = materialize(measured(docs, id_col, text_col))
    model = train(stats, labels, **options)
    return (stats.withColumn("score", model.score())
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text",
              **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected. Rows that share an id stand or fall together, by their best score."""
    key, bad = fresh(docs, "key"), fresh(docs, "bad")
    verdict = (score(docs, labels, cut, id_col, text_col, **options)
               .groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias(bad)).agg(F.max("predicted").alias("p"))
               .where("p = 0").select(bad))
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    return keyed.join(verdict, keyed[key] == verdict[bad], "left_anti").select(*docs.columns)
