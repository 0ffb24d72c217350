"""URL filters: allow and block rules, and boosted trees for the URLs without a rule.

The URLs that a rule judges are the labelled ones. Gradient-boosted trees learn
from a bounded sample of the different ones of each label on lexical features: length, depth, digit ratio,
entropy, parameter counts and the shares of blocked URLs under the host's suffix
and under the path's first segment. The shares are counted over all labelled rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.session import materialize

from .common import fresh

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
MOST_RULES = 1_000  # rules are one expression; that bounds its size
SAMPLE, ROUNDS, DEPTH, SEED = 20_000, 20, 4, 11
PRIOR = 20.0  # rows that the overall share counts as
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "query_length",
            "n_hyphens", "n_labels", "longest_label", "suffix_share", "segment_share")
SHARES = ("suffix", "segment")


def parts(url):
    """(host, path) columns of a url column; both empty without ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    empty = lambda c: F.when(url.contains("://"), c).otherwise(F.lit(""))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return empty(lower), empty(path)


def matched(rules, host, path):
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(df: DataFrame, url: str, host: str, path: str, prefix: str) -> DataFrame:
    """``df`` with the features that need no statistics, named with ``prefix``, and the host's suffix and the path's first segment."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    labels = F.split(F.col(host), r"\.")
    values = {
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "depth": count(F.col(path), "/"), "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n, "entropy": entropy,
        "n_params": F.when(query != "", count(query, "&") + 1).otherwise(0), "query_length": F.length(query),
        "n_hyphens": count(u, "-"), "n_labels": F.size(labels),
        "longest_label": F.array_max(F.transform(labels, F.length))}
    out = {prefix + k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()}
    out[prefix + "suffix"] = F.element_at(labels, -1)
    out[prefix + "segment"] = F.regexp_extract(F.col(path), "^/([^/]*)", 1)
    return df.withColumns(out)


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE, rounds: int = ROUNDS, depth: int = DEPTH,
          url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_score.

    The longest fitting rule decides. Other URLs, null and empty ones too, are
    blocked where the trees give blocking over half; where the rules label no
    URL, or all alike, that label (allow without any) is the trees' verdict.
    Repeated rows get equal verdicts. Other columns pass through; columns named
    like the results are replaced.
    """
    base = pages.drop("host", "path", "rule", "verdict", "block_score")
    hit, pre = fresh(base, "hit"), fresh(base, "f_")
    f = {name: pre + name for name in FEATURES}
    host, path = parts(F.col(url_col))
    split = base.withColumns({"host": host, "path": path}).withColumn(hit, matched(rules, F.col("host"), F.col("path")))
    split = lexical(split, url_col, "host", "path", pre)

    labelled = split.where(F.col(hit).isNotNull()).select(
        F.col(url_col).alias("url"), "host", "path", (F.col(f"{hit}.verdict") == "block").cast("double").alias("label"),
        *[pre + s for s in SHARES])
    counts = {r["label"]: r for r in labelled.groupBy("label").agg(
        F.count("*").alias("n"), F.countDistinct("url").alias("urls")).collect()}
    n = sum(r["n"] for r in counts.values())
    overall = counts[1.0]["n"] / n if 1.0 in counts else 0.0

    def with_share(df):
        for k in SHARES:
            key, share = f"{pre}{k}_key", f"{pre}{k}_share"
            table = labelled.groupBy(F.col(pre + k).alias(key)).agg(
                ((F.sum("label") + F.lit(PRIOR * overall)) / (F.count("*") + F.lit(PRIOR))).alias(share))
            df = df.join(table, df[pre + k] == table[key], "left").withColumn(share, F.coalesce(share, F.lit(overall)))
        return df

    # The sample: each label's different URLs with the smallest hashes, so that its size bounds all that
    # the fit holds. A label takes half of it, or what the other leaves; weights restore the labels' shares.
    def drawn(label):
        urls = counts[label]["urls"]
        most = min(urls, max(1, sample // 2, sample - counts[1 - label]["urls"]))
        of_label = labelled.where(F.col("label") == label).select("url", "host", "path", "label").distinct()
        return of_label.orderBy(F.xxhash64("url"), "url").limit(most).withColumn(pre + "weight", F.lit(urls / most))

    assembler = VectorAssembler(inputCols=list(f.values()), outputCol=fresh(split, "vec"))
    if len(counts) == 2:
        known = materialize(with_share(lexical(drawn(0.0).union(drawn(1.0)), "url", "host", "path", pre)))
        trees = (GBTClassifier(featuresCol=assembler.getOutputCol(), labelCol="label", weightCol=pre + "weight", maxIter=rounds, maxDepth=depth,
                               seed=SEED, predictionCol=pre + "p")
                 .setProbabilityCol(pre + "prob").setRawPredictionCol(pre + "raw"))
        model = trees.fit(assembler.transform(known))
        scored = model.transform(assembler.transform(with_share(split))).withColumn(
            "block_score", vector_to_array(F.col(pre + "prob"))[1])
    else:
        scored = split.withColumn("block_score", F.lit(overall))
    learnt = F.when(F.col("block_score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*base.columns, "host", "path", F.col(f"{hit}.rule").alias("rule"),
                         F.coalesce(F.col(f"{hit}.verdict"), learnt).alias("verdict"), "block_score")
