"""Quality rules with adaptive thresholds, DataFrame functions only.

Each text gets a few statistics. Per language and source, every statistic is
summed up in a quantile sketch of logarithmic buckets (relative error
``ERROR``). Sketches are counts, so they merge by addition: partial
aggregation builds them map-side, and sources with fewer than ``min_rows``
texts use the merged sketch of their language, languages with fewer that of
the corpus. They are fitted to the texts that pass the base rules, copies
counted once, so that neither junk nor one text in many copies sets a scale.

The fences come from the sketches. A ratio (symbols, repeated lines, repeated
words) may reach twice its group's quantile at the statistic's ``LEVELS``, and
half the lower quartile of the values above 0 in its group or its language: most
texts have none, so their own scale is that of the texts that have some. The
mean word length may stray from the median ``reach`` times as far as the
group's outer tenths do. ``RESOLUTION`` only keeps a fence from falling below
what a statistic can tell apart. The thresholds are joined to the statistics,
never to texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakscope.session import materialize

from .common import WORD, fresh

#: Statistic: the quantile up to which a group's texts are taken as ordinary.
LEVELS = {"symbol_ratio": 0.9, "dup_line_ratio": 0.99, "repeat_ratio": 0.99, "mean_word": 0.9}
#: Statistic: differences below this say nothing (one symbol in 100, one line in 20, ...).
RESOLUTION = {"symbol_ratio": 0.01, "dup_line_ratio": 0.05, "repeat_ratio": 0.05, "mean_word": 0.1}
REACH, MIN_ROWS, ERROR = 3.0, 200, 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
ZERO = -1_000_000  # bucket of values too small to tell from 0
LEAST = 1e-9
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
INDEX = (1 << 31) - 1


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``BASE`` and n_lines; a null text counts as empty."""
    text, words, lines, zips, codes, cand, exact, hit = (
        fresh(docs, x) for x in ("text", "words", "lines", "zips", "codes", "cand", "exact", "hit"))
    base = docs.drop(*BASE, "n_lines")
    out = base.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn(words, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    w = F.col(words)
    rest = lambda k: F.slice(w, F.lit(k), F.greatest(F.size(w) - 2, F.lit(0)))
    # Window hashes, cut to 32 bits over the position, sort as plain longs; equal
    # neighbours are candidates, which are then compared by their words.
    out = out.withColumn(zips, F.arrays_zip(rest(1).alias("a"), rest(2).alias("b"), rest(3).alias("c")))
    out = out.withColumn(codes, F.sort_array(F.transform(zips, lambda g, i: F.shiftleft(
        F.shiftrightunsigned(F.xxhash64(g["a"], g["b"], g["c"]), 32), 31).bitwiseOR(i.cast("long")))))
    after = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1)))
    pairs = F.filter(F.zip_with(codes, after(F.col(codes)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
                     lambda p: F.shiftright(p["x"], 31) == F.shiftright(p["y"], 31))
    position = lambda c: c.bitwiseAND(F.lit(INDEX)).cast("int")
    out = out.withColumn(cand, pairs)
    out = out.withColumn(cand, F.array_distinct(F.concat(
        F.transform(cand, lambda p: position(p["x"])), F.transform(cand, lambda p: position(p["y"])))))
    out = out.withColumn(exact, F.array_sort(F.transform(cand, lambda i: F.struct(
        F.get(zips, i).alias("g"), i.alias("i")))))
    pairs = F.filter(F.zip_with(exact, after(F.col(exact)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
                     lambda p: p["x"]["g"] == p["y"]["g"])
    out = out.withColumn(hit, pairs)
    out = out.withColumn(hit, F.sort_array(F.array_distinct(F.concat(
        F.transform(hit, lambda p: p["x"]["i"]), F.transform(hit, lambda p: p["y"]["i"])))))
    gaps = F.zip_with(hit, after(F.col(hit)), lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    out = out.withColumn(lines, F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    return out.select(
        *base.columns,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"))


def ratios(stats: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return stats.withColumns({
        "symbol_ratio": part("n_symbols", "word_chars"), "dup_line_ratio": part("n_dup_lines", "n_lines"),
        "repeat_ratio": part("n_repeat_words", "n_words"), "mean_word": part("word_chars", "n_words")})


def thresholds(measured: DataFrame, reach: float = REACH, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, and low_ and high_ of each statistic), a row per group."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in LEVELS]))
    bucket = F.when(F.col("v.x") < LEAST, F.lit(ZERO)).otherwise(F.ceil(F.log("v.x") / F.lit(math.log(GAMMA))))
    sketch = materialize(
        measured.select("lang", "source", values.alias("v"))
        .groupBy("lang", "source", F.col("v.metric").alias("metric"), bucket.cast("long").alias("bucket"))
        .agg(F.count("*").alias("n")))
    by_lang = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    of_metric = lambda table: F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("metric"))

    def quantiles(s: DataFrame, keys: list[str]) -> DataFrame:
        group = Window.partitionBy(*keys, "metric")
        upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        none = F.sum(F.when(F.col("bucket") == ZERO, F.col("n")).otherwise(0)).over(group)
        counted = s.withColumn("upto", upto).withColumn("all", F.sum("n").over(group)).withColumn("none", none)
        value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(
            F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) * F.lit(2 / (GAMMA + 1)))
        at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), value))
        some = F.min(F.when((F.col("bucket") != ZERO) & (F.col("upto") - F.col("none") >= F.lit(0.25) * (F.col("all") - F.col("none"))), value))
        return counted.groupBy(*keys, "metric").agg(F.struct(
            F.first("all").alias("rows"), at(F.lit(0.1)).alias("low"), at(F.lit(0.5)).alias("mid"),
            at(of_metric(LEVELS)).alias("high"), F.coalesce(some, F.lit(0.0)).alias("some")).alias("q"))

    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(by_lang, ["lang"]).select(F.col("lang").alias("llang"), F.col("metric").alias("lmetric"), F.col("q").alias("by_lang"))
    every = quantiles(overall, []).select(F.col("metric").alias("ometric"), F.col("q").alias("overall"))
    joined = (own.join(lang, F.col("lang").eqNullSafe(F.col("llang")) & (F.col("metric") == F.col("lmetric")))
              .join(every, F.col("metric") == F.col("ometric")))
    joined = joined.withColumn("by_lang", F.when(F.col("by_lang.rows") >= min_rows, F.col("by_lang")).otherwise(F.col("overall")))
    joined = joined.withColumn("q", F.when(F.col("q.rows") >= min_rows, F.col("q")).otherwise(F.col("by_lang")))
    joined = joined.withColumn("least", of_metric(RESOLUTION))
    ratio = F.greatest(2 * F.col("q.high"), F.col("q.some") / 2, F.col("by_lang.some") / 2, "least")
    far = lambda a, b: reach * F.greatest(F.col(a) - F.col(b), "least")
    is_ratio = F.col("metric") != "mean_word"
    # GAMMA: a bucket's value stands for all that fall in it.
    fenced = joined.select(
        "lang", "source", "metric",
        F.when(is_ratio, 0.0).otherwise((F.col("q.mid") - far("q.mid", "q.low")) / GAMMA).alias("low"),
        (F.when(is_ratio, ratio).otherwise(F.col("q.mid") + far("q.high", "q.mid")) * GAMMA).alias("high"))
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}")
    return fenced.groupBy("lang", "source").agg(*[pick(m, c) for m in LEVELS for c in ("low", "high")])


def judge(docs: DataFrame, reach: float = REACH, min_rows: int = MIN_ROWS, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, the columns of ``BASE``, base_failed, kept), a row per row of ``docs``.

    base_failed: under 50 words, or over half of the words repeated. kept: not
    base_failed and every statistic within its group's fences. Null and empty
    texts have no words and fail; very long texts are measured whole; an empty
    table gives no rows. A null language or source is a group of its own. Equal
    values fall in one bucket, so ties and repeated rows get one verdict. Only
    the named columns are read, so other columns may have any name.
    """
    measured = materialize(ratios(statistics(docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.col(text_col).alias("text"))).drop("text")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fit = measured.where(~failed).drop("doc_id").distinct()
    limits = thresholds(fit, reach, min_rows).withColumnsRenamed({"lang": "tlang", "source": "tsource"})
    within = F.lit(True)
    for m in LEVELS:
        within = within & F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    # A group in which no text passes the base rules has no fences.
    return (measured.join(limits, F.col("lang").eqNullSafe(F.col("tlang")) & F.col("source").eqNullSafe(F.col("tsource")), "left")
            .select("doc_id", *BASE, failed.alias("base_failed"), (~failed & within).alias("kept")))
