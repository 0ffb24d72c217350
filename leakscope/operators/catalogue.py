"""Catalogue queries over the clean table: listing, lookup, search, sort
pages, histograms, column summaries (F3–F8, L1, L2, A19–A21)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators.rank import exact_order_stats
from leakscope.session import materialize


def _finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def list_objects(df: DataFrame, hazardous_only: bool = False, offset: int = 0, limit: int = 50,
                 id_col: str = C.ID) -> DataFrame:
    """F3 + L1: a page in id order and the total count after the filter.
    The page is a top-k (each task keeps offset+limit rows); the total is a
    separate count. For deep pages use ``page_after``."""
    f = df.filter(F.col(C.TARGET)) if hazardous_only else df
    total = f.count()
    return f.orderBy(id_col).offset(offset).limit(limit).withColumn("total_count", F.lit(total).cast("bigint"))


def page_after(df: DataFrame, last_key: str | None, limit: int, id_col: str = C.ID) -> DataFrame:
    """Key-after paging: cost independent of the page depth."""
    f = df if last_key is None else df.filter(F.col(id_col) > F.lit(last_key))
    return f.orderBy(id_col).limit(limit)


def lookup(df: DataFrame, key: str, id_col: str = C.ID) -> DataFrame:
    """the object whose id equals ``key`` as text; empty when absent."""
    return df.filter(F.col(id_col).cast("string") == F.lit(str(key))).orderBy(id_col).limit(1)


def search(df: DataFrame, label: str = "all", orbit_class: str | None = None, q: str = "",
           id_col: str = C.ID) -> DataFrame:
    """label filter (all/hazardous/not), class equality and a
    case-insensitive substring over id or name; null name counts as empty."""
    cond = F.lit(True)
    if label != "all":
        is_h = F.coalesce(F.col(C.TARGET) == F.lit(True), F.lit(False))
        cond = cond & (is_h if label == "hazardous" else ~is_h)
    if orbit_class:
        cond = cond & (F.col("orbit_class_type") == F.lit(orbit_class))
    needle = q.strip().lower()
    if needle:
        cond = cond & (F.lower(F.col(id_col).cast("string")).contains(needle)
                       | F.lower(F.coalesce(F.col("name"), F.lit(""))).contains(needle))
    return df.filter(cond)


def sort_page(df: DataFrame, column: str, descending: bool = False, page: int = 0, size: int = 25,
              id_col: str = C.ID) -> DataFrame:
    """L2: sort by any column, nulls last either way, tie-break on id."""
    if size not in (25, 50, 100):
        raise ValueError("page size must be 25, 50 or 100")
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, F.col(id_col).asc()).offset(page * size).limit(size)


def histogram(df: DataFrame, column: str, log_scale: bool = False, n_bins: int = 20,
              label: str = C.TARGET) -> DataFrame:
    """F7 + A19: finite values only; equal bins from min to max (log10 when
    asked and min > 0); the last bin is closed; width 1 when all equal; two
    class counts per bin; empty bins kept."""
    v = F.col(column).cast("double")
    pts = materialize(df.select(v.alias("v"), F.coalesce(F.col(label) == F.lit(True), F.lit(False)).alias("hz"))
                      .filter(_finite(F.col("v"))))
    st = pts.agg(F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    spark = df.sparkSession
    if st["mn"] is None:
        return spark.createDataFrame([], "bin BIGINT, x0 DOUBLE, x1 DOUBLE, n_negative BIGINT, n_positive BIGINT, "
                                         "use_log BOOLEAN")
    use_log = bool(log_scale and st["mn"] > 0)
    t = (lambda c: F.log10(c)) if use_log else (lambda c: c)
    lo = math.log10(st["mn"]) if use_log else st["mn"]
    hi = math.log10(st["mx"]) if use_log else st["mx"]
    width = (hi - lo) / n_bins or 1.0
    b = F.least(F.lit(n_bins - 1), F.floor((t(F.col("v")) - F.lit(lo)) / F.lit(width))).cast("bigint")
    counts = pts.groupBy(b.alias("bin")).agg(
        F.count_if(~F.col("hz")).cast("bigint").alias("n_negative"),
        F.count_if(F.col("hz")).cast("bigint").alias("n_positive"))
    bins = spark.range(n_bins).withColumnRenamed("id", "bin")
    return bins.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("x0"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("x1"),
        F.coalesce("n_negative", F.lit(0)).alias("n_negative"),
        F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
        F.lit(use_log).alias("use_log"),
    )


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """N, min, upper median ``sorted[floor(n/2)]`` (an exact order
    statistic, not an interpolated median) and max of the finite values."""
    vals = materialize(df.select(F.col(column).cast("double").alias("v")).filter(_finite(F.col("v"))))
    st = vals.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    n = st["n"]
    med = exact_order_stats(vals, "v", [n // 2]).get(n // 2) if n else None
    spark = df.sparkSession
    return spark.createDataFrame([(column, n, st["mn"], med, st["mx"])],
                                 "column_name STRING, n BIGINT, min DOUBLE, median DOUBLE, max DOUBLE")


def distinct_classes(df: DataFrame, column: str = "orbit_class_type") -> DataFrame:
    """Distinct non-null values, sorted."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def usable_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """F8: per column, whether any value is a finite number and whether it
    has nulls; one aggregate pass then an unpivot."""
    aggs = []
    for c in columns:
        col = F.col(c)
        numeric = dict(df.dtypes)[c] in ("double", "float", "int", "bigint", "smallint")
        fin = F.max(_finite(col.cast("double")).cast("int")) if numeric else F.lit(0)
        aggs += [F.coalesce(fin, F.lit(0)).alias(f"{c}__fin"), F.count_if(col.isNull()).alias(f"{c}__nul")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col(f"{c}__fin") == 1).alias("has_finite"),
                 (F.col(f"{c}__nul") > 0).alias("has_nulls"), F.col(f"{c}__nul").cast("bigint").alias("n_null"))
        for c in columns])).alias("s")).select("s.*")
