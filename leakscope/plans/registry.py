"""Query registry: key -> callable(spark, sf_dir) -> DataFrame.

Modules under ``leakscope.plans`` register their queries with ``@query``;
``__spark_entry__`` only reads this table. Output rules shared with the
DuckDB oracle: every column aliased, doubles rounded to 6 places, counts
BIGINT, flat outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under ``key``, optionally with its DuckDB oracle."""

    def wrap(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return wrap


def round_half_up(c, places: int):
    """Round the binary value: round(x * 10^p) / 10^p, half away from zero.
    Spark's round(x, p) rounds the shortest decimal text instead, which
    differs on values such as 0.0626345; scaling first makes the two agree
    (and equals DuckDB's ROUND)."""
    scale = float(10 ** places)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def round_half_even(c, places: int):
    """numpy-style half-even rounding of the binary value: rint(x * 10^p) / 10^p."""
    scale = float(10 ** places)
    return F.bround(c * F.lit(scale), 0) / F.lit(scale)


def normalise(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places and widen integers to BIGINT, keeping names."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = round_half_up(c.cast("double"), 6)
        elif isinstance(f.dataType, (IntegerType, ShortType, LongType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)
