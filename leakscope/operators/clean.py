"""F1, F2, W1 cleaning with full drop accounting (A3), null profile (A2),
grain check (A5).

Keeping the first row per id is an aggregate, not a window: the minimum of
``struct(ordinal, row)`` per id is computed partially on every map task, so a
hot id is combined before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope import constants as C


class GrainError(RuntimeError):
    pass


def drop_missing(df: DataFrame, id_col: str = C.ID, target_col: str = C.TARGET) -> DataFrame:
    """F1 then F2."""
    return df.filter(F.col(id_col).isNotNull()).filter(F.col(target_col).isNotNull())


def first_per_key(df: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """The first row per key in ``order_cols`` order (which must be
    unique per row). Partial aggregation makes it skew-safe."""
    payload = [c for c in df.columns if c not in key_cols and c not in order_cols]
    packed = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in payload])
    best = df.groupBy(*key_cols).agg(F.min(packed).alias("_first"))
    return best.select(*key_cols, *[F.col(f"_first.{c}").alias(c) for c in order_cols + payload]) \
        .select(*df.columns)


def clean(df: DataFrame, id_col: str = C.ID, target_col: str = C.TARGET,
          order_cols: list[str] | None = None, id_of: list[str] | None = None) -> DataFrame:
    """F1 → F2 → W1. ``order_cols`` is the input-order ordinal. ``id_of`` names columns
    that the id stands for one to one (it is their text): the groups are the same with
    them as keys, and a frame that is partitioned and sorted by them is neither shuffled
    nor sorted again."""
    order_cols = order_cols or ["_ordinal"]
    keys = id_of or [id_col]
    return first_per_key(drop_missing(df, id_col, target_col), keys, [c for c in order_cols if c not in keys])


def clean_report(df: DataFrame, id_col: str = C.ID, target_col: str = C.TARGET) -> DataFrame:
    """A3: rows before and after and the three drop counts, in one pass.
    The drop order F1, F2, W1 decides which count a row lands in."""
    idc, tc = F.col(id_col), F.col(target_col)
    valid = idc.isNotNull() & tc.isNotNull()
    stats = df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(idc.isNull()).alias("dropped_missing_id"),
        F.count_if(idc.isNotNull() & tc.isNull()).alias("dropped_missing_target"),
        F.count_if(valid).alias("_valid"),
        F.count_distinct(F.when(valid, idc)).alias("_distinct"),
    )
    return stats.select(
        F.col("rows_before").cast("bigint"),
        F.col("_distinct").cast("bigint").alias("rows_after"),
        F.col("dropped_missing_id").cast("bigint"),
        F.col("dropped_missing_target").cast("bigint"),
        (F.col("_valid") - F.col("_distinct")).cast("bigint").alias("dropped_duplicate_id"),
    )


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A2: percentage of nulls per column, half-even to 2 places, 0 for an
    empty table. One aggregate pass, then a 25-row unpivot."""
    columns = columns or [c for c in df.columns if not c.startswith("_")]
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    wide = df.agg(*aggs)
    stacked = wide.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                                     F.col(c).alias("share")) for i, c in enumerate(columns)])).alias("s")
    )
    return stacked.select(
        F.col("s.position").cast("bigint").alias("position"),
        F.col("s.column_name").alias("column_name"),
        # numpy-style half-even on the binary value: rint(100 * share * 100) / 100
        (F.bround(F.coalesce(F.col("s.share"), F.lit(0.0)) * 100 * 100, 0) / 100).alias("null_pct"),
    )


def missing_columns(profile: DataFrame, warn_at: float = 25.0) -> DataFrame:
    """Columns with missing values, most missing first, with a warn flag."""
    return profile.filter(F.col("null_pct") > 0).select(
        "column_name", "null_pct", (F.col("null_pct") >= warn_at).alias("warn"))


def duplicate_count(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """A5 as a query: rows, distinct keys, repeats."""
    key = F.struct(*[F.col(c) for c in key_cols]) if len(key_cols) > 1 else F.col(key_cols[0])
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).select(
        F.col("n").cast("bigint").alias("n_rows"),
        F.col("d").cast("bigint").alias("n_distinct"),
        (F.col("n") - F.col("d")).cast("bigint").alias("n_duplicates"),
    )


def verify_grain(df: DataFrame, key_cols: list[str]) -> None:
    """A5: raise when a key repeats."""
    dup = duplicate_count(df, key_cols).first()["n_duplicates"]
    if dup:
        raise GrainError(f"{dup} repeated value(s) of {key_cols}; the table is not one row per object")
