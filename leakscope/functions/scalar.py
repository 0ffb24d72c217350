"""Row-local column functions. All are built-in Spark expressions (codegen),
no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope import constants as C

# Text the Python float() parser rejects but Spark's cast accepts: a trailing
# type suffix such as "1.5d" / "2f" / "3L" right after a digit or dot: null.
# Checked with character tests, not a regex (the parse is hot). Single
# underscores between digits are allowed, as in "1_000": taken out where the
# text has any; a text with other underscores is null.
_SUFFIXES = ["d", "f", "l"]
_DIGITS = [str(i) for i in range(10)] + ["."]


def safe_double(c: Column | str) -> Column:
    """Parse a value to double; null on null, bad text, or NaN."""
    col = F.col(c) if isinstance(c, str) else c
    text = F.trim(col.cast("string"))
    suffixed = F.lower(F.substring(text, -1, 1)).isin(_SUFFIXES) & F.substring(text, -2, 1).isin(_DIGITS)
    text = F.when(text.contains("_"), F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")).otherwise(text)
    rejected = suffixed | text.contains("_")
    parsed = F.when(~rejected, text.try_cast("double"))
    return F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)


def nan_to_null(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def is_present(c: Column | str) -> Column:
    """Null, missing or blank text count as absent."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(col.cast("string")), F.lit("")).isNotNull()


def unit_from_name(c: Column | str) -> Column:
    """Unit from a column-name suffix; rules apply in order, dash if none."""
    name = F.col(c) if isinstance(c, str) else c
    return (
        F.when(name.endswith("_deg_per_day"), "deg/day")
        .when(name.endswith("_km_s"), "km/s")
        .when(name.endswith("_au"), "au")
        .when(name.endswith("_deg"), "deg")
        .when(name.endswith("_km") | name.endswith("_km_min") | name.endswith("_km_max"), "km")
        .when(name.endswith("_days"), "days")
        .otherwise("—")
    )


def strip_prefix(c: Column | str) -> Column:
    """Drop a transformer prefix up to the first double underscore."""
    name = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(name, r"^.*?__", "")


def hash_bits(seed: int, key: Column | str) -> Column:
    """32-bit deterministic hash of (seed, key) from md5; equal in DuckDB as
    ('0x' || substr(md5(seed || '|' || key::varchar), 1, 8))::bigint."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed: int, key: Column | str) -> Column:
    """Uniform in [0, 1) from ``hash_bits``."""
    return hash_bits(seed, key) / F.lit(4294967296.0)


def outcome(actual: Column | str, predicted: Column | str) -> Column:
    """TP/TN/FP/FN label from two booleans."""
    a = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    return (
        F.when(a & p, "true_positive")
        .when(~a & ~p, "true_negative")
        .when(~a & p, "false_positive")
        .otherwise("false_negative")
    )


def label_text(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col, C.LABEL_TRUE).otherwise(C.LABEL_FALSE)


def round6(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col * F.lit(1e6), 0) / F.lit(1e6)


def date_text(c: Column | str) -> Column:
    """yyyy-MM-dd text of a timestamp without depending on the session zone
    (the driver tables carry TIMESTAMP_NTZ)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("date").cast("string")
