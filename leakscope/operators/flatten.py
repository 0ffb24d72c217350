"""Flatten nested object records to the 25-column flat table.

The closest event is chosen row-locally with higher-order array functions, so
flattening never shuffles: an object's events travel inside its record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.functions.scalar import safe_double


def approach_count(arr: Column) -> Column:
    """Number of events; a null list counts as empty."""
    return F.coalesce(F.size(arr), F.lit(0)).cast("int")


def closest_event(arr: Column, distance) -> Column:
    """The element with the least parsed distance.

    ``distance`` maps an element to its text distance. Null distances are
    skipped; among equal distances the first element wins (its index is the
    second sort key); null when no element has a distance. Returns
    ``struct(d, i, e)`` with the parsed distance, the index and the element.
    """
    indexed = F.transform(arr, lambda x, i: F.struct(safe_double(distance(x)).alias("d"),
                                                     i.alias("i"), x.alias("e")))
    usable = F.filter(indexed, lambda s: s["d"].isNotNull())
    return F.array_min(usable)


def flatten_records(raw: DataFrame, keep_ordinal: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One flat row per raw record. Missing parents give nulls (nested
    field access is null-safe)."""
    orbital = F.col("orbital_data")
    km = F.col("estimated_diameter.kilometers")
    best = closest_event(F.col("close_approach_data"), lambda x: x["miss_distance"]["kilometers"])
    cols = [
        F.col("id").alias("neo_id"),
        F.col("name"),
        F.col("designation"),
        safe_double(F.col("absolute_magnitude_h")).alias("absolute_magnitude_h"),
        safe_double(km["estimated_diameter_min"]).alias("estimated_diameter_km_min"),
        safe_double(km["estimated_diameter_max"]).alias("estimated_diameter_km_max"),
        F.col(C.TARGET),
        F.col("is_sentry_object"),
        approach_count(F.col("close_approach_data")).alias("num_recorded_close_approaches"),
        best["e"]["close_approach_date"].alias("closest_approach_date"),
        best["d"].alias("closest_miss_distance_km"),
        safe_double(best["e"]["relative_velocity"]["kilometers_per_second"]).alias("closest_relative_velocity_km_s"),
        orbital["orbit_class"]["orbit_class_type"].alias("orbit_class_type"),
        safe_double(orbital["eccentricity"]).alias("eccentricity"),
        safe_double(orbital["semi_major_axis"]).alias("semi_major_axis_au"),
        safe_double(orbital["inclination"]).alias("inclination_deg"),
        safe_double(orbital["ascending_node_longitude"]).alias("ascending_node_longitude_deg"),
        safe_double(orbital["orbital_period"]).alias("orbital_period_days"),
        safe_double(orbital["perihelion_distance"]).alias("perihelion_distance_au"),
        safe_double(orbital["aphelion_distance"]).alias("aphelion_distance_au"),
        safe_double(orbital["mean_anomaly"]).alias("mean_anomaly_deg"),
        safe_double(orbital["mean_motion"]).alias("mean_motion_deg_per_day"),
        safe_double(orbital["minimum_orbit_intersection"]).alias("moid_au"),
        safe_double(orbital["data_arc_in_days"]).alias("data_arc_in_days"),
        orbital["observations_used"].cast("double").alias("observations_used"),
    ]
    if keep_ordinal and "_ordinal" in raw.columns:
        cols.append(F.col("_ordinal"))
    cols += [F.col(c) for c in carry]
    return raw.select(*cols)


def missing_required(raw: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A1: records and missing-field counts over raw records (duplicates
    included), one aggregate pass, one row."""
    fields = fields or C.REQUIRED_FIELDS
    return raw.agg(
        F.count(F.lit(1)).alias("total_records"),
        *[F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields],
    )
