"""Explicit schemas of the tables the engine writes and reads back."""

FLAT_DDL = (
    "neo_id STRING, name STRING, designation STRING, absolute_magnitude_h DOUBLE, "
    "estimated_diameter_km_min DOUBLE, estimated_diameter_km_max DOUBLE, "
    "is_potentially_hazardous_asteroid BOOLEAN, is_sentry_object BOOLEAN, "
    "num_recorded_close_approaches INT, closest_approach_date STRING, "
    "closest_miss_distance_km DOUBLE, closest_relative_velocity_km_s DOUBLE, "
    "orbit_class_type STRING, eccentricity DOUBLE, semi_major_axis_au DOUBLE, "
    "inclination_deg DOUBLE, ascending_node_longitude_deg DOUBLE, orbital_period_days DOUBLE, "
    "perihelion_distance_au DOUBLE, aphelion_distance_au DOUBLE, mean_anomaly_deg DOUBLE, "
    "mean_motion_deg_per_day DOUBLE, moid_au DOUBLE, data_arc_in_days DOUBLE, observations_used DOUBLE"
)
