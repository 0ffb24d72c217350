"""Fixed values.

Everything in this module is a fixed value that must stay equal to the
audited pipeline's definitions for results to be comparable: column names,
feature lists, feature-set membership, grids and defaults. They are listed
plainly, in their natural order.
"""

from __future__ import annotations

# --- fixed values: identity, target, seed, split sizes -----------------------
TARGET = "is_potentially_hazardous_asteroid"
ID = "neo_id"
SEED = 42
TEST_SIZE = 0.2
N_FOLDS = 5

# --- fixed values: raw fields that must be present ----------------------------
REQUIRED_FIELDS = ["id", "absolute_magnitude_h", "is_potentially_hazardous_asteroid"]

# --- fixed values: the 25 columns of the flat object table, in order ---------
FLAT_COLUMNS = [
    "neo_id",
    "name",
    "designation",
    "absolute_magnitude_h",
    "estimated_diameter_km_min",
    "estimated_diameter_km_max",
    "is_potentially_hazardous_asteroid",
    "is_sentry_object",
    "num_recorded_close_approaches",
    "closest_approach_date",
    "closest_miss_distance_km",
    "closest_relative_velocity_km_s",
    "orbit_class_type",
    "eccentricity",
    "semi_major_axis_au",
    "inclination_deg",
    "ascending_node_longitude_deg",
    "orbital_period_days",
    "perihelion_distance_au",
    "aphelion_distance_au",
    "mean_anomaly_deg",
    "mean_motion_deg_per_day",
    "moid_au",
    "data_arc_in_days",
    "observations_used",
]

# --- fixed values: model inputs ----------------------------------------------
PASSTHROUGH_NUMERIC = [
    "absolute_magnitude_h",
    "eccentricity",
    "semi_major_axis_au",
    "inclination_deg",
    "ascending_node_longitude_deg",
    "orbital_period_days",
    "perihelion_distance_au",
    "aphelion_distance_au",
    "mean_anomaly_deg",
    "mean_motion_deg_per_day",
    "moid_au",
    "data_arc_in_days",
    "observations_used",
    "num_recorded_close_approaches",
    "closest_miss_distance_km",
    "closest_relative_velocity_km_s",
]
CATEGORICAL = ["orbit_class_type"]

# derived feature -> (formula text, source fields, unit text)
DERIVED_DEFINITIONS = [
    ("diameter_km_mean", "(estimated_diameter_km_min + estimated_diameter_km_max) / 2",
     ["estimated_diameter_km_min", "estimated_diameter_km_max"], "kilometers"),
    ("log_closest_miss_distance_km", "log1p(closest_miss_distance_km)",
     ["closest_miss_distance_km"], "log(1 + kilometers)"),
    ("log_closest_relative_velocity_km_s", "log1p(closest_relative_velocity_km_s)",
     ["closest_relative_velocity_km_s"], "log(1 + km/s)"),
    ("log_orbital_period_days", "log1p(orbital_period_days)",
     ["orbital_period_days"], "log(1 + days)"),
]
# derived feature -> why it is derived
DERIVED_RATIONALE = {
    "diameter_km_mean": "one point for a range that comes from an assumed albedo",
    "log_closest_miss_distance_km": "distances are right-skewed over many orders of magnitude",
    "log_closest_relative_velocity_km_s": "velocities are right-skewed",
    "log_orbital_period_days": "periods run from months to centuries",
}
DERIVED_NUMERIC = [d[0] for d in DERIVED_DEFINITIONS]
ALL_NUMERIC = PASSTHROUGH_NUMERIC + DERIVED_NUMERIC

# --- fixed values: audit categories ------------------------------------------
CATEGORY_A_LABEL_DEFINING = ["moid_au", "absolute_magnitude_h"]
CATEGORY_B_LABEL_DERIVED = ["estimated_diameter_km_min", "estimated_diameter_km_max", "diameter_km_mean"]
CATEGORY_F_EPOCH_DEPENDENT = ["mean_anomaly_deg"]

PHYSICAL_KINEMATIC_NUMERIC = [
    "closest_miss_distance_km",
    "log_closest_miss_distance_km",
    "closest_relative_velocity_km_s",
    "log_closest_relative_velocity_km_s",
    "num_recorded_close_approaches",
    "data_arc_in_days",
    "observations_used",
]
ORBITAL_ONLY_NUMERIC = [
    "eccentricity",
    "semi_major_axis_au",
    "inclination_deg",
    "ascending_node_longitude_deg",
    "orbital_period_days",
    "log_orbital_period_days",
    "perihelion_distance_au",
    "aphelion_distance_au",
    "mean_motion_deg_per_day",
]

# --- fixed values: experiment keys and model names, in run order -------------
EXPERIMENTS = ["original", "leakage_aware", "physical_kinematic_only", "orbital_only"]
MODELS = ["dummy_most_frequent", "logistic_regression", "random_forest", "xgboost"]
TUNABLE_MODELS = ["logistic_regression", "random_forest", "xgboost"]

# --- fixed values: search spaces and search size -----------------------------
N_ITER = 12
SEARCH_SPACES = {
    "logistic_regression": {"C": [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0]},
    "random_forest": {
        "n_estimators": [100, 200, 300, 400],
        "max_depth": [None, 4, 6, 8, 12],
        "min_samples_leaf": [1, 2, 4, 8],
        "max_features": ["sqrt", "log2", None],
    },
    "xgboost": {
        "n_estimators": [100, 200, 300],
        "max_depth": [2, 3, 4, 6],
        "learning_rate": [0.01, 0.05, 0.1, 0.2],
        "subsample": [0.6, 0.8, 1.0],
        "colsample_bytree": [0.6, 0.8, 1.0],
    },
}

# --- fixed values: threshold grid 0.05 .. 0.95 step 0.05 ---------------------
THRESHOLD_GRID = [round(0.05 * i, 2) for i in range(1, 20)]

# --- fixed values: class label text -------------------------------------------
LABEL_TRUE = "potentially_hazardous"
LABEL_FALSE = "not_hazardous"
OUTCOMES = ["true_positive", "true_negative", "false_positive", "false_negative"]

# --- fixed values: anomaly detector defaults ---------------------------------
ISOLATION_TREES = 100
ISOLATION_SAMPLE = 256
