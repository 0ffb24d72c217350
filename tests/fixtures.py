"""Synthetic raw records (hand-written to the raw schema; not real data)."""

import copy
import json

HAZARDOUS = {
    "id": "9000001", "name": "(9000001) Sample-A", "designation": "9000001",
    "absolute_magnitude_h": 19.5,
    "estimated_diameter": {"kilometers": {"estimated_diameter_min": 0.3, "estimated_diameter_max": 0.7}},
    "is_potentially_hazardous_asteroid": True, "is_sentry_object": False,
    "close_approach_data": [
        {"close_approach_date": "2021-05-01", "relative_velocity": {"kilometers_per_second": "12.5"},
         "miss_distance": {"kilometers": "500000"}, "orbiting_body": "Earth"},
        {"close_approach_date": "2019-01-01", "relative_velocity": {"kilometers_per_second": "20.0"},
         "miss_distance": {"kilometers": "200000"}, "orbiting_body": "Earth"},
    ],
    "orbital_data": {"data_arc_in_days": 3000, "observations_used": 400, "minimum_orbit_intersection": "0.01",
                     "eccentricity": "0.4", "semi_major_axis": "1.5", "inclination": "10.0",
                     "ascending_node_longitude": "100.0", "orbital_period": "600.0",
                     "perihelion_distance": "0.9", "aphelion_distance": "2.1", "mean_anomaly": "50.0",
                     "mean_motion": "0.6", "orbit_class": {"orbit_class_type": "APO"}},
}
NOT_HAZARDOUS = {
    "id": "9000002", "name": "(9000002) Sample-B", "absolute_magnitude_h": 22.0,
    "estimated_diameter": {"kilometers": {"estimated_diameter_min": 0.1, "estimated_diameter_max": 0.2}},
    "is_potentially_hazardous_asteroid": False, "is_sentry_object": False,
    "close_approach_data": [
        {"close_approach_date": "2020-02-02", "relative_velocity": {"kilometers_per_second": "8.0"},
         "miss_distance": {"kilometers": "7000000"}, "orbiting_body": "Earth"}],
    "orbital_data": {"minimum_orbit_intersection": "0.2", "eccentricity": "0.2", "orbit_class":
                     {"orbit_class_type": "AMO"}},
}
MISSING_ID = {"name": "no id", "absolute_magnitude_h": 21.0, "is_potentially_hazardous_asteroid": False}
MISSING_TARGET = {"id": "9000003", "name": "no target", "absolute_magnitude_h": 23.0}
RECORDS = [HAZARDOUS, NOT_HAZARDOUS, MISSING_ID, MISSING_TARGET, copy.deepcopy(HAZARDOUS)]


def write_records(path, records):
    with open(path, "w") as fh:
        json.dump(records, fh)
    return str(path)
