"""DuckDB text shared by the oracle queries: the analog flat table as CTEs.

This is the independent restatement of ``leakscope.sources.analog`` in
plain SQL (window arg-min instead of a struct minimum), used only by the
correctness check.
"""

from __future__ import annotations

FLAT_CTES = """
ev AS (
  SELECT l_orderkey, count(*) AS n_events, max(l_tax) AS max_tax, sum(l_quantity) AS sum_qty,
         min(l_quantity) AS min_qty, max(l_quantity) AS max_qty,
         max(CAST(l_shipdate AS DATE)) AS last_ship, max(l_linenumber) AS max_line
  FROM lineitem GROUP BY l_orderkey),
cl AS (
  SELECT l_orderkey, d AS closest_d, l_quantity AS closest_v, closest_date FROM (
    SELECT l_orderkey, l_extendedprice AS d, l_quantity,
           strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS closest_date,
           row_number() OVER (PARTITION BY l_orderkey
                              ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS rn
    FROM lineitem WHERE l_discount <> 0) t WHERE rn = 1),
flat AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS neo_id,
         c.c_name AS name,
         NULLIF(o.o_orderstatus, 'P') AS designation,
         o.o_totalprice / 10000 AS absolute_magnitude_h,
         o.o_totalprice / 1000000 AS estimated_diameter_km_min,
         o.o_totalprice * CAST(1.1 AS DOUBLE) / 1000000 AS estimated_diameter_km_max,
         CASE WHEN cl.closest_d IS NULL THEN NULL
              ELSE (o.o_totalprice <= 250000 AND cl.closest_d <= 20000) END
           AS is_potentially_hazardous_asteroid,
         o.o_orderstatus = 'F' AS is_sentry_object,
         CAST(COALESCE(ev.n_events, 0) AS INTEGER) AS num_recorded_close_approaches,
         cl.closest_date AS closest_approach_date,
         cl.closest_d AS closest_miss_distance_km,
         cl.closest_v AS closest_relative_velocity_km_s,
         o.o_orderpriority AS orbit_class_type,
         c.c_acctbal / 10000 AS eccentricity,
         date_diff('day', DATE '1992-01-01', CAST(o.o_orderdate AS DATE)) / CAST(365.25 AS DOUBLE)
           AS semi_major_axis_au,
         ev.max_tax * 100 AS inclination_deg,
         CAST(c.c_nationkey AS DOUBLE) * CAST(14.4 AS DOUBLE) AS ascending_node_longitude_deg,
         ev.sum_qty AS orbital_period_days,
         ev.min_qty AS perihelion_distance_au,
         ev.max_qty AS aphelion_distance_au,
         CAST(dayofmonth(o.o_orderdate) AS DOUBLE) * 12 AS mean_anomaly_deg,
         CASE WHEN ev.sum_qty = 0 THEN NULL ELSE CAST(360.0 AS DOUBLE) / ev.sum_qty END
           AS mean_motion_deg_per_day,
         cl.closest_d / 100000 AS moid_au,
         CAST(date_diff('day', CAST(o.o_orderdate AS DATE), ev.last_ship) AS DOUBLE) AS data_arc_in_days,
         CAST(ev.max_line AS DOUBLE) AS observations_used,
         o.o_orderkey AS _ordinal
  FROM orders o
  LEFT JOIN ev ON o.o_orderkey = ev.l_orderkey
  LEFT JOIN cl ON o.o_orderkey = cl.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
clean AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY neo_id ORDER BY _ordinal) AS _rn
    FROM flat WHERE neo_id IS NOT NULL AND is_potentially_hazardous_asteroid IS NOT NULL) t
  WHERE _rn = 1),
derived AS (
  SELECT *,
         (estimated_diameter_km_min + estimated_diameter_km_max) / 2 AS diameter_km_mean,
         ln(1 + closest_miss_distance_km) AS log_closest_miss_distance_km,
         ln(1 + closest_relative_velocity_km_s) AS log_closest_relative_velocity_km_s,
         ln(1 + orbital_period_days) AS log_orbital_period_days
  FROM clean)
"""

FLAT_DOUBLE_COLUMNS = [
    "absolute_magnitude_h", "estimated_diameter_km_min", "estimated_diameter_km_max",
    "closest_miss_distance_km", "closest_relative_velocity_km_s", "eccentricity",
    "semi_major_axis_au", "inclination_deg", "ascending_node_longitude_deg", "orbital_period_days",
    "perihelion_distance_au", "aphelion_distance_au", "mean_anomaly_deg", "mean_motion_deg_per_day",
    "moid_au", "data_arc_in_days", "observations_used",
]


def with_flat(body: str) -> str:
    return f"WITH {FLAT_CTES.strip()}\n{body}"


# md5 hash of (seed, id) as 32 bits, equal to leakscope.functions.scalar.hash_bits
def hash_bits_sql(seed: int, key: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"


def hash_uniform_sql(seed: int, key: str) -> str:
    return f"({hash_bits_sql(seed, key)} / 4294967296.0)"
