"""Catalogue and audit queries (F3–F9, L1, L2, L6, A19–A21, A24, P11, P12,
U1, U2, U4, J4, R4, R5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.functions.scalar import strip_prefix, unit_from_name
from leakscope.operators import catalogue as CAT
from leakscope.operators import clean as CL
from leakscope.operators.features import EXCLUDED, FEATURE_SETS
from leakscope.plans.q_ingest import cleaned, cleaned_derived
from leakscope.plans.registry import normalise, query
from leakscope.plans.sql_base import FLAT_DOUBLE_COLUMNS, with_flat

_LIST_COLS = ["neo_id", "name", "orbit_class_type", "is_potentially_hazardous_asteroid",
              "closest_miss_distance_km", "moid_au", "absolute_magnitude_h"]


def _cols_sql(cols):
    return ", ".join(f"ROUND({c}, 6) AS {c}" if c in FLAT_DOUBLE_COLUMNS else c for c in cols)


# --- F3 + L1 ----------------------------------------------------------------------
@query("list_objects", with_flat(f"""
SELECT {_cols_sql(_LIST_COLS)},
       (SELECT CAST(count(*) AS BIGINT) FROM clean WHERE is_potentially_hazardous_asteroid) AS total_count
FROM clean WHERE is_potentially_hazardous_asteroid
ORDER BY neo_id LIMIT 50 OFFSET 50
"""))
def q_list_objects(spark, sf_dir):
    df = cleaned(spark, sf_dir).select(*_LIST_COLS)
    return normalise(CAT.list_objects(df, hazardous_only=True, offset=50, limit=50))


# --- F4 -------------------------------------------------------------------------
@query("lookup", with_flat(f"SELECT {_cols_sql(_LIST_COLS)} FROM clean WHERE CAST(neo_id AS VARCHAR) = '7'"))
def q_lookup(spark, sf_dir):
    return normalise(CAT.lookup(cleaned(spark, sf_dir).select(*_LIST_COLS), "7"))


# --- F5 -------------------------------------------------------------------------
@query("search", with_flat(f"""
SELECT {_cols_sql(_LIST_COLS)} FROM clean
WHERE COALESCE(is_potentially_hazardous_asteroid = true, false)
  AND orbit_class_type = '1-URGENT'
  AND (contains(lower(CAST(neo_id AS VARCHAR)), '#0000012') OR contains(lower(COALESCE(name, '')), '#0000012'))
"""))
def q_search(spark, sf_dir):
    df = cleaned(spark, sf_dir).select(*_LIST_COLS)
    return normalise(CAT.search(df, label="hazardous", orbit_class="1-URGENT", q="  #0000012 "))


# --- L2 -------------------------------------------------------------------------
@query("sort_page", with_flat(f"""
SELECT {_cols_sql(_LIST_COLS)} FROM clean
ORDER BY closest_miss_distance_km DESC NULLS LAST, neo_id ASC LIMIT 50 OFFSET 100
"""))
def q_sort_page(spark, sf_dir):
    df = cleaned(spark, sf_dir).select(*_LIST_COLS)
    return normalise(CAT.sort_page(df, "closest_miss_distance_km", descending=True, page=2, size=50))


# --- F7 + A19 ---------------------------------------------------------------------
@query("histogram", with_flat("""
, pts AS (SELECT closest_miss_distance_km AS v, COALESCE(is_potentially_hazardous_asteroid = true, false) AS hz
          FROM clean WHERE closest_miss_distance_km IS NOT NULL AND isfinite(closest_miss_distance_km)),
st AS (SELECT min(v) AS mn, max(v) AS mx FROM pts),
tt AS (SELECT mn > 0 AS use_log,
              CASE WHEN mn > 0 THEN log10(mn) ELSE mn END AS lo,
              CASE WHEN mn > 0 THEN log10(mx) ELSE mx END AS hi FROM st),
w AS (SELECT use_log, lo, CASE WHEN (hi - lo) / 20 = 0 THEN 1.0 ELSE (hi - lo) / 20 END AS width FROM tt),
b AS (SELECT least(19, CAST(floor(((CASE WHEN use_log THEN log10(v) ELSE v END) - lo) / width) AS BIGINT)) AS bin, hz
      FROM pts, w),
c AS (SELECT bin, count(*) FILTER (WHERE NOT hz) AS n_negative, count(*) FILTER (WHERE hz) AS n_positive
      FROM b GROUP BY bin)
SELECT r.range AS bin, ROUND(w.lo + r.range * w.width, 6) AS x0, ROUND(w.lo + (r.range + 1) * w.width, 6) AS x1,
       CAST(COALESCE(c.n_negative, 0) AS BIGINT) AS n_negative, CAST(COALESCE(c.n_positive, 0) AS BIGINT) AS n_positive,
       w.use_log
FROM range(20) r CROSS JOIN w LEFT JOIN c ON c.bin = r.range
"""))
def q_histogram(spark, sf_dir):
    return normalise(CAT.histogram(cleaned(spark, sf_dir), "closest_miss_distance_km", log_scale=True))


# --- A20 ------------------------------------------------------------------------
@query("column_summary", with_flat("""
SELECT 'closest_miss_distance_km' AS column_name, CAST(count(*) AS BIGINT) AS n,
       ROUND(min(v), 6) AS min,
       ROUND((SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM vals) x
              WHERE r = (SELECT count(*) // 2 FROM vals)), 6) AS median,
       ROUND(max(v), 6) AS max
FROM vals
""").replace("derived AS (", "vals AS (SELECT closest_miss_distance_km AS v FROM clean "
                            "WHERE closest_miss_distance_km IS NOT NULL AND isfinite(closest_miss_distance_km)),\n"
                            "derived AS ("))
def q_column_summary(spark, sf_dir):
    return normalise(CAT.column_summary(cleaned(spark, sf_dir), "closest_miss_distance_km"))


# --- A21 ------------------------------------------------------------------------
@query("distinct_classes", with_flat("""
SELECT DISTINCT orbit_class_type FROM clean WHERE orbit_class_type IS NOT NULL ORDER BY orbit_class_type
"""))
def q_distinct_classes(spark, sf_dir):
    return CAT.distinct_classes(cleaned(spark, sf_dir))


# --- F8 -------------------------------------------------------------------------
def _usable_sql() -> str:
    parts = []
    for c in C.FLAT_COLUMNS:
        fin = (f"COALESCE(max(CASE WHEN {c} IS NOT NULL AND isfinite({c}) THEN 1 ELSE 0 END), 0) = 1"
               if c in FLAT_DOUBLE_COLUMNS or c == "num_recorded_close_approaches" else "false")
        if c == "num_recorded_close_approaches":
            fin = f"COALESCE(max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END), 0) = 1"
        parts.append(f"SELECT '{c}' AS column_name, {fin} AS has_finite, count(*) FILTER (WHERE {c} IS NULL) > 0 "
                     f"AS has_nulls, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM clean")
    return with_flat("\nUNION ALL\n".join(parts))


@query("usable_columns", _usable_sql())
def q_usable_columns(spark, sf_dir):
    return CAT.usable_columns(cleaned(spark, sf_dir), C.FLAT_COLUMNS)


# --- feature profile: the data side of the metadata queries ------------------------
FEATURES = C.ALL_NUMERIC + C.CATEGORICAL


def feature_profile(derived: DataFrame) -> DataFrame:
    """Per feature: non-null count over the clean, derived table (one pass)."""
    wide = derived.agg(*[F.count(F.col(f)).alias(f) for f in FEATURES])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("bigint").alias("n_nonnull")) for f in FEATURES
    ])).alias("s")).select("s.*")


def _profile_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, CAST(count({f}) AS BIGINT) AS n_nonnull FROM derived" for f in FEATURES)


def membership(spark: SparkSession) -> DataFrame:
    """(experiment, feature) for every feature set: tiny metadata table."""
    rows = [(k, f) for k in C.EXPERIMENTS for f in FEATURE_SETS[k].feature_columns]
    return spark.createDataFrame(rows, "experiment STRING, feature STRING")


def _membership_sql() -> str:
    vals = ", ".join(f"('{k}', '{f}')" for k in C.EXPERIMENTS for f in FEATURE_SETS[k].feature_columns)
    return f"membership(experiment, feature) AS (VALUES {vals})"


# --- P11 ------------------------------------------------------------------------
def _unit_sql(col: str) -> str:
    return (f"CASE WHEN suffix({col}, '_deg_per_day') THEN 'deg/day' WHEN suffix({col}, '_km_s') THEN 'km/s' "
            f"WHEN suffix({col}, '_au') THEN 'au' WHEN suffix({col}, '_deg') THEN 'deg' "
            f"WHEN suffix({col}, '_km') OR suffix({col}, '_km_min') OR suffix({col}, '_km_max') THEN 'km' "
            f"WHEN suffix({col}, '_days') THEN 'days' ELSE '—' END")


@query("feature_units", with_flat(f""", prof AS ({_profile_sql()})
SELECT feature, {_unit_sql('feature')} AS unit, n_nonnull FROM prof
"""))
def q_feature_units(spark, sf_dir):
    prof = feature_profile(cleaned_derived(spark, sf_dir))
    return prof.select("feature", unit_from_name("feature").alias("unit"), "n_nonnull")


# --- P12 ------------------------------------------------------------------------
def transformed_names(derived: DataFrame, fs_key: str = "original") -> DataFrame:
    """Output names of the preprocessor for a feature set: numeric names plus
    one slot per category seen in the data (alphabetical)."""
    fs = FEATURE_SETS[fs_key]
    spark = derived.sparkSession
    num = spark.createDataFrame([(f"numeric__{f}",) for f in fs.numeric_features], "raw_name STRING")
    out = num
    for c in fs.categorical_features:
        cats = derived.select(c).filter(F.col(c).isNotNull()).distinct().select(
            F.concat(F.lit(f"categorical__{c}_"), F.col(c)).alias("raw_name"))
        out = out.unionByName(cats)
    return out


@query("strip_prefix", with_flat("""
SELECT raw_name, regexp_replace(raw_name, '^.*?__', '') AS feature FROM (
  SELECT 'numeric__' || f AS raw_name FROM (VALUES __NUM__) t(f)
  UNION ALL
  SELECT DISTINCT 'categorical__orbit_class_type_' || orbit_class_type FROM derived WHERE orbit_class_type IS NOT NULL)
""".replace("__NUM__", ", ".join(f"('{f}')" for f in FEATURE_SETS["original"].numeric_features))))
def q_strip_prefix(spark, sf_dir):
    names = transformed_names(cleaned_derived(spark, sf_dir))
    return names.select("raw_name", strip_prefix("raw_name").alias("feature"))


# --- U2 -------------------------------------------------------------------------
@query("feature_sets", with_flat(f""", {_membership_sql()}, prof AS ({_profile_sql()})
SELECT m.experiment, m.feature, p.n_nonnull,
       m.feature IN (SELECT f FROM (VALUES {", ".join(f"('{f}')" for f in C.ALL_NUMERIC)}) a(f)
                     EXCEPT SELECT f FROM (VALUES {", ".join(f"('{f}')" for f in sorted(EXCLUDED))}) b(f))
         AS in_numeric_minus_excluded
FROM membership m JOIN prof p ON m.feature = p.feature
"""))
def q_feature_sets(spark, sf_dir):
    prof = feature_profile(cleaned_derived(spark, sf_dir))
    mem = membership(spark)
    allnum = spark.createDataFrame([(f,) for f in C.ALL_NUMERIC], "feature STRING")
    excl = spark.createDataFrame([(f,) for f in sorted(EXCLUDED)], "feature STRING")
    kept = allnum.exceptAll(excl).withColumn("in_numeric_minus_excluded", F.lit(True))
    j = mem.join(F.broadcast(prof), "feature", "inner").join(F.broadcast(kept), "feature", "left")
    return j.select("experiment", "feature", "n_nonnull",
                    F.coalesce("in_numeric_minus_excluded", F.lit(False)).alias("in_numeric_minus_excluded"))


# --- U1 + M21 ----------------------------------------------------------------------
@query("leakage_check", with_flat(f""", {_membership_sql()}, prof AS ({_profile_sql()}),
excluded AS (SELECT f FROM (VALUES {", ".join(f"('{f}')" for f in C.CATEGORY_A_LABEL_DEFINING)}) a(f)
             UNION SELECT f FROM (VALUES {", ".join(f"('{f}')" for f in C.CATEGORY_B_LABEL_DERIVED)}) b(f)),
used AS (SELECT m.experiment, m.feature FROM membership m JOIN prof p ON m.feature = p.feature
         WHERE p.n_nonnull > 0)
SELECT e.experiment,
       CAST((SELECT count(*) FROM (SELECT feature FROM used u WHERE u.experiment = e.experiment
                                   INTERSECT SELECT f FROM excluded)) AS BIGINT) AS n_leaked,
       CAST((SELECT count(*) FROM used u WHERE u.experiment = e.experiment
               AND regexp_replace(u.feature, '^log_', '') IN (SELECT f FROM excluded)) AS BIGINT) AS n_leaked_or_log
FROM (SELECT DISTINCT experiment FROM membership) e
"""))
def q_leakage_check(spark, sf_dir):
    prof = feature_profile(cleaned_derived(spark, sf_dir)).filter(F.col("n_nonnull") > 0)
    used = membership(spark).join(F.broadcast(prof), "feature", "inner").select("experiment", "feature")
    a = spark.createDataFrame([(f,) for f in C.CATEGORY_A_LABEL_DEFINING], "feature STRING")
    b = spark.createDataFrame([(f,) for f in C.CATEGORY_B_LABEL_DERIVED], "feature STRING")
    excluded = a.union(b).distinct()
    rows = []
    for k in C.EXPERIMENTS:
        u = used.filter(F.col("experiment") == k).select("feature")
        leaked = u.intersect(excluded).agg(F.count(F.lit(1)).alias("n_leaked"))
        base = u.select(F.regexp_replace("feature", "^log_", "").alias("feature"))
        leaked_log = base.join(F.broadcast(excluded), "feature", "left_semi").agg(
            F.count(F.lit(1)).alias("n_leaked_or_log"))
        rows.append(_pair(leaked, leaked_log, k))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _pair(a: DataFrame, b: DataFrame, k: str) -> DataFrame:
    """Combine two one-row aggregates without a join."""
    return a.select(F.lit(k).alias("experiment"), F.col("n_leaked").cast("bigint"),
                    F.lit(None).cast("bigint").alias("n_leaked_or_log")).unionByName(
        b.select(F.lit(k).alias("experiment"), F.lit(None).cast("bigint").alias("n_leaked"),
                 F.col("n_leaked_or_log").cast("bigint"))).groupBy("experiment").agg(
        F.max("n_leaked").alias("n_leaked"), F.max("n_leaked_or_log").alias("n_leaked_or_log"))


# --- R4 / R5 / F9 / J4 / U4 / A24 ------------------------------------------------------
def audit_rows(spark: SparkSession) -> DataFrame:
    """Audit matrix rows: A, B, retained (D: in an audited set and not in
    A/B/F, sorted), F; unit from the derived definitions or the name rule;
    used-in flags per experiment."""
    mem = membership(spark)
    abf = spark.createDataFrame(
        [(f, "A") for f in C.CATEGORY_A_LABEL_DEFINING] + [(f, "B") for f in C.CATEGORY_B_LABEL_DERIVED]
        + [(f, "F") for f in C.CATEGORY_F_EPOCH_DEPENDENT], "feature STRING, category STRING")
    retained = (mem.filter(F.col("experiment") != "original").select("feature").distinct()
                .join(F.broadcast(abf), "feature", "left_anti").withColumn("category", F.lit("D")))
    rows = abf.unionByName(retained)
    units = spark.createDataFrame(
        [(d[0], d[3], d[1], ", ".join(d[2]), C.DERIVED_RATIONALE[d[0]]) for d in C.DERIVED_DEFINITIONS],
        "feature STRING, derived_unit STRING, formula STRING, source_fields STRING, rationale STRING")
    used = mem.groupBy("feature").pivot("experiment", C.EXPERIMENTS).agg(F.count(F.lit(1)))
    out = rows.join(F.broadcast(units), "feature", "left").join(F.broadcast(used), "feature", "left")
    return out.select(
        "feature", "category",
        F.coalesce(F.col("derived_unit"), unit_from_name("feature")).alias("unit"), "formula", "source_fields", "rationale",
        *[(F.coalesce(F.col(k), F.lit(0)) > 0).alias(f"used_{k}") for k in C.EXPERIMENTS],
    )


def feature_audit(spark: SparkSession, derived: DataFrame, category: str | None = None, q: str = "") -> DataFrame:
    rows = audit_rows(spark)
    if category:
        rows = rows.filter(F.col("category") == category)
    if q.strip():
        rows = rows.filter(F.lower("feature").contains(q.strip().lower()))
    prof = feature_profile(derived)
    return rows.join(F.broadcast(prof), "feature", "left")


def _audit_ctes() -> str:
    abf = ", ".join([f"('{f}', 'A')" for f in C.CATEGORY_A_LABEL_DEFINING]
                    + [f"('{f}', 'B')" for f in C.CATEGORY_B_LABEL_DERIVED]
                    + [f"('{f}', 'F')" for f in C.CATEGORY_F_EPOCH_DEPENDENT])
    units = ", ".join(f"('{d[0]}', '{d[3]}', '{d[1]}', '{', '.join(d[2])}', '{C.DERIVED_RATIONALE[d[0]]}')"
                      for d in C.DERIVED_DEFINITIONS)
    used = ", ".join(
        f"count(*) FILTER (WHERE experiment = '{k}') > 0 AS used_{k}" for k in C.EXPERIMENTS)
    flags = ", ".join(f"COALESCE(x.used_{k}, false) AS used_{k}" for k in C.EXPERIMENTS)
    return f""", {_membership_sql()}, prof AS ({_profile_sql()}),
abf(feature, category) AS (VALUES {abf}),
units(feature, derived_unit, formula, source_fields, rationale) AS (VALUES {units}),
arows AS (SELECT feature, category FROM abf
          UNION ALL
          SELECT feature, 'D' FROM (SELECT DISTINCT feature FROM membership WHERE experiment <> 'original') r
          WHERE feature NOT IN (SELECT feature FROM abf)),
used AS (SELECT feature, {used} FROM membership GROUP BY feature),
audit AS (
  SELECT r.feature, r.category, COALESCE(u.derived_unit, {_unit_sql('r.feature')}) AS unit, formula, source_fields, rationale,
         {flags}, p.n_nonnull
  FROM arows r LEFT JOIN units u ON r.feature = u.feature LEFT JOIN used x ON r.feature = x.feature
  LEFT JOIN prof p ON r.feature = p.feature)
"""


def _audit_sql(extra_where: str = "") -> str:
    return with_flat(_audit_ctes() + f"SELECT * FROM audit {extra_where}")


@query("feature_audit", _audit_sql())
def q_feature_audit(spark, sf_dir):
    return feature_audit(spark, cleaned_derived(spark, sf_dir))


@query("feature_audit_filtered", _audit_sql("WHERE category = 'D' AND contains(lower(feature), 'log')"))
def q_feature_audit_filtered(spark, sf_dir):
    return feature_audit(spark, cleaned_derived(spark, sf_dir), category="D", q="LOG")


@query("feature_audit_counts", with_flat(_audit_ctes() + """
SELECT category, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(n_nonnull) AS BIGINT) AS n_values
FROM audit GROUP BY category"""))
def q_feature_audit_counts(spark, sf_dir):
    a = feature_audit(spark, cleaned_derived(spark, sf_dir))
    return a.groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("n_features"),
                                     F.sum("n_nonnull").cast("bigint").alias("n_values"))


# --- L6 -------------------------------------------------------------------------
@query("missing_columns", with_flat("""
SELECT column_name, null_pct, null_pct >= 25 AS warn FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round_even(COALESCE(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 0) * 100, 2) "
    f"AS null_pct FROM clean" for c in C.FLAT_COLUMNS) + ") t WHERE null_pct > 0"))
def q_missing_columns(spark, sf_dir):
    return normalise(CL.missing_columns(CL.null_profile(cleaned(spark, sf_dir), C.FLAT_COLUMNS)))
