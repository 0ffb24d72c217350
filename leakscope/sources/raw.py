"""Raw nested record sources: S1 JSON scan, S2 latest snapshot, S3 paged
landing, S4 retrieval provenance.

Raw records are read with an explicit schema; numbers the source sends as
text stay STRING at the scan and are parsed by ``safe_double`` later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_DIAMETER = "STRUCT<estimated_diameter_min: DOUBLE, estimated_diameter_max: DOUBLE>"

RAW_DDL = (
    "id STRING, neo_reference_id STRING, name STRING, designation STRING, nasa_jpl_url STRING, "
    "absolute_magnitude_h DOUBLE, "
    f"estimated_diameter STRUCT<kilometers: {_DIAMETER}, meters: {_DIAMETER}, "
    f"miles: {_DIAMETER}, feet: {_DIAMETER}>, "
    "is_potentially_hazardous_asteroid BOOLEAN, is_sentry_object BOOLEAN, "
    "close_approach_data ARRAY<STRUCT<close_approach_date: STRING, close_approach_date_full: STRING, "
    "epoch_date_close_approach: BIGINT, "
    "relative_velocity: STRUCT<kilometers_per_second: STRING, kilometers_per_hour: STRING, miles_per_hour: STRING>, "
    "miss_distance: STRUCT<astronomical: STRING, lunar: STRING, kilometers: STRING, miles: STRING>, "
    "orbiting_body: STRING>>, "
    "orbital_data STRUCT<orbit_id: STRING, orbit_determination_date: STRING, first_observation_date: STRING, "
    "last_observation_date: STRING, data_arc_in_days: DOUBLE, observations_used: BIGINT, "
    "orbit_uncertainty: STRING, minimum_orbit_intersection: STRING, jupiter_tisserand_invariant: STRING, "
    "epoch_osculation: STRING, eccentricity: STRING, semi_major_axis: STRING, inclination: STRING, "
    "ascending_node_longitude: STRING, orbital_period: STRING, perihelion_distance: STRING, "
    "perihelion_argument: STRING, aphelion_distance: STRING, perihelion_time: STRING, mean_anomaly: STRING, "
    "mean_motion: STRING, equinox: STRING, "
    "orbit_class: STRUCT<orbit_class_type: STRING, orbit_class_description: STRING, orbit_class_range: STRING>>"
)

SNAPSHOT_GLOB = "neows_browse_*.json"


class MissingInputError(RuntimeError):
    """A named stage found no input; data is never substituted."""


def _with_ordinal(df: DataFrame) -> DataFrame:
    """Input-order ordinal: (file, split start, row index inside the split).
    ``monotonically_increasing_id`` grows with row order inside a task and a
    split always maps to the same task, so a recomputed task agrees."""
    return df.withColumn(
        "_ordinal",
        F.struct(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def read_raw_records(spark: SparkSession, path: str, multiline: bool = True,
                     stage: str = "scan_raw") -> DataFrame:
    """A JSON file holding a list of records (or JSON Lines when
    ``multiline=False``; prefer that or Parquet for large inputs, a multi-line
    file is read by one task).

    Malformed records land in ``_corrupt_record``; if every record is corrupt
    the input is not a record list and an error is raised.
    """
    schema = RAW_DDL + ", _corrupt_record STRING"
    try:
        df = (
            spark.read.schema(schema)
            .option("multiLine", multiline)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path)
        )
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingInputError(f"{stage}: no raw input at {path}") from exc
    return _with_ordinal(df)


def assert_record_list(df: DataFrame, stage: str = "scan_raw") -> DataFrame:
    """Raise when the scanned input holds no well-formed record (the file was
    not a list of objects). One aggregate pass; call on the cached scan."""
    # a parsed field is referenced too: Spark refuses queries that read only
    # the corrupt-record column of a raw JSON scan
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_corrupt_record").isNull() | F.col("id").isNotNull()).alias("ok"),
    ).first()
    if row["n"] > 0 and row["ok"] == 0:
        raise MissingInputError(f"{stage}: input is not a list of records")
    return df


def latest_snapshot_path(spark: SparkSession, raw_dir: str, pattern: str = SNAPSHOT_GLOB) -> str:
    """Newest snapshot by name (names carry a UTC stamp), metadata files
    excluded. Lists the directory through the Hadoop file system, so it
    works for any shared store the cluster mounts."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(raw_dir)
    fs = path.getFileSystem(conf)
    try:
        statuses = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{raw_dir.rstrip('/')}/{pattern}"))
    except Exception as exc:  # pragma: no cover - depends on the store
        raise MissingInputError(f"scan_latest_snapshot: cannot list {raw_dir}") from exc
    names = sorted(
        s.getPath().toString() for s in (statuses or [])
        if not s.getPath().getName().endswith(".metadata.json")
    )
    if not names:
        raise MissingInputError(f"scan_latest_snapshot: no raw snapshot in {raw_dir}")
    return names[-1]


SNAPSHOT_NAME = r"neows_browse_[0-9TZ]+\.json"


def snapshot_of(df: DataFrame) -> F.Column:
    """Snapshot name of each scanned row: the stamped file, or the stamped
    folder when a snapshot was landed as a directory of parts."""
    return F.regexp_extract(F.col("_metadata.file_path"), SNAPSHOT_NAME, 0)


def latest_snapshot_records(df: DataFrame) -> DataFrame:
    """S2 as a query: keep the rows of the newest snapshot among the scanned
    ones (names sort by their stamp). The newest name is a one-row aggregate
    over the file-name column, broadcast back for a semi join."""
    tagged = df.withColumn("_snapshot", snapshot_of(df))
    newest = tagged.agg(F.max("_snapshot").alias("_newest"))
    return tagged.join(F.broadcast(newest), F.col("_snapshot") == F.col("_newest"), "left_semi")


def explode_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """S3: page documents ``{near_earth_objects: [...], page: {number, total_pages}}``
    → one row per record with ``(page, pos)`` as the landing ordinal.

    A page without the record array is an error, as in the landing tool.
    ``max_pages`` keeps pages ``< max_pages`` (the fetch limit); pages past
    ``total_pages`` are dropped.
    """
    checked = pages.withColumn(
        "_ok",
        F.when(F.col("near_earth_objects").isNull(),
               F.raise_error(F.lit("explode_pages: page without 'near_earth_objects'")))
        .otherwise(F.lit(True)),
    )
    kept = checked.filter(
        F.col("_ok")
        & (F.col("page.number") < F.coalesce(F.col("page.total_pages"), F.col("page.number") + 1))
    )
    if max_pages is not None:
        kept = kept.filter(F.col("page.number") < F.lit(max_pages))
    # explode_outer: a plain explode lets the optimizer infer a not-null
    # filter on the array and silently drop the malformed page
    return kept.select(
        F.col("page.number").alias("page"),
        F.col("page.total_pages").alias("total_pages"),
        F.posexplode_outer("near_earth_objects").alias("pos", "record"),
    ).filter(F.col("pos").isNotNull())


def provenance(landed: DataFrame, page_size: int | None = None,
               max_pages: int | None = None) -> DataFrame:
    """One-row retrieval record over the landed rows."""
    return landed.agg(
        F.count_distinct("page").cast("bigint").alias("pages_fetched"),
        F.count(F.lit(1)).cast("bigint").alias("records_fetched"),
        F.max("total_pages").cast("bigint").alias("total_pages"),
        F.lit(page_size).cast("bigint").alias("requested_page_size"),
        F.lit(max_pages).cast("bigint").alias("max_pages_requested"),
    )
