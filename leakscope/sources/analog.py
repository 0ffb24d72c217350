"""The object catalogue analog on the driver tables.

object  = an ``orders`` row, id ``o_orderkey`` (as text)
events  = its ``lineitem`` rows; distance = ``l_extendedprice`` sent as text,
          'n/a' when the discount is zero (exercises the safe parse and
          the null-distance skip); velocity = ``l_quantity``
class   = ``o_orderpriority``
label   = price <= 250000 and closest distance <= 20000 (null when no event
          has a distance), i.e. ``absolute_magnitude_h <= 25 and moid_au <= 0.2``

The event side is reduced per order with partial aggregates only (count,
min/max/sum, min over a struct for the arg-min). A minimum over a struct is
sorted for, so the narrow event rows are first dealt out by order and a salt
of the event to tasks of bounded rows: no sort depends on the size of a file
split, and a hot order is combined by ``SALTS`` tasks and never collected into
one. The reduced side stays hash-partitioned on the order key, so the join to
``orders`` shuffles only the orders side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.functions.scalar import date_text, safe_double
from leakscope.session import input_state, run_table
from leakscope.sources.raw import MissingInputError

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (Parquet, schema from the file footer)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        return spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            raise MissingInputError(f"load: table {name} not found at {path}") from exc
        raise


def event_distance_text(lineitem: DataFrame) -> F.Column:
    return F.when(F.col("l_discount") != 0, F.col("l_extendedprice").cast("string")).otherwise(F.lit("n/a"))


TASK_EVENTS = 1_500_000  # event rows that one task sorts
SALTS = 8


def event_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the events are dealt out to; their number comes from the files' footers."""
    def build():
        rows = load(spark, sf_dir, "lineitem").count()
        return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_EVENTS))
    return run_table(spark, ("event_tasks", *input_state(spark, sf_dir)), build)


def event_rollup(lineitem: DataFrame, tasks: int, lists: dict | None = None) -> DataFrame:
    """Per order: event count, closest event (P4 on the analog) and the
    summaries used as orbital stand-ins. The distance is parsed once in a
    projection below the shuffle (the parse is the costly part). ``lists`` names
    aggregates that hold all events of an order, over columns of ``lineitem``: with
    them the events of an order meet in one task in any case, and are dealt by order."""
    ev = lineitem.withColumn("_d", safe_double(event_distance_text(lineitem))).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate", "_d",
        *(["l_discount", "l_extendedprice"] if lists else []))
    if lists:
        ev = ev.repartition(tasks, "l_orderkey")
    else:
        salt = F.pmod(F.xxhash64("l_linenumber", "l_partkey", "l_suppkey"), F.lit(SALTS))
        ev = ev.repartition(tasks, F.col("l_orderkey"), salt)
    closest = F.min(
        F.when(
            F.col("_d").isNotNull(),
            F.struct(
                F.col("_d").alias("d"),
                F.col("l_linenumber").alias("line"),
                F.col("l_partkey").alias("part"),
                F.col("l_suppkey").alias("supp"),
                F.col("l_quantity").alias("v"),
                date_text("l_shipdate").alias("date"),
            ),
        )
    )
    return ev.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_events"),
        closest.alias("closest"),
        F.max("l_tax").alias("max_tax"),
        F.sum("l_quantity").alias("sum_qty"),
        F.min("l_quantity").alias("min_qty"),
        F.max("l_quantity").alias("max_qty"),
        F.max(F.col("l_shipdate").cast("date")).alias("last_ship"),
        F.max("l_linenumber").alias("max_line"),
        *[c.alias(name) for name, c in (lists or {}).items()],
    )


def analog_flat(spark: SparkSession, sf_dir: str, with_ordinal: bool = True, lists: dict | None = None) -> DataFrame:
    """The 25-column flat object table built from orders, lineitem, customer;
    with the columns of ``lists`` (see ``event_rollup``), where asked for."""
    orders = load(spark, sf_dir, "orders")
    lineitem = load(spark, sf_dir, "lineitem")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    tasks = event_tasks(spark, sf_dir)
    ev = event_rollup(lineitem, tasks, lists)
    # the customer join comes first, while rows are narrow; the result stays partitioned by order
    own = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left")
    if lists:  # dealt as the events are, which are not shuffled again
        own = own.repartition(tasks, "o_orderkey")
    j = own.join(ev, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    odate = F.col("o_orderdate").cast("date")
    d = F.col("closest.d")
    label = F.when(d.isNull(), F.lit(None).cast("boolean")).otherwise(
        (F.col("o_totalprice") <= 250000) & (d <= 20000))
    cols = [
        F.col("o_orderkey").cast("string").alias("neo_id"),
        F.col("c_name").alias("name"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("designation"),
        (F.col("o_totalprice") / 10000).alias("absolute_magnitude_h"),
        (F.col("o_totalprice") / 1000000).alias("estimated_diameter_km_min"),
        (F.col("o_totalprice") * 1.1 / 1000000).alias("estimated_diameter_km_max"),
        label.alias(C.TARGET),
        (F.col("o_orderstatus") == "F").alias("is_sentry_object"),
        F.coalesce(F.col("n_events"), F.lit(0)).cast("int").alias("num_recorded_close_approaches"),
        F.col("closest.date").alias("closest_approach_date"),
        d.alias("closest_miss_distance_km"),
        F.col("closest.v").alias("closest_relative_velocity_km_s"),
        F.col("o_orderpriority").alias("orbit_class_type"),
        (F.col("c_acctbal") / 10000).alias("eccentricity"),
        (F.datediff(odate, F.lit("1992-01-01").cast("date")) / 365.25).alias("semi_major_axis_au"),
        (F.col("max_tax") * 100).alias("inclination_deg"),
        (F.col("c_nationkey").cast("double") * 14.4).alias("ascending_node_longitude_deg"),
        F.col("sum_qty").alias("orbital_period_days"),
        F.col("min_qty").alias("perihelion_distance_au"),
        F.col("max_qty").alias("aphelion_distance_au"),
        (F.dayofmonth(odate).cast("double") * 12).alias("mean_anomaly_deg"),
        F.try_divide(F.lit(360.0), F.col("sum_qty")).alias("mean_motion_deg_per_day"),
        (d / 100000).alias("moid_au"),
        F.datediff(F.col("last_ship"), odate).cast("double").alias("data_arc_in_days"),
        F.col("max_line").cast("double").alias("observations_used"),
    ]
    if with_ordinal:
        # landing ordinal: page = key div 20, pos = key mod 20 -> the key itself
        cols.append(F.col("o_orderkey").alias("_ordinal"))
    return j.select(*cols, *(lists or {}))
