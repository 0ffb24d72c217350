"""Session helpers: one place for the settings every plan relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "leakscope") -> SparkSession:
    """Local/test session. On a cluster, the submitter's session is used as is."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the context's own where one is set, else
    the one that ``spark.checkpoint.dir`` names. Without either, a local
    session (driver and executors in one process) gets a scratch folder; on a
    cluster that is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current.isDefined():
        return current.get()
    if configured:
        sc.setCheckpointDir(configured)
        return sc._jsc.sc().getCheckpointDir().get()
    if sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="leakscope-ckpt-"))
        return sc._jsc.sc().getCheckpointDir().get()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table, inside the shared checkpoint
    folder. The folder is the application's own and goes when the driver ends."""
    own = f"{ensure_checkpoint_dir(spark).rstrip('/')}/leakscope"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{own}/{name}"


def materialize(df):
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    Used where a plan is read by several jobs (driver-side sizing actions,
    then the final query): later jobs read the written files instead of
    recomputing joins, and a lost executor costs a re-read, not a rebuild.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """``df`` as a Parquet table in the shared checkpoint folder, read again. It cuts
    the lineage like ``materialize``, but compressed and by column: a later pass reads
    the columns it uses only. The order of partitions is not kept; what needs it, or
    the guard's mark of an unknown checkpoint, is materialized."""
    path = scratch_path(df.sparkSession, f"tables/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """The input's path with its files' names, sizes and times: a key under which
    results of rewritten data are not taken for those of the old."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = at.getFileSystem(conf)
    found = [s for pattern in ("*.parquet", "*.parquet/*") for s in
             fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, pattern)) or []]
    return (sf_dir, *sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


_RUN_TABLES: dict = {}


def run_table(spark: SparkSession, key: tuple, build):
    """A per-run table (split table, search results): built once per Spark
    application and input, then reused. ``build`` must return a checkpointed
    DataFrame so that reuse never recomputes its lineage."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _RUN_TABLES:
        _RUN_TABLES[k] = build()
    return _RUN_TABLES[k]


def one_row(*frames):
    """Side by side, the single rows of several one-row aggregates, as one
    row (each row is bounded by construction; no join is planned)."""
    from pyspark.sql.types import StructType
    spark = frames[0].sparkSession
    fields, values = [], []
    for f in frames:
        r = f.first()
        for field in f.schema.fields:
            fields.append(field)
            values.append(None if r is None else r[field.name])
    return spark.createDataFrame([tuple(values)], StructType(fields))
