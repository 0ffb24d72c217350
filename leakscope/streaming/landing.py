"""Incremental landing: snapshot files arriving in a
landing folder are read as a stream with the explicit raw schema, flattened,
filtered (F1, F2) and deduplicated by id within a watermark on the file's
modification time, then appended to a Parquet table.

State is bounded by the watermark; the checkpoint lives in the shared
checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators.clean import drop_missing
from leakscope.operators.flatten import flatten_records
from leakscope.sources.raw import RAW_DDL


def landing_stream(spark: SparkSession, landing_dir: str, watermark: str = "1 day") -> DataFrame:
    raw = (spark.readStream.schema(RAW_DDL).option("multiLine", False).json(landing_dir)
           .withColumn("_landed_at", F.col("_metadata.file_modification_time")))
    flat = flatten_records(raw, keep_ordinal=False, carry=("_landed_at",))
    return drop_missing(flat).withWatermark("_landed_at", watermark).dropDuplicatesWithinWatermark([C.ID])


def run_available(spark: SparkSession, landing_dir: str, sink_dir: str, checkpoint_dir: str) -> None:
    """Process every file present now (availableNow trigger) and stop."""
    q = (landing_stream(spark, landing_dir).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
