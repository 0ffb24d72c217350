"""A training corpus in five stages, each on all that the one before it kept:
quality classifier, line dedup, SimHash near-dedup, benchmark decontamination
and mixing of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm import decontaminate, line_dedup, mixing, rule_classifier, simhash
from leakscope.llm.common import documents
from leakscope.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return rule_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut from the texts; a document that
    held a word and holds none any more goes. ``n_chars`` follows the text."""
    cut = line_dedup.remove_repeated_lines(docs)
    emptied = (F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_lines_removed"))
    text = F.when(F.col("n_lines_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_lines_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~emptied).withColumns(changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, numbered in ``copy``."""
    return mixing.take(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing sources", mixture)]

#: SQL can express neither the trained classifier nor the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline/{uuid.uuid4().hex}-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
