"""The queries opN_<name>: each operator over its whole table, with the columns
of its contract. ``SQL`` has the DuckDB statement of those that SQL can express;
the others are tested against brute force in tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    line_dedup,
    merkle,
    mixing,
    pii,
    prefix_trie,
    quality_rules,
    rule_classifier,
    simhash,
    substring_dedup,
    token_count,
    token_output,
    url_filter,
)
from .common import documents, shared_folder
from .sql import SQL
from .sql_trees import SQL as TREES

#: For the query only; a run on real data takes its own secret.
PII_KEY = "query key"
QUERIES: dict = {}
SQL = SQL | TREES


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeated_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_count.LIMIT).alias("over_limit"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_lines_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_entities(documents(spark, sf_dir).select("doc_id", "text"), key=PII_KEY)
    return replaced.select("doc_id", "text", "n_entities")


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_classifier.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


@query
def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    token_output.write_token_files(documents(spark, sf_dir), path)
    return token_output.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What is tampered with are the line ends of half of the texts.
    cut = F.when(F.col("text").isNotNull(), F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                      merkle.row_digest([*map(F.col, merkle.FIELDS[:-1]), cut]))
    checked = merkle.verify(merkle.manifest(documents(spark, sf_dir), claim=tampered))
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
