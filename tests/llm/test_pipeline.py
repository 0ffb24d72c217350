import corpus_pipeline
from leakscope.llm import simhash
from pyspark.sql import functions as F

from .helpers import DIR, edge, texts


def test_every_stage_takes_effect_and_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        assert out.count() <= docs.count()
        docs = out
    groups = simhash.near_duplicates(docs).groupBy("component_id").count()
    assert groups.where("count > 1").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert out.columns == [*docs.columns, "copy"] and 0 < out.count() <= 3 * docs.count()


def test_stages_take_awkward_rows_and_empty_tables(spark):
    docs = edge(spark).drop("copy")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.columns[:len(docs.columns)] == docs.columns and out.count() >= 0
        assert stage(spark, docs.where(F.lit(False)), DIR).count() == 0


def test_line_stage_drops_only_what_repeats(spark):
    page = "\n".join(f"line {i} of a page that is copied" for i in range(5))
    df = spark.createDataFrame([(1, page), (2, page), (3, f"own start\n{page}\nown end"), (4, ""), (5, None)], "doc_id long, text string")
    assert sorted(texts(corpus_pipeline.lines(spark, df, DIR)), key=str) == [(1, page), (3, "own start\nown end"), (4, ""), (5, None)]


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns[:2] == ["doc_id", "text"] and out.count() > 0
