import math

from pyspark.sql import functions as F

from leakscope import constants as C
from leakscope.operators import catalogue as CAT


def _df(spark, rows):
    return spark.createDataFrame(rows, f"{C.ID} STRING, name STRING, orbit_class_type STRING, "
                                       f"{C.TARGET} BOOLEAN, v DOUBLE")


ROWS = [("1", "Alpha", "APO", True, 3.0), ("2", None, "AMO", False, None), ("3", "beta", "APO", True, float("nan")),
        ("4", "Gamma", None, False, 10.0), ("5", "delta", "ATE", True, 1.0)]


def test_sort_page_nulls_last_both_ways(spark):
    df = _df(spark, ROWS).filter(~F.isnan("v") | F.col("v").isNull())
    asc = [r[C.ID] for r in CAT.sort_page(df, "v", descending=False, size=25).collect()]
    desc = [r[C.ID] for r in CAT.sort_page(df, "v", descending=True, size=25).collect()]
    assert asc == ["5", "1", "4", "2"] and desc == ["4", "1", "5", "2"]


def test_list_objects_total_and_page(spark):
    df = _df(spark, ROWS)
    page = CAT.list_objects(df, hazardous_only=True, offset=1, limit=1).collect()
    assert [r[C.ID] for r in page] == ["3"] and page[0]["total_count"] == 3
    assert [r[C.ID] for r in CAT.page_after(df, "3", 2).collect()] == ["4", "5"]


def test_search_is_case_insensitive_and_null_name_safe(spark):
    df = _df(spark, ROWS)
    assert {r[C.ID] for r in CAT.search(df, q=" BETA ").collect()} == {"3"}
    assert {r[C.ID] for r in CAT.search(df, label="hazardous", orbit_class="APO").collect()} == {"1", "3"}
    assert {r[C.ID] for r in CAT.search(df, label="not").collect()} == {"2", "4"}
    assert CAT.lookup(df, "2").count() == 1 and CAT.lookup(df, "99").count() == 0


def test_histogram_finite_values_last_bin_closed(spark):
    df = _df(spark, ROWS)
    bins = CAT.histogram(df, "v", n_bins=20).orderBy("bin").collect()
    assert len(bins) == 20
    assert sum(b["n_negative"] + b["n_positive"] for b in bins) == 3  # nan and null are skipped
    assert bins[-1]["n_negative"] == 1  # the max lands in the last (closed) bin
    logb = CAT.histogram(df, "v", log_scale=True).first()
    assert logb["use_log"] is True and math.isclose(logb["x0"], 0.0)
    same = _df(spark, [("1", "a", "APO", True, 2.0), ("2", "b", "APO", False, 2.0)])
    one = CAT.histogram(same, "v").orderBy("bin").collect()
    assert one[0]["n_negative"] + one[0]["n_positive"] == 2 and one[0]["x1"] - one[0]["x0"] == 1.0


def test_column_summary_upper_median(spark):
    df = _df(spark, ROWS)
    r = CAT.column_summary(df, "v").first()
    assert (r["n"], r["min"], r["median"], r["max"]) == (3, 1.0, 3.0, 10.0)
    even = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v DOUBLE")
    assert CAT.column_summary(even, "v").first()["median"] == 3.0


def test_distinct_classes_and_usable_columns(spark):
    df = _df(spark, ROWS)
    assert [r[0] for r in CAT.distinct_classes(df).collect()] == ["AMO", "APO", "ATE"]
    use = {r["column_name"]: r for r in CAT.usable_columns(df, ["v", "name"]).collect()}
    assert use["v"]["has_finite"] and use["v"]["has_nulls"] and not use["name"]["has_finite"]
