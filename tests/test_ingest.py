import math

import pytest
from pyspark.sql import functions as F

from fixtures import HAZARDOUS, RECORDS, write_records
from leakscope.functions.scalar import safe_double
from leakscope.operators import clean as CL
from leakscope.operators.flatten import flatten_records, missing_required
from leakscope.sources import raw as RAW


@pytest.fixture()
def raw(spark, tmp_path):
    return RAW.read_raw_records(spark, write_records(tmp_path / "neows_browse_20240101T000000Z.json", RECORDS))


def test_flatten_picks_closest_event(raw):
    row = flatten_records(raw).filter("neo_id = '9000001'").first()
    assert row["closest_miss_distance_km"] == 200000.0
    assert row["closest_relative_velocity_km_s"] == 20.0
    assert row["num_recorded_close_approaches"] == 2
    assert row["moid_au"] == 0.01
    assert row["orbit_class_type"] == "APO"
    assert row["closest_approach_date"] == "2019-01-01"


def test_missing_parent_gives_nulls_and_zero_events(raw):
    row = flatten_records(raw).filter("neo_id = '9000003'").first()
    assert row["num_recorded_close_approaches"] == 0
    assert row["closest_miss_distance_km"] is None and row["moid_au"] is None


def test_missing_required_counts(raw):
    r = missing_required(raw).first()
    assert r["total_records"] == 5
    assert r["missing_id"] == 1
    assert r["missing_is_potentially_hazardous_asteroid"] == 1


def test_clean_report_and_first_copy_kept(raw):
    flat = flatten_records(raw)
    rep = CL.clean_report(flat).first()
    assert (rep["rows_before"], rep["rows_after"]) == (5, 2)
    assert (rep["dropped_missing_id"], rep["dropped_missing_target"], rep["dropped_duplicate_id"]) == (1, 1, 1)
    out = CL.clean(flat)
    assert out.count() == 2
    assert sorted(r["neo_id"] for r in out.collect()) == ["9000001", "9000002"]


def test_duplicate_whose_first_copy_lacks_target(spark, tmp_path):
    first = dict(HAZARDOUS, is_potentially_hazardous_asteroid=None, name="first copy")
    second = dict(HAZARDOUS, name="second copy")
    raw = RAW.read_raw_records(spark, write_records(tmp_path / "r.json", [first, second]))
    flat = flatten_records(raw)
    rep = CL.clean_report(flat).first()
    assert (rep["dropped_missing_target"], rep["dropped_duplicate_id"], rep["rows_after"]) == (1, 0, 1)
    assert CL.clean(flat).first()["name"] == "second copy"


def test_equal_distances_first_wins_and_null_distance_skipped(spark, tmp_path):
    rec = dict(HAZARDOUS, close_approach_data=[
        {"close_approach_date": "a", "relative_velocity": {"kilometers_per_second": "1"},
         "miss_distance": {"kilometers": "oops"}},
        {"close_approach_date": "b", "relative_velocity": {"kilometers_per_second": "2"},
         "miss_distance": {"kilometers": "100"}},
        {"close_approach_date": "c", "relative_velocity": {"kilometers_per_second": "3"},
         "miss_distance": {"kilometers": "100"}},
        {"close_approach_date": "d", "relative_velocity": {"kilometers_per_second": "4"},
         "miss_distance": {"kilometers": "nan"}},
    ])
    raw = RAW.read_raw_records(spark, write_records(tmp_path / "r.json", [rec]))
    row = flatten_records(raw).first()
    assert row["closest_approach_date"] == "b"
    assert row["num_recorded_close_approaches"] == 4


def test_safe_double_matches_python_float(spark):
    cases = [" 12.5 ", "inf", "-inf", "nan", "1e3", "", "0x10", "abc", None, "1.5d", "1_000", "1__0", "_1", "1_", "+7"]
    df = spark.createDataFrame([(c,) for c in cases], "t STRING")
    got = [r[0] for r in df.select(safe_double("t")).collect()]
    for c, g in zip(cases, got):
        try:
            want = float(c) if c is not None else None
        except ValueError:
            want = None
        if want is not None and math.isnan(want):
            want = None
        assert g == want, (c, g, want)


def test_corrupt_input_raises(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text('"just a string"')
    with pytest.raises(RAW.MissingInputError):
        RAW.assert_record_list(RAW.read_raw_records(spark, str(p)))


def test_missing_input_is_named(spark, tmp_path):
    with pytest.raises(RAW.MissingInputError):
        RAW.read_raw_records(spark, str(tmp_path / "nothing_here.json"))


def test_latest_snapshot(spark, tmp_path):
    write_records(tmp_path / "neows_browse_20240101T000000Z.json", RECORDS[:1])
    write_records(tmp_path / "neows_browse_20250101T000000Z.json", RECORDS[:2])
    (tmp_path / "neows_browse_20260101T000000Z.metadata.json").write_text("{}")
    latest = RAW.latest_snapshot_path(spark, str(tmp_path))
    assert latest.endswith("neows_browse_20250101T000000Z.json")
    both = RAW.read_raw_records(spark, str(tmp_path / "neows_browse_2*Z.json"))
    assert RAW.latest_snapshot_records(both).count() == 2


def test_explode_pages_and_provenance(spark):
    pages = spark.createDataFrame(
        [([{"id": "a"}, {"id": "b"}], {"number": 0, "total_pages": 2}),
         ([{"id": "c"}], {"number": 1, "total_pages": 2})],
        "near_earth_objects ARRAY<STRUCT<id: STRING>>, page STRUCT<number: BIGINT, total_pages: BIGINT>")
    landed = RAW.explode_pages(pages)
    assert sorted((r["page"], r["pos"], r["record"]["id"]) for r in landed.collect()) == \
        [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    assert RAW.explode_pages(pages, max_pages=1).count() == 2
    prov = RAW.provenance(landed, page_size=20).first()
    assert (prov["pages_fetched"], prov["records_fetched"]) == (2, 3)
    bad = spark.createDataFrame([(None, {"number": 0, "total_pages": 1})],
                                "near_earth_objects ARRAY<STRUCT<id: STRING>>, "
                                "page STRUCT<number: BIGINT, total_pages: BIGINT>")
    with pytest.raises(Exception):
        RAW.explode_pages(bad).collect()


def test_grain_check(spark):
    ok = spark.createDataFrame([("1",), ("2",), ("3",)], "neo_id STRING")
    CL.verify_grain(ok, ["neo_id"])
    bad = spark.createDataFrame([("1",), ("1",), ("2",)], "neo_id STRING")
    with pytest.raises(CL.GrainError):
        CL.verify_grain(bad, ["neo_id"])


def test_null_profile_empty_table(spark):
    df = spark.createDataFrame([], "a DOUBLE, b STRING")
    rows = {r["column_name"]: r["null_pct"] for r in CL.null_profile(df).collect()}
    assert rows == {"a": 0.0, "b": 0.0}


def test_null_profile_half_even(spark):
    # 1 of 8 missing -> 12.5 exactly; numpy rounds half to even on the binary value
    df = spark.createDataFrame([(None,)] + [(1.0,)] * 7, "a DOUBLE")
    assert CL.null_profile(df).first()["null_pct"] == 12.5
    df3 = spark.createDataFrame([(None,), (1.0,), (1.0,)], "a DOUBLE")
    assert CL.null_profile(df3).first()["null_pct"] == round(100 / 3, 2)


def test_nan_distance_is_null_not_value(spark):
    df = spark.createDataFrame([("NaN",), ("3",)], "t STRING")
    assert [r[0] for r in df.select(safe_double("t").alias("v")).orderBy(F.col("v").asc_nulls_first()).collect()] \
        == [None, 3.0]


def write_tables(spark, root):
    """Orders 1 (no events), 2 (repeated) and 3, with events of 2 and 3."""
    spark.createDataFrame([(1, 10, "F", 1000.0, "1995-01-01", "1-URGENT"), (2, 10, "P", 2000.0, "1995-01-02", "2-HIGH"),
                           (2, 11, "O", 3000.0, "1995-01-03", "2-HIGH"), (3, 99, "O", 4000.0, "1995-01-04", None)],
                          "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, "
                          "o_orderpriority string").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(2, 1, 5, 6, 7.0, 900.0, 0.0, 0.01, "1995-02-01"), (2, 2, 5, 6, 8.0, 800.0, 0.1, 0.02, "1995-02-02"),
                           (3, 1, 5, 6, 9.0, 700.0, 0.1, 0.03, "1995-02-03")],
                          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_shipdate string") \
        .write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(10, "c10", 5.0, 1), (11, "c11", 6.0, 2)],
                          "c_custkey bigint, c_name string, c_acctbal double, c_nationkey int").write.parquet(f"{root}/customer.parquet")
    return str(root)


def test_landed_snapshots_are_compressed_and_hold_every_record(spark, tmp_path):
    import os
    from leakscope.plans.q_ingest import flat, land
    from leakscope.sources.raw import read_raw_records
    tables = write_tables(spark, tmp_path)
    root = land(spark, tables, ["20240101T000000Z", "20250101T000000Z"]).removeprefix("file:")
    ids = sorted(r[0] for r in flat(spark, tables).select("neo_id").collect())
    for stamp in ("20240101T000000Z", "20250101T000000Z"):
        folder = f"{root}/neows_browse_{stamp}.json"
        parts = [n for n in os.listdir(folder) if n.startswith("part-")]
        assert parts and all(n.endswith(".json.gz") for n in parts)
        raw = read_raw_records(spark, folder, multiline=False)
        assert sorted(r[0] for r in raw.select("id").collect()) == ids == ["1", "2", "2", "3"]
        assert sorted((r[0], r[1]) for r in raw.select("id", F.size("close_approach_data")).collect()) == [
            ("1", 0), ("2", 2), ("2", 2), ("3", 1)]


def test_clean_by_the_columns_an_id_stands_for_needs_no_second_shuffle(spark):
    from pyspark.sql import functions as F
    from leakscope.operators.clean import clean
    rows = [(1, "b", True), (1, "a", True), (2, "c", None), (None, "d", True), (3, "e", False), (3, "e", False)]
    df = spark.createDataFrame(rows, "_ordinal bigint, name string, is_potentially_hazardous_asteroid boolean") \
        .repartition(4, "_ordinal").withColumn("neo_id", F.col("_ordinal").cast("string"))
    by_id, by_both = clean(df), clean(df, id_of=["_ordinal"])
    assert sorted(by_id.collect()) == sorted(by_both.collect()) and by_both.count() == 2
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(by_both) < exchanges(by_id)


def test_a_written_table_keeps_rows_types_and_metadata(spark):
    from pyspark.sql import functions as F
    from leakscope.session import written
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, float("nan"))], "k int, s string, v double") \
        .select("k", "s", F.col("v").alias("v", metadata={"sources": ["v"]}))
    out = written(df)
    assert out.schema["v"].metadata == {"sources": ["v"]} and out.dtypes == df.dtypes
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert "FileScan parquet" in out._jdf.queryExecution().executedPlan().toString()


def plan_lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_events_are_dealt_before_they_are_sorted_and_landed_in_one_shuffle(spark, tmp_path):
    from leakscope.plans.q_ingest import landed_records
    from leakscope.sources.analog import event_rollup, event_tasks, load
    tables = write_tables(spark, tmp_path)
    tasks = event_tasks(spark, tables)
    assert tasks == spark.sparkContext.defaultParallelism
    lines = plan_lines(event_rollup(load(spark, tables, "lineitem"), tasks))
    dealt = [i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1 and all(i < dealt[0] for i, line in enumerate(lines) if "Sort [" in line)
    recs = landed_records(spark, tables)
    assert sum("Exchange hashpartitioning(l_orderkey" in line for line in plan_lines(recs)) == 1
    got = {r["id"]: [(e["close_approach_date"], e["miss_distance"]["kilometers"]) for e in r["close_approach_data"]]
           for r in recs.collect()}
    assert got == {"1": [], "2": [("1995-02-01", "n/a"), ("1995-02-02", "800.0")], "3": [("1995-02-03", "700.0")]}


def test_a_hot_order_is_rolled_up_from_many_tasks(spark, tmp_path):
    from leakscope.sources.analog import SALTS, event_rollup
    rows = [(1 if i < 400 else None, i, i % 7, i % 5, float(i % 50), 1000.0 - i, 0.1 if i % 3 else 0.0, 0.01 * (i % 9),
             "1995-02-01") for i in range(500)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_shipdate string").write.parquet(f"{tmp_path}/l")
    for tasks in (1, 4 * SALTS):
        got = {r["l_orderkey"]: r for r in event_rollup(spark.read.parquet(f"{tmp_path}/l"), tasks).collect()}
        assert set(got) == {1, None}
        for key, r in got.items():
            own = [x for x in rows if x[0] == key]
            best = min((x[5], x[1], x[2], x[3], x[4], x[8]) for x in own if x[6])
            assert tuple(r["closest"]) == best and r["n_events"] == len(own)
            assert (r["sum_qty"], r["max_line"]) == (sum(x[4] for x in own), max(x[1] for x in own))


def test_clean_by_the_columns_an_id_stands_for_needs_no_second_sort(spark):
    from leakscope.operators.clean import clean
    rows = [(k, f"n{k % 7}", True) for k in range(50)] + [(3, "a", True)]
    df = spark.createDataFrame(rows, "_ordinal bigint, name string, is_potentially_hazardous_asteroid boolean") \
        .repartition(4, "_ordinal").sortWithinPartitions("_ordinal").withColumn("neo_id", F.col("_ordinal").cast("string"))
    once = clean(df, id_of=["_ordinal"])
    assert sum("Sort [" in line for line in plan_lines(once)) == 1
    assert sorted(once.collect()) == sorted(clean(df).collect()) and once.filter("neo_id = '3'").first()["name"] == "a"
