"""Cases off the test tables: special characters, big numbers, constants, fractions of seconds."""

import datetime as dt

import pytest

from sparkprep.ml.metrics import regression_metrics
from sparkprep.operators import charts as C
from sparkprep.operators import timeseries as TS
from sparkprep.operators.cleaning import infer_types
from sparkprep.operators.features import one_hot
from sparkprep.operators.relational import filter_conditions
from sparkprep.plans import recipe as RC
from sparkprep.sources import files as SF
from sparkprep.sources import tables as ST


def test_filter_values_may_hold_logic_characters(spark):
    df = spark.createDataFrame([("R&D",), ("R AND D",), ("a|b",), ("~x",)], "s string")
    got = {r[0] for r in filter_conditions(df, {"c1": ("s", "==", "R&D"), "c2": ("s", "==", "~x")}, "c1 | c2").collect()}
    assert got == {"R&D", "~x"}
    got = {r[0] for r in filter_conditions(df, {"c1": ("s", "==", "a|b")}, "~c1").collect()}
    assert got == {"R&D", "R AND D", "~x"}


def test_whole_numbers_beyond_bigint_are_kept(spark):
    df = spark.createDataFrame([("12345678901234567890", "1"), ("5", "2")], "a string, b string")
    typed, decisions = infer_types(df)
    assert decisions == {"a": "double", "b": "bigint"}
    assert [r[0] for r in typed.orderBy("b").collect()] == [12345678901234567890.0, 5.0]


def test_fractions_of_seconds_are_times(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00.123",), ("2024-01-01 00:00:01",)], "a string")
    typed, _ = infer_types(df)
    assert sorted(r[0] for r in typed.collect()) == [dt.datetime(2024, 1, 1, 0, 0, 0, 123000), dt.datetime(2024, 1, 1, 0, 0, 1)]


def test_csv_round_trip_keeps_quotes_line_breaks_and_microseconds(spark, tmp_path):
    rows = [(1, 'x "q" y', dt.datetime(2024, 1, 1, 0, 0, 0, 123456)), (2, "two\nlines, one field", dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id bigint, s string, t timestamp_ntz")
    path = ST.export_csv(df, str(tmp_path / "out"))
    back, _ = SF.read_csv(spark, path)
    assert [tuple(r) for r in back.orderBy("id").collect()] == rows


def test_pretty_printed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"a": 1,\n   "b": {"c": 2}},\n  {"a": 3,\n   "b": {"c": 4}}\n]')
    got = SF.read_json_records(spark, str(tmp_path / "a.json"), multi_line=True)
    assert sorted(map(tuple, got.select("a", "b_c").collect())) == [(1, 2), (3, 4)]


def test_update_table_twice_leaves_no_side_folder(spark, tmp_path):
    base = str(tmp_path)
    ST.create_table(spark.range(5).selectExpr("id AS x"), base, "t")
    for n in (4, 3):
        ST.update_table(ST.read_table(spark, base, "t").where(f"x < {n}"), base, "t")
        assert ST.read_table(spark, base, "t").count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_class_plan_keeps_integer_classes(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(40)], "id int, c int")
    RC.recipe_append(spark, str(tmp_path), "t", [RC.step("resample_classes", col="c", plan={0: (5, False)}, key="id")])
    out = RC.recipe_replay(df, RC.recipe_steps(spark, str(tmp_path), "t"))
    assert {r[0]: r[1] for r in out.groupBy("c").count().collect()} == {0: 5, 1: 20}


def test_recent_range_keeps_the_time_of_day(spark):
    rows = [(dt.datetime(2024, 5, 1, 12),), (dt.datetime(2022, 5, 1, 3),), (dt.datetime(2022, 5, 1, 12),)]
    got = TS.last_years(spark.createDataFrame(rows, "t timestamp_ntz"), "t", 2)
    assert sorted(r[0] for r in got.collect()) == [rows[2][0], rows[0][0]]


def test_yearly_axis_ends_on_december_31(spark):
    df = spark.createDataFrame([(dt.datetime(1998, 8, 2),)], "t timestamp_ntz")
    got = [r["t"] for r in TS.future_axis(df, "t", 2, "Y").orderBy("step").collect()]
    assert got == [dt.datetime(1999, 12, 31), dt.datetime(2000, 12, 31)]


def test_constant_input_divides_by_nothing(spark):
    df = spark.createDataFrame([(i, 5.0, "a", 0.0) for i in range(30)], "i int, x double, k string, z double")
    assert {r["density"] for r in C.kde(df, "x", 5).collect()} == {None}
    assert [r["percent"] for r in C.pie(df, "k", "z").collect()] == [None]
    assert {r["acf"] for r in TS.acf(df, "x", "i", 3).collect()} == {None}


@pytest.mark.parametrize("off,want", [(0.0, 1.0), (1.0, 0.0)])
def test_r2_of_constant_actuals(spark, off, want):
    df = spark.createDataFrame([(5.0, 5.0 + off)] * 4, "label double, prediction double")
    assert {r[0]: r[1] for r in regression_metrics(df).collect()}["R2"] == want


def test_one_hot_level_guard_is_the_callers(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(12)], "id int, s string")
    assert len(one_hot(df, "s").columns) == 12
    with pytest.raises(ValueError):
        one_hot(df, "s", max_levels=5)


def test_scatter_points_are_whole(spark):
    df = spark.range(6000).selectExpr("id", "id * 2 AS v", "id * 3 AS w")
    assert C.points(df, ["v"], "id").count() == 6000
    assert C.pair_points(df, ["v", "w"], "id").count() == 6000
    assert C.points(df, ["v"], "id", max_rows=10).count() == 10


def test_profiles_without_categorical_or_datetime_columns(spark):
    from sparkprep.ml.runs import validate_inputs
    from sparkprep.operators import profile as D
    df = spark.createDataFrame([(1, 2.0), (2, None), (2, 5.0)], "a int, b double")
    assert D.feature_values(df, ["a", "b"]).count() == 0
    assert {r.feature: r.n_distinct for r in D.feature_profile(df, ["a", "b"]).collect()} == {"a": 2, "b": 2}
    assert [r.problem for r in validate_inputs(df, df, ["a", "b"]).collect()] == ["b: missing"]
    assert D.describe_datetimes(df).count() == 0 and D.categorical_table(df.limit(0)).count() == 0 and D.imbalance_table(df).count() == 0


def test_distinct_counts_use_no_expand_and_know_zeros_and_odd_types(spark):
    from sparkprep.operators import profile as D
    df = spark.sql("SELECT id % 7 AS a, if(id % 2 = 0, 0.0D, -0.0D) AS z, cast(cast(id % 3 as string) as binary) AS y, array(id % 4) AS l, id FROM range(500)")
    assert D.few_levels(df, df.columns, 30) == (500, {"a": 7, "z": 1, "y": 3, "l": 4})
    assert "Expand" not in D.distinct_counts(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert sorted(D.categorical_columns(df)) == ["a", "l", "y"]


def test_confusion_matrix_in_original_labels(spark):
    from sparkprep.ml.metrics import confusion_matrix
    pred = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    got = {(r.actual, r.predicted): r["count"] for r in confusion_matrix(pred, labels=["F", "O", "P"]).collect()}
    assert got == {("F", "F"): 1, ("F", "P"): 1, ("P", "F"): 0, ("P", "P"): 1}


def test_resample_ties_do_not_depend_on_the_partitioning(spark):
    from sparkprep.operators import timeseries as TS
    df = spark.range(300).selectExpr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,cast(id % 3 as int)) AS ts", "id", "pmod(id * 7919, 301) AS v")
    for by, first in ((None, "min(v)"), ("id", "min_by(v, id)")):
        want = {r[0]: r[1] for r in df.groupBy("ts").agg(__import__("pyspark").sql.functions.expr(first)).collect()}
        for n in (1, 8):
            got = TS.resample(df.repartition(n), "ts", 1, "day", "first", ["v"], order_by=by or ())
            assert {r.ts: r.v for r in got.collect()} == want
