"""Sources, table lifecycle, recipes, streaming."""

import pytest
from pyspark.sql import functions as F

from sparkprep._fs import scratch_dir
from sparkprep.plans import recipe as RC
from sparkprep.sources import files as SF
from sparkprep.sources import tables as ST


def test_object_uri_and_jdbc_options():
    assert SF.object_uri("s3", "b", "/k/x.csv") == "s3a://b/k/x.csv"
    assert SF.object_uri("gcs", "b", "x.csv") == "gs://b/x.csv"
    assert SF.object_uri("azure", "c", "x.csv", "acct") == "abfss://c@acct.dfs.core.windows.net/x.csv"
    o = SF.jdbc_options("jdbc:x", query="select 1", partition_column="id", lower=0, upper=10, partitions=4)
    assert o["dbtable"] == "(select 1) q" and o["numPartitions"] == "4"
    with pytest.raises(ValueError):
        SF.jdbc_options("jdbc:x")


def test_table_lifecycle(spark, events):
    base = scratch_dir(spark, "t")
    ST.create_table(events, base, "ev.csv")
    with pytest.raises(ST.TableExists):
        ST.create_table(events, base, "ev")
    with pytest.raises(ValueError):
        ST.create_table(events.limit(0), base, "empty")
    with pytest.raises(ST.TableMissing):
        ST.update_table(events, base, "nope")
    ST.update_table(ST.read_table(spark, base, "ev").where("value > 10"), base, "ev")
    assert ST.read_table(spark, base, "ev").count() == events.where("value > 10").count()
    cat = {r.table: r for r in ST.table_catalog(spark, base).collect()}
    assert set(cat) == {"ev"} and cat["ev"].size_mb > 0


def test_device_read_prunes_partitions(spark, events):
    path = scratch_dir(spark, "dev")
    SF.write_devices(events.select(F.col("user_id").alias("device_id"), "ts", "value"), path)
    df = SF.read_devices(spark, path, devices=[1, 2, 3], start="2024-01-10 00:00:00", end="2024-01-12 00:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan
    assert df.columns[0] == "device_id"
    exp = events.where("user_id in (1,2,3) and ts between '2024-01-10 00:00:00' and '2024-01-12 00:00:00'").count()
    assert df.count() == exp


def test_recipe_roundtrip(spark, events):
    base = scratch_dir(spark, "r")
    steps = [RC.step("fill_value", value=0), RC.step("rolling", col="value", window=3, order_by=["ts", "event_id"])]
    assert RC.recipe_append(spark, base, "ev", steps[:1]) == 1
    assert RC.recipe_append(spark, base, "ev", steps[1:]) == 2
    stored = RC.recipe_steps(spark, base, "ev")
    assert [s["op"] for s in stored] == ["fill_value", "rolling"]
    out = RC.recipe_replay(events, stored)
    assert "value_mean_rolling" in out.columns and out.count() == events.count()
    with pytest.raises(KeyError):
        RC.step("exec_python_source")


def test_stream_refresh_processes_only_new_files(spark, events):
    from sparkprep.streaming.refresh import stream_refresh
    src, dst, ck = scratch_dir(spark, "s"), scratch_dir(spark, "d"), scratch_dir(spark, "c")
    ev = events.withColumn("day", F.to_date("ts"))
    ev.where("day < '2024-01-10'").write.partitionBy("day").parquet(src)
    stream_refresh(spark, src, dst, ck, ev.schema)
    n1 = spark.read.parquet(dst).count()
    stream_refresh(spark, src, dst, ck, ev.schema)  # nothing new
    assert spark.read.parquet(dst).count() == n1
    ev.where("day >= '2024-01-10'").write.mode("append").partitionBy("day").parquet(src)
    stream_refresh(spark, src, dst, ck, ev.schema)
    assert spark.read.parquet(dst).count() == events.count()


def test_csv_files_are_split_unless_a_quoted_line_break_needs_them_whole(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text('a,b\n' + ''.join(f'{i},"x ""{i}"" y"\n' for i in range(40_000)))
    broken.write_text('a,b\n1,"two\nlines"\n2,one\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        raw, _ = SF.read_csv(spark, str(plain), clean=False)
        assert raw.rdd.getNumPartitions() > 3 and raw.count() == 40_000 and raw.where("b = 'x \"7\" y'").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in SF.read_csv(spark, str(broken), clean=False)[0].collect()] == [("1", "two\nlines"), ("2", "one")]


def test_refresh_creates_then_replaces_a_table(spark, events):
    base = scratch_dir(spark, "fresh")
    steps = [RC.step("filter", conditions={"c1": ["value", ">", 10]})]
    a = SF.refresh_table(spark, events, base, "ev", "ts", "2024-01-10 00:00:00", "2024-01-11 00:00:00", steps=steps).count()
    b = SF.refresh_table(spark, events, base, "ev", "ts", "2024-01-10 00:00:00", "2024-01-12 00:00:00", period_days=2, rolling=True, steps=steps)
    assert b.count() > a and b.where("value <= 10").count() == 0
    assert b.count() == SF.refresh_slice(events, "ts", "2024-01-08 00:00:00", "2024-01-12 00:00:00").where("value > 10").count()


@pytest.mark.parametrize("text,want", [("5 jan 2021", "2021-01-05 00:00:00"), ("05-Mar-2021", "2021-03-05 00:00:00"), ("March 7, 2021", "2021-03-07 00:00:00"),
                                       ("MAR 07, 2021", "2021-03-07 00:00:00"), ("02/28/2021 12:30 am", "2021-02-28 00:30:00"), ("28.02.2021", "2021-02-28 00:00:00"),
                                       ("2021-02-28T23:30:00-02:00", "2021-03-01 01:30:00"), ("2021-02-28T23:30:00.25Z", "2021-02-28 23:30:00.250000"),
                                       ("31/12/2021", "2021-12-31 00:00:00"), ("5 apples", None), ("May be", None)])
def test_date_texts_are_recognised(spark, text, want):
    from sparkprep.operators.cleaning import infer_types
    typed, kinds = infer_types(spark.createDataFrame([(text,), (None,)], "d string"))
    assert kinds["d"].startswith("timestamp") == (want is not None)
    assert [str(r[0]) if r[0] else None for r in typed.collect()] == ([want, None] if want else [text, None])
