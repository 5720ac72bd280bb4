from pyspark.sql import functions as F

from gridframe.operators import timeaxis


def test_time_gaps_six_hourly(spark):
    stamps = ["1979-01-01 00:00:00", "1979-01-01 06:10:00", "1979-01-01 18:00:00", "1979-01-02 12:00:00"]
    df = spark.createDataFrame([(s, "a") for s in stamps] + [("1979-01-01 00:00:00", "b"), ("1979-01-01 12:00:00", "b")],
                               "ts string, var string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    gaps = timeaxis.time_gaps(df, "ts", step_hours=6, by=["var"]).select(
        "var", F.date_format("slot", "yyyyMMddHH").alias("slot")).collect()
    assert sorted((r["var"], r["slot"]) for r in gaps) == [
        ("a", "1979010112"), ("a", "1979010200"), ("a", "1979010206"), ("b", "1979010106")]


def test_time_gaps_long_span_crosses_calendar_windows(spark):
    # 3000 hourly slots > one 1024-slot calendar window; every 500th slot missing
    df = spark.range(0, 3000).where((F.col("id") % 500) != 250).select(
        (F.lit("2000-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("ts"))
    gaps = timeaxis.time_gaps(df, "ts", step_hours=1).collect()
    assert len(gaps) == 6


def test_archive_periods(spark):
    df = spark.createDataFrame([("1980-02-27 06:00:00",), ("1980-02-29 18:00:00",), ("1980-02-03 00:00:00",)],
                               "ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = {r["archive_name"]: (str(r["first_day"]), str(r["last_day"]), r["n_records"])
            for r in timeaxis.archive_periods(df, "ts").collect()}
    assert rows == {
        "pgbh02.gdas.19800226-19800229.tar": ("1980-02-26", "1980-02-29", 2),
        "pgbh02.gdas.19800201-19800205.tar": ("1980-02-01", "1980-02-05", 1),
    }


def test_column_names_time_order_with_bad_names_last(spark):
    df = spark.createDataFrame([("pgbh02.gdas.1979010106.grb2",), ("bad",), ("pgbh02.gdas.1979010100.grb2",)],
                               "record_name string")
    got = [r["record_name"] for r in timeaxis.column_names(df, order="time").orderBy("col_idx").collect()]
    assert got == ["pgbh02.gdas.1979010100.grb2", "pgbh02.gdas.1979010106.grb2", "bad"]


def test_gaps_and_periods_of_instants_ignore_session_zone(spark):
    names = spark.createDataFrame([("pgbh02.gdas.1979010100.grb2",), ("pgbh02.gdas.1979010112.grb2",),
                                   ("pgbh02.gdas.1979013118.grb2",)], "record_name string")
    spark.conf.set("spark.sql.session.timeZone", "America/Denver")
    try:
        cols = timeaxis.column_names(names, order="time")
        gaps = timeaxis.time_gaps(cols.where(F.col("col_idx") < 2), "ts", step_hours=6)
        got = [r[0] for r in gaps.select(timeaxis.record_name_for("slot")).collect()]
        periods = sorted(r["archive_name"] for r in timeaxis.archive_periods(cols, "ts").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["pgbh02.gdas.1979010106.grb2"]
    assert periods == ["pgbh02.gdas.19790101-19790105.tar", "pgbh02.gdas.19790126-19790131.tar"]


def test_off_slot_records_fill_no_slot(spark):
    df = spark.createDataFrame([("2020-01-01 00:00:00",), ("2020-01-01 09:00:00",), ("2020-01-01 12:00:00",)], "t string").select(
        F.to_timestamp_ntz("t").alias("ts"))
    assert [str(r["slot"]) for r in timeaxis.time_gaps(df, "ts", step_hours=6).collect()] == ["2020-01-01 06:00:00"]
    assert [str(r["ts"]) for r in timeaxis.off_slot_records(df, "ts").collect()] == ["2020-01-01 09:00:00"]
