from pyspark.sql import functions as F

from gridframe.functions import names


def test_record_time_strict(spark):
    df = spark.createDataFrame(
        [("pgbh02.gdas.1979010100.grb2",), ("pgbh02.gdas.1979010106.grb2x",), ("xgbh02.gdas.1979010100.grb2",),
         ("pgbh02.gdas.1979130100.grb2",), ("pgbh02.gdas.1979023000.grb2",)],
        "record_name string",
    )
    out = df.select("record_name", names.record_time_ms("record_name").alias("ms")).collect()
    got = {r["record_name"]: r["ms"] for r in out}
    assert got["pgbh02.gdas.1979010100.grb2"] == 283996800000
    # trailing text, wrong prefix, month 13, 30 February: null, not a wrong time
    assert [got[k] for k in list(got)[1:]] == [None, None, None, None]


def test_time_zone_independent(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Denver")
    try:
        v = spark.range(1).select(names.record_time_ms(F.lit("pgbh02.gdas.1979010100.grb2"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert v == 283996800000


def test_decoded_name_and_archive(spark):
    row = spark.range(1).select(
        names.decoded_name(F.lit("a.grb2.grb2")).alias("nc"),
        names.archive_name_for(F.lit("1980-02-27 06:00:00").cast("timestamp")).alias("feb"),
        names.archive_name_for(F.lit("1979-01-05 18:00:00").cast("timestamp")).alias("jan"),
        names.archive_first_day(F.lit("pgbh02.gdas.20101226-20101231.tar")).cast("string").alias("first"),
        names.archive_last_day(F.lit("pgbh02.gdas.20101226-20101231.tar")).cast("string").alias("last"),
        names.archive_first_day(F.lit("pgbh02.gdas.2010122-20101231.tar")).alias("bad"),
    ).first()
    assert row["nc"] == "a.grb2.nc"
    assert row["feb"] == "pgbh02.gdas.19800226-19800229.tar"
    assert row["jan"] == "pgbh02.gdas.19790101-19790105.tar"
    assert (row["first"], row["last"], row["bad"]) == ("2010-12-26", "2010-12-31", None)
