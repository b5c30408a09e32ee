import datetime as dt

from dateutil.easter import easter
from pyspark.sql import functions as F

import hourglass.functions.calendar as cal


def test_easter_matches_library_1900_2099(spark):
    years = spark.range(1900, 2100).select(F.col("id").cast("int").alias("y"))
    got = {r.y: r.e for r in years.select("y", cal.easter_date("y").alias("e")).collect()}
    assert got == {y: easter(y) for y in range(1900, 2100)}


def test_holiday_dates(spark):
    days = ["2024-01-01", "2024-01-02", "2024-02-08", "2024-03-31", "2024-04-01", "2024-05-19", "2024-03-29"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(
        "d", F.to_timestamp("d").alias("ts"))
    out = {r.d: r.is_holiday for r in cal.calendar(df).collect()}
    assert [out[d] for d in days] == [1, 1, 1, 1, 1, 1, 0]


def test_school_dates(spark):
    md = ["06-24", "06-25", "08-31", "09-01", "12-24", "12-25", "12-31", "01-02", "01-03"]
    df = spark.createDataFrame([(f"2023-{m}" if m[:2] != "01" else f"2024-{m}",) for m in md], "d string")
    df = df.select("d", F.to_timestamp("d").alias("ts"))
    got = {r.d[5:]: r.is_school_holiday for r in cal.calendar(df).collect()}
    assert [got[m] for m in md] == [0, 1, 1, 0, 0, 1, 1, 1, 0]


def test_parse_format_round_trip_and_weekday(spark):
    df = spark.createDataFrame([("2022-08-01T05:00Z",)], "s string")
    r = df.select(cal.parse_ts("s").alias("ts")).select(
        cal.format_ts("ts").alias("back"), F.hour("ts").alias("h"), cal.day_of_week("ts").alias("dow")).first()
    assert r.back == "2022-08-01T05:00Z" and r.h == 5 and r.dow == 0  # a Monday


def test_attributes_width_and_one_hot(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 7),)], "ts timestamp")
    a = cal.attributes(df).first().asDict()
    assert len(a) == 1 + 45
    assert a["hour_7"] == 1 and sum(a[f"hour_{h}"] for h in range(24)) == 1
    assert a["month_3"] == 1 and a["day_of_week_6"] == 1 and a["is_holiday"] == 1


def test_one_hot_observed_only_present_levels(spark):
    df = spark.createDataFrame([(1,), (3,), (3,)], "m int")
    out = cal.one_hot_observed(df, "m", "month")
    assert sorted((r.level, r.flag) for r in out.collect()) == [("month_1", 0), ("month_1", 0), ("month_1", 1),
                                                                ("month_3", 0), ("month_3", 1), ("month_3", 1)]
