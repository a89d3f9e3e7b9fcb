from datetime import date, datetime

from pyspark.sql import functions as F
from test_text import apply

from adlake.functions import dates

D = date


def test_relative_date_crosses_the_year(spark):
    got = apply(spark, ["Today 10:00", "Yesterday 9:00", "28 Dec", " 2 Jan", "30 Feb", "soon", None],
                lambda c: dates.relative_date(c, D(2019, 1, 5)))
    assert got == [D(2019, 1, 5), D(2019, 1, 4), D(2018, 12, 28), D(2019, 1, 2), None, None, None]


def test_fixed_formats(spark):
    assert apply(spark, ["14:05, 3 March 2018", "9:05, 13 May 2018", "x"], dates.clock_date) == [
        datetime(2018, 3, 3, 14, 5), datetime(2018, 5, 13, 9, 5), None]
    assert apply(spark, ["Sunday, March 4, 2018 at 2:05PM", "Sunday, March 4, 2018 at12:05AM", "never"],
                 dates.weekday_date) == [datetime(2018, 3, 4, 14, 5), datetime(2018, 3, 4, 0, 5), None]
    assert apply(spark, ["posted 4 March 2018 (new)", "31 April 2018", "4 Foo 2018"], dates.long_date) == [
        D(2018, 3, 4), None, None]


def test_mixed_dates(spark):
    got = apply(spark, ["2015", "Mar 2015", "Mar 2015 - Present", "Mar 2015 - May 2016", "long ago"],
                lambda c: dates.mixed_date(c, D(2020, 2, 2)))
    assert [(g.year, g.day, g.start, g.end) for g in got] == [
        (2015, None, None, None), (None, D(2015, 3, 1), None, None), (None, None, D(2015, 3, 1), D(2020, 2, 2)),
        (None, None, D(2015, 3, 1), D(2016, 5, 1)), (None, None, None, None)]
    assert got[4].raw == "long ago"


def test_last_active(spark):
    today = D(2020, 2, 2)
    got = apply(spark, ["Last Active: 3 March 2019", "Last Active: Yesterday", "Last Active: Today",
                        "Last Active: 5 Hours Ago", "Last Active: last week", "hidden", None],
                lambda c: dates.last_active(c, today))
    assert got == [D(2019, 3, 3), D(2020, 2, 1), today, today, D(2020, 1, 26), None, None]


def test_birth_date(spark):
    assert apply(spark, ["1990-02-03", "1990-02-03 00:00:00", "1990", "-", None], dates.birth_date) == [
        D(1990, 2, 3), D(1990, 2, 3), None, None, None]


def test_months_since_and_age(spark):
    df = spark.createDataFrame([(D(2019, 12, 31),), (None,)], "d date")
    assert [r[0] for r in df.select(dates.months_since(F.col("d"), D(2020, 2, 1))).collect()] == [2, -1]
    df = spark.createDataFrame([(D(2019, 2, 1),), (D(2019, 2, 2),)], "d date")
    assert [r[0] for r in df.select(dates.age_years(F.col("d"), D(2020, 2, 1))).collect()] == [1, 0]


def test_local_stamp(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 23:30:00' AS ts")
    assert tuple(df.select(*dates.local_stamp(F.col("ts"), "Africa/Cairo")).first()) == (D(2024, 1, 2), "01:30")
