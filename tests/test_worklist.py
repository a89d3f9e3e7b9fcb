from datetime import date, timedelta

from pyspark.sql import functions as F

from adlake.operators import combine, worklist

T = date(2020, 6, 30)


def test_changed_segments_per_country(spark):
    counts = spark.createDataFrame([
        ("eg", "Centre", "cook", T - timedelta(2), 5), ("eg", "Centre", "cook", T, 6),
        ("jo", "Centre", "cook", T - timedelta(2), 9), ("jo", "Centre", "cook", T, 9),   # same name, no change
        ("eg", "North", "cook", T - timedelta(1), 1), ("eg", "North", "cook", T, 2),     # one day apart
        ("eg", "South", "cook", T - timedelta(9), 1), ("eg", "South", "cook", T - timedelta(7), 2),  # too old
        ("eg", "West", "cook", T - timedelta(7), 1), ("eg", "West", "cook", T - timedelta(5), 2),    # last day in reach
    ], "country string, region string, sector string, downloaddate date, totalposts int")
    segment = ["country", "region", "sector"]
    got = {(r.country, r.region) for r in worklist.changed_segments(counts, segment).collect()}
    assert got == {("eg", "Centre"), ("eg", "West")}
    pages = counts.filter("region <> 'North'").select("country", "region", "downloaddate")
    fetch = worklist.segments_to_fetch(counts, pages, segment, ["country", "region", "downloaddate"])
    assert {(r.country, r.region) for r in fetch.collect()} == {("eg", "Centre"), ("eg", "West"), ("eg", "North")}


def test_null_in_the_other_side_excludes_nothing(spark):
    listing = spark.createDataFrame([(1, "a"), (2, "b")], "uid int, x string")
    page = spark.createDataFrame([(1, "CLOSED", T), (None, "CLOSED", T), (2, "OPEN", T - timedelta(92))],
                                 "uid int, stat string, postdate date")
    assert [r.uid for r in worklist.open_worklist(listing, page, T).collect()] == [2]
    old = page.withColumn("postdate", F.date_sub("postdate", 1))
    assert worklist.open_worklist(listing, old, T).collect() == []  # 93 days is over


def test_weekly_rotation(spark):
    days = spark.createDataFrame([(n, T - timedelta(n)) for n in range(-7, 120)], "n int, postdate date")
    assert sorted(r.n for r in worklist.weekly_rotation(days, "postdate", T, 15).collect()) == [7 * i for i in range(15)]
    assert len(worklist.weekly_rotation(days, "postdate", T, 8).collect()) == 8


def test_high_water_and_stale(spark):
    groups = spark.createDataFrame([("eg",), ("jo",), ("ma",)], "country string")
    df = spark.createDataFrame([("eg", T - timedelta(7)), ("jo", T - timedelta(6)), ("eg", T - timedelta(9))],
                               "country string, day date")
    marks = {r.country: r.mark for r in worklist.high_water(groups, df, ["country"], "day", T).collect()}
    assert marks == {"eg": T - timedelta(7), "jo": T - timedelta(6), "ma": T - timedelta(29)}
    stale = worklist.stale_groups(groups, df, ["country"], "day", T, 7)
    assert {r.country for r in stale.collect()} == {"eg", "ma"}
    assert {r.country for r in worklist.stale_groups(groups, df, ["country"], "day", T, 1).collect()} == {"eg", "jo", "ma"}


def test_shuffled_is_repeatable_and_whole(spark):
    ids = spark.range(500)
    one = [r.id for r in worklist.shuffled(ids, "id", 1).collect()]
    assert one == [r.id for r in worklist.shuffled(ids.repartition(7), "id", 1).collect()]
    assert one != [r.id for r in worklist.shuffled(ids, "id", 2).collect()]
    assert one != list(range(500)) and sorted(one) == list(range(500))


def test_differs_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in df.filter(combine.differs(F.col("x"), "a")).collect()} == {"b", None}


def test_new_entries(spark):
    before = spark.createDataFrame([("a",), ("a",)], "s string")
    after = before.union(spark.createDataFrame([("a",), ("b",)], "s string"))
    got = {r.s: (r.old_entries, r.new_entries, r.added) for r in worklist.new_entries(before, after, ["s"]).collect()}
    assert got == {"a": (2, 3, 1), "b": (0, 1, 1)}


def test_page_status(spark):
    df = spark.createDataFrame([(None,), ("<p>gone",), ("<b id=ad>",)], "html string")
    got = [r[0] for r in df.select(worklist.page_status(F.col("html"), "id=ad")).collect()]
    assert got == ["NOT FOUND", "CLOSED", "OPEN"]


def test_map_or_keep(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    lookup = spark.createDataFrame([("a", "A")], "k string, v string")
    assert [r.x for r in combine.map_or_keep(df, "x", lookup).orderBy("x").collect()] == [None, "A", "b"]


def test_groups_without_a_mark_start_at_the_default(spark):
    days = [(c, date(2020, 6, d)) for c in ("a", "b", None) for d in (1, 9, 20)]
    df = spark.createDataFrame(days, "c string, day date")
    marks = spark.createDataFrame([("a", date(2020, 6, 15))], "c string, mark date")
    got = sorted((r.c or "", r.day.day) for r in worklist.since_mark(df, marks, ["c"], "day", date(2020, 7, 5)).collect())
    assert got == [("", 9), ("", 20), ("a", 20), ("b", 9), ("b", 20)]
