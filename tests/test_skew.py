"""A key that holds a third of the rows must not end up in one task."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from adlake.operators import combine, maintenance, worklist

SMALL = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def page(spark, tmp_path):
    rows = spark.range(120_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20_000).alias("uid"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("postdate"),
        F.when(F.col("id") % 5 == 0, "CLOSED").otherwise("OPEN").alias("stat"), F.col("id").alias("line"))
    rows.write.parquet(f"{tmp_path}/page")
    return spark.read.parquet(f"{tmp_path}/page")


def final_plan(df):
    query = df._jdf.queryExecution()
    query.toRdd().count()
    return query.executedPlan().toString().split("== Initial Plan ==")[0]


def gone(page):
    return maintenance.distinct_keys(page.filter("stat = 'CLOSED'"), ["uid"])


def ads(page):
    return page.sparkSession.range(0, 20_100, numPartitions=4).select(F.col("id").alias("uid"), F.lit("x").alias("title"))


def lookup(page, name):
    return page.groupBy("uid").agg(F.min("postdate").alias(name))


CASES = {
    "since_mark": lambda p: worklist.since_mark(p, lookup(p, "mark"), ["uid"], "postdate", date(2020, 1, 1)),
    "map_or_keep": lambda p: combine.map_or_keep(p, "uid", lookup(p, "v").withColumnRenamed("uid", "k").withColumn(
        "v", F.length(F.col("v").cast("string")).cast("bigint"))),
    "archive_moved": lambda p: maintenance.archive_moved(p, gone(p)),
    "archive_live": lambda p: maintenance.archive_live(p, [gone(p)]),
    "within": lambda p: worklist.within(p, p, ["uid"]),
    "without": lambda p: worklist.without(p, p.filter("stat = 'OPEN'"), ["uid"]),
    "left_with_many": lambda p: combine.left_with_many(ads(p), p, ["uid"]),
    "left_with": lambda p: combine.left_with(p, combine.lookup_side(p.groupBy("uid").agg(F.max("line").alias("m")), ["uid"]), ["uid"]),
}


@pytest.mark.parametrize("name", CASES)
def test_hot_key_is_split(small_limits, page, name):
    assert "skew=true" in final_plan(CASES[name](page))


@pytest.mark.parametrize("name", CASES)
def test_result_is_whole(spark, small_limits, page, name):
    split = CASES[name](page).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("*"))).first()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert CASES[name](page).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("*"))).first() == split
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_first_wins_sends_few_rows_of_a_hot_key(small_limits, page):
    """What is shuffled is one row per key and task."""
    first = maintenance.first_wins(page.repartition(8, "line"), ["uid"], ["line"])
    plan = final_plan(first)
    assert "partial_min" in plan and "Window" not in plan
    assert first.filter("uid = 7").select("line").collect()[0][0] == 0
