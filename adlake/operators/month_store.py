"""Weighted ad counts kept up by load: a load costs the ads it changes, not all ads.

Stored are the facts (an ad is seen in a month with a category), in folders by bucket of the ad, and
the counts of facts by country, month, category and number of the ad's categories. An ad that
gains a category moves its facts from one number to another, in all its months. Loads append such
moves as whole numbers, so the counts are exact whatever the order and number of loads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlake.functions.dates import month_start
from adlake.streaming.incremental import stored_documents

FACT = ["country", "uid", "cat", "month"]


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which nulls are equal."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, on, how)


def _counted(facts: DataFrame) -> DataFrame:
    """Facts by country, month, category and number of the ad's categories; null for an ad without country or uid."""
    per_ad = Window.partitionBy("country", "uid")
    known = F.col("country").isNotNull() & F.col("uid").isNotNull()
    ranked = facts.withColumn("_rank", F.dense_rank().over(per_ad.orderBy("cat")))
    return (ranked.withColumn("cats", F.when(known, F.max("_rank").over(per_ad)))
            .groupBy("country", "month", "cat", "cats").agg(F.count(F.lit(1)).alias("n")))


def load(ads: DataFrame, store: str, version: int, buckets: int = 256) -> None:
    """Bring ``ads`` (country, uid, cat, postdate) into the store as load ``version`` (0, 1, ...).

    Facts known already change nothing. A load run again reads the loads before it and replaces its
    own. Read are the buckets of the ads that arrived; ``buckets`` is fixed for a store.
    """
    spark = ads.sparkSession
    new = (ads.select("country", "uid", "cat", month_start(F.col("postdate")).alias("month")).distinct()
           .withColumn("bucket", F.pmod(F.xxhash64("country", "uid"), F.lit(buckets)).cast("int")).persist())
    arrived = [r[0] for r in new.select("bucket").distinct().collect()]   # at most ``buckets``
    schema = new.drop("bucket").schema
    old = stored_documents(spark, f"{store}/facts", schema, arrived, version)
    old = spark.createDataFrame([], schema) if old is None else old.select(*FACT)
    fresh = _matched(new, old, FACT, "left_anti").persist()
    before = _matched(old, fresh.select("country", "uid").distinct(), ["country", "uid"], "left_semi")
    after = before.unionByName(fresh.select(*FACT))
    moves = (_counted(after).unionByName(_counted(before).withColumn("n", -F.col("n")))
             .groupBy("country", "month", "cat", "cats").agg(F.sum("n").alias("n")).filter("n <> 0"))
    moves.write.mode("overwrite").parquet(f"{store}/moves/version={version}")
    (fresh.withColumn("version", F.lit(version)).hint("rebalance", "bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{store}/facts"))
    fresh.unpersist()
    new.unpersist()


def category_months(spark: SparkSession, store: str, whole: bool = False) -> DataFrame:
    """``trends.category_months`` of all loads, from the moves alone."""
    counts = (spark.read.parquet(f"{store}/moves").groupBy("country", "month", "cat", "cats")
              .agg(F.sum("n").alias("n")).filter("n <> 0"))
    weight = F.floor(1 / F.col("cats")).cast("double") if whole else 1 / F.col("cats")
    return counts.groupBy("country", "month", "cat").agg(F.sum(F.col("n") * weight).alias("total"))


def merge_moves(spark: SparkSession, store: str, out: str) -> None:
    """The moves of all loads as one, under ``out``; the number of the last load is kept."""
    moves = spark.read.parquet(f"{store}/moves")
    last = moves.agg(F.max("version")).first()[0]
    (moves.groupBy("country", "month", "cat", "cats").agg(F.sum("n").alias("n")).filter("n <> 0")
     .write.mode("overwrite").parquet(f"{out}/version={last}"))
