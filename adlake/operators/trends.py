"""Ad counts by category over time.

An ad listed in k categories counts 1/k in each of them, once for every month it is seen.
``category_months`` is the one frame that needs the ads; its rows are countries x months x
categories, and all the tables below are made from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlake.functions.dates import month_start


def cats_per_ad(ads: DataFrame) -> DataFrame:
    """Distinct categories of each (country, uid); a null category counts as one."""
    return (ads.select("country", "uid", "cat").distinct()
            .groupBy("country", "uid").agg(F.count(F.lit(1)).alias("cats")))


def ad_weights(ads: DataFrame, whole: bool = False) -> DataFrame:
    """Distinct (month, country, uid, cat) with the ad's weight.

    ``ads`` has country, uid, cat, postdate. An ad without country or uid has no weight.
    With ``whole`` the division drops the fraction: 1 for one category, else 0.

    The distinct collapses a hot ad before it is grouped: what reaches the window is at
    most its categories times its months.
    """
    seen = ads.select("country", "uid", "cat", month_start(F.col("postdate")).alias("month")).distinct()
    per_ad = Window.partitionBy("country", "uid")
    k = F.max("_cat_number").over(per_ad)
    weight = F.floor(1 / k).cast("double") if whole else 1 / k
    known = F.col("country").isNotNull() & F.col("uid").isNotNull()
    return (seen.withColumn("_cat_number", F.dense_rank().over(per_ad.orderBy("cat")))
            .withColumn("weight", F.when(known, weight)).drop("_cat_number"))


def category_months(ads: DataFrame, whole: bool = False) -> DataFrame:
    """Weighted ads per country, month (also the null month) and category."""
    return (ad_weights(ads, whole).groupBy("country", "month", "cat")
            .agg(F.sum("weight").alias("total")))


def category_totals(months: DataFrame) -> DataFrame:
    return months.groupBy("country", "cat").agg(F.sum("total").alias("total"))


def dated(months: DataFrame) -> DataFrame:
    return months.filter(F.col("month").isNotNull())


def country_totals(months: DataFrame) -> DataFrame:
    return months.groupBy("country").agg(F.sum("total").alias("total"))


def top_categories(months: DataFrame, n: int = 5) -> DataFrame:
    """The n largest categories of each country, ties by name."""
    return _largest(category_totals(months), n)


def _per_category(months: DataFrame) -> DataFrame:
    """Per country and category: total over all months and over dated ones, first and last month."""
    return months.groupBy("country", "cat").agg(
        F.sum("total").alias("total"), F.sum(F.when(F.col("month").isNotNull(), F.col("total"))).alias("dated"),
        F.min("month").alias("low"), F.max("month").alias("high"))


def _largest(per_cat: DataFrame, n: int) -> DataFrame:
    """The n largest categories of each country, ties by name. Each task keeps n of a country before
    the shuffle, so a country's categories never meet."""
    order = Window.partitionBy("country").orderBy(F.desc(F.round("total", 9)), "cat")
    return per_cat.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def _beside(df: DataFrame, per_country: DataFrame) -> DataFrame:
    """``df`` with the columns of ``per_country`` (one row a country, the null country too)."""
    other = per_country.withColumnRenamed("country", "_country")
    return df.join(other, F.col("country").eqNullSafe(F.col("_country"))).drop("_country")


def top_share(months: DataFrame, n: int = 5) -> DataFrame:
    """Whole percent of all ads of a country that its n largest categories hold. Undated
    ads are left out above the line, not below it."""
    per_cat = _per_category(months)
    largest = _largest(per_cat, n).groupBy("country").agg(F.sum("dated").alias("dated"))
    both = _beside(per_cat.groupBy("country").agg(F.sum("total").alias("total")), largest)
    return both.select("country", F.floor(F.round(100 * F.col("dated") / F.col("total"), 6)).cast("int").alias("top_pct"))


def _span(per_cat: DataFrame, n: int) -> DataFrame:
    return _largest(per_cat, n).groupBy("country").agg(F.min("low").alias("first_month"), F.max("high").alias("last_month"))


def month_span(months: DataFrame, n: int = 5) -> DataFrame:
    """First and last month in which a country's n largest categories occur."""
    per_cat = _per_category(months)
    dated_only = per_cat.groupBy("country").agg(F.max("high").alias("_high")).filter(F.col("_high").isNotNull())
    return _beside(_span(per_cat, n), dated_only).drop("_high")


def category_change(months: DataFrame, n: int = 20, top: int = 5) -> DataFrame:
    """Change of each category from the first to the last month of ``month_span``, with its
    place from below and above; the n lowest and n highest. Categories that lack one of
    the two months have no change and no place.

    The n lowest and n highest are found as in ``_largest``. The place of one of the lowest from above
    follows from the number of changes and how many are equal to it, so no task sorts a country.
    """
    spanned = _beside(months, _span(_per_category(months), top))

    def at(month: str) -> Column:
        return F.max(F.when(F.col("month") == F.col(month), F.col("total")))

    changes = (spanned.groupBy("country", "cat").agg((at("last_month") - at("first_month")).alias("change"))
               .filter(F.col("change").isNotNull()).withColumn("_order", F.round("change", 9)))
    equal = changes.groupBy(F.col("country").alias("_country"), F.col("_order").alias("_value")).agg(F.count(F.lit(1)).alias("_equal"))
    number = equal.groupBy(F.col("_country").alias("country")).agg(F.sum("_equal").alias("_number"))
    # Both ends in one frame: each change once as it is and once with its sign turned.
    sides = changes.withColumn("_side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("_key", F.col("_side") * F.col("_order"))
    by = Window.partitionBy("country", "_side").orderBy("_key", "cat")
    picked = sides.withColumn("_near", F.row_number().over(by)).filter(F.col("_near") <= n)
    picked = picked.withColumn("_before", F.rank().over(Window.partitionBy("country", "_side").orderBy("_key")) - 1)
    counted = _beside(picked, number).join(
        equal, F.col("country").eqNullSafe(F.col("_country")) & (F.col("_order") == F.col("_value")))
    # From the other end: all that lie beyond it, and of its equals those ahead by name.
    far = (F.col("_number") - F.col("_before") - F.col("_equal") + F.col("_near") - F.col("_before")).cast("int")
    low = F.col("_side") == 1
    return counted.select(
        "country", "cat", "change", F.when(low, F.col("_near")).otherwise(far).alias("lowest"),
        F.when(low, far).otherwise(F.col("_near")).alias("highest")).distinct()


def pivot_months(months: DataFrame, categories: Sequence[str], rest: str = "other") -> DataFrame:
    """One row per country and month, one column per category, and ``rest`` for all that is
    not listed (null categories too). The list is given, so the pivot needs no pass to find it."""
    listed = F.coalesce(F.col("cat").isin(list(categories)), F.lit(False))
    named = dated(months).withColumn("cat", F.when(listed, F.col("cat")).otherwise(F.lit(rest)))
    return named.groupBy("country", "month").pivot("cat", [*categories, rest]).agg(F.sum("total"))
