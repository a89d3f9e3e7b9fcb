"""Summary tables: availability, value counts, means, activity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlake.functions import dates
from adlake.functions.features import equals_flag


def percent(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def _by_variable(df: DataFrame, columns: Sequence[str], by: Sequence[str], pct: str) -> DataFrame:
    return df.unpivot(list(by), list(columns), "variable", pct)


def missing_pct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of nulls per column, from one pass over the table."""
    row = df.agg(*[percent(F.col(c).isNull()).alias(c) for c in columns])
    return _by_variable(row, columns, [], "pct").orderBy("pct", "variable")


def available_pct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of values present per column, from one pass over the table."""
    row = df.agg(*[percent(F.col(c).isNotNull()).alias(c) for c in columns])
    return _by_variable(row, columns, [], "pct").orderBy("pct", "variable")


def available_by_group(df: DataFrame, by: str, columns: Sequence[str],
                       more_than: int = 100) -> DataFrame:
    """As ``available_pct`` per group, for groups of more than ``more_than`` rows."""
    # The group may be one of the columns, so it goes by another name meanwhile.
    rows = df.groupBy(F.col(by).alias("_group")).agg(
        F.count(F.lit(1)).alias("n"), *[percent(F.col(c).isNotNull()).alias(c) for c in columns])
    kept = rows.filter(F.col("n") > more_than)
    return _by_variable(kept, columns, ["_group", "n"], "pct").withColumnRenamed("_group", by)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each column, nulls not counted."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (texts.unpivot([], list(columns), "variable", "value")
            .filter(F.col("value").isNotNull())
            .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")))


#: Most values a sketch of frequent items may follow; a share that needs more is counted over all values.
MOST_TRACKED = 1_000_000


def _candidates(df: DataFrame, columns: Sequence[str], min_share: float) -> Column:
    """One row, as a scalar: per column (``c0``, ``c1``, ...) the hashes of values that may reach the share.

    Hashes keep the sketch small however long the values are. The sketch overstates a count by at most 3.5 / tracked of the rows. With 500 / share values
    tracked that is under a hundredth of the share, so no value at or above it is left out, and
    fewer than 2 / share come near it. Sketches of tasks merge into one row.
    """
    tracked, most = math.ceil(500 / min_share), math.ceil(2 / min_share) + 1   # null is an item too
    tops = [F.call_function("approx_top_k", F.xxhash64(F.col(c).cast("string")), F.lit(most), F.lit(tracked)) for c in columns]
    row = df.agg(*[F.transform(t, lambda x: x["item"]).alias(f"c{i}") for i, t in enumerate(tops)])
    return row.select(F.struct(*row.columns)).scalar()


def frequent_values(df: DataFrame, columns: Sequence[str], min_share: float = 0.05) -> DataFrame:
    """(variable, value, n, share) of the values that make up at least ``min_share`` of all rows.

    ``n`` is exact: a mergeable sketch finds the candidates, at most 2 / share a column, and a second pass
    counts these alone. What is shuffled is a sketch and so many counts a task, however many values
    there are. Null is no value but its rows count. An empty table has none. A share so small
    that a sketch would track over ``MOST_TRACKED`` values is found by counting every value.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    found = _candidates(df, columns, min_share) if 500 / min_share <= MOST_TRACKED else None

    def cell(i: int, c: str) -> Column:
        value = F.col(c).cast("string")
        value = value if found is None else F.when(F.array_contains(found[f"c{i}"], F.xxhash64(value)), value)
        return F.struct(F.lit(c).alias("variable"), value.alias("value"))

    row = F.struct(F.lit(None).cast("string").alias("variable"), F.lit("").alias("value"))   # counts all rows
    counts = (df.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)], row)).alias("x"))
              .filter("x.value IS NOT NULL").groupBy("x.variable", "x.value").agg(F.count(F.lit(1)).alias("n")))
    # The rare values go before the total is put beside them, so one task gets few rows.
    largest = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
    few = counts.withColumn("_place", F.row_number().over(largest)).filter(F.col("_place") <= int(1 / min_share) + 1)
    total = F.max(F.when(F.col("variable").isNull(), F.col("n"))).over(Window.partitionBy())
    shares = few.withColumn("share", F.col("n") / total)
    return shares.filter(F.col("variable").isNotNull() & (F.col("share") >= min_share)).select("variable", "value", "n", "share")


def value_share(df: DataFrame, by: str, column: str, more_than: int = 0,
                denominator: str = "table") -> DataFrame:
    """Share of each value of ``column`` inside ``by``, over the rows of the whole table or,
    with ``denominator='group'``, over those of the group."""
    counts = df.groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(by).agg(F.sum("n").alias("group_n"))
    kept = (counts.filter(F.col(column).isNotNull())
            .join(sizes.filter(F.col("group_n") > more_than), by))
    base = df.agg(F.count(F.lit(1)).alias("n")).scalar() if denominator == "table" else F.col("group_n")
    return kept.select(by, column, "n", (F.col("n") / base).alias("share"))


def count_by(df: DataFrame, by: Sequence[str], column: str, name: str = "cnt") -> DataFrame:
    """Non-null ids per group, by first key and size."""
    return (df.groupBy(*by).agg(F.count(column).alias(name))
            .orderBy(by[0], F.desc(name), *by[1:]))


def summary_stats(df: DataFrame, by: Sequence[str], uid: str, columns: Sequence[str]) -> DataFrame:
    """Ids and mean of each column per group, in one aggregate; rows with a null group
    are dropped and null values skipped."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(
        F.count(uid).alias("ads"), *[F.avg(c).alias(c) for c in columns])


def mean_std(df: DataFrame, by: str, spread: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of some columns, mean of others, per group."""
    aggregates = []
    for c in spread:
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(by).agg(*aggregates, *[F.avg(c).alias(c) for c in means])


def user_stats(links: DataFrame, users: DataFrame, key: str, today: date, by: str = "country",
               employed: str = "Working but looking for new opportunities",
               keep_missing: bool = True) -> DataFrame:
    """Age, share of women and share of employed per country of the search.

    ``users`` has gender, jobstatus and birth_date. A link without a document counts as
    neither female nor employed, unless ``keep_missing`` is off.
    """
    joined = links.select(by, key).distinct().join(users, key, "left" if keep_missing else "inner")
    flags = joined.select(
        by, dates.age_years(F.col("birth_date"), today).alias("age"),
        equals_flag(F.col("gender"), "Female").alias("female"),
        equals_flag(F.col("jobstatus"), employed).alias("employed"))
    return mean_std(flags, by, ["age"], ["female", "employed"])


def profile_by(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Count, mean and sample deviation of each column per group."""
    aggregates = []
    for c in columns:
        aggregates += [F.count(c).alias(f"{c}_count"), F.avg(c).alias(f"{c}_mean"),
                       F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(by).agg(*aggregates)


def active_within(df: DataFrame, column: str, today: date,
                  months: Sequence[int] = (1, 3, 6, 12)) -> DataFrame:
    """Share of all users active in the last 1, 3, ... months; users without a date count
    as users only."""
    age = dates.months_since(F.col(column), today)
    row = df.agg(*[F.avg(F.when((age >= 0) & (age <= m), 1.0).otherwise(0.0)).alias(str(m))
                   for m in months])
    return row.unpivot([], [str(m) for m in months], "months", "share").withColumn(
        "months", F.col("months").cast("int"))
