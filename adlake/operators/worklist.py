"""What to fetch next: high-water marks, changed segments, open and unfetched ads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.operators.combine import distinct_keys, lookup_side
from adlake.operators.maintenance import closed_or_old


def recent_days(df: DataFrame, column: str, today: date, days: int = 2) -> DataFrame:
    """Rows of the last ``days`` days; compares the bare column, so the scan is pruned."""
    return df.filter(F.col(column) >= F.lit(today - timedelta(days=days)))


def weekly_rotation(df: DataFrame, postdate: str, today: date, weeks: int = 15) -> DataFrame:
    """Ads aged 0, 7, ... 7 * (weeks - 1) days. The range on the bare column prunes the scan;
    the weekday test runs on what is left."""
    oldest = today - timedelta(days=7 * (weeks - 1))
    column = F.col(postdate)
    return df.filter(
        (column >= F.lit(oldest)) & (column < F.lit(today + timedelta(days=1)))
        & (F.datediff(F.lit(today), column) % 7 == 0)
    )


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Work list in an order that looks random and is the same on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def high_water(groups: DataFrame, df: DataFrame, by: Sequence[str], day: str, today: date,
               default_days: int = 29, name: str = "mark") -> DataFrame:
    """Latest date per group; groups without rows start ``default_days`` ago."""
    latest = df.groupBy(*by).agg(F.max(day).alias(name))
    return groups.select(*by).join(latest, list(by), "left").withColumn(
        name, F.coalesce(name, F.lit(today - timedelta(days=default_days))))


def stale_groups(groups: DataFrame, df: DataFrame, by: Sequence[str], day: str, today: date,
                 min_days: int = 7) -> DataFrame:
    """Groups to load again: never loaded, or last loaded ``min_days`` or more ago."""
    latest = df.groupBy(*by).agg(F.max(day).alias("last"))
    return (groups.select(*by).join(latest, list(by), "left")
            .filter(F.col("last").isNull() | (F.datediff(F.lit(today), "last") >= min_days)))


def since_mark(df: DataFrame, marks: DataFrame, by: Sequence[str], day: str, today: date,
               default_days: int = 29, mark: str = "mark") -> DataFrame:
    """Rows at or after their group's mark. A group without a mark, or a null group, starts
    ``default_days`` before ``today``."""
    start = F.coalesce(F.col(f"_m.{mark}"), F.lit(today - timedelta(days=default_days)))
    known = lookup_side(marks.select(*by, mark), by).alias("_m")
    on = [F.col(f"_d.{c}") == F.col(f"_m.{c}") for c in by]
    return (df.alias("_d").join(known, on, "left").filter(F.col(f"_d.{day}") >= start)
            .select(*[F.col(f"_d.{c}") for c in df.columns]))


def changed_segments(counts: DataFrame, segment: Sequence[str], day: str = "downloaddate",
                     total: str = "totalposts", lag_days: int = 2, within_days: int = 5) -> DataFrame:
    """Segments whose count differs from the one ``lag_days`` before, on a day at most
    ``within_days`` before the last day of the table."""
    last = counts.agg(F.max(day)).scalar()
    recent = counts.filter(F.col(day) >= F.date_sub(last, within_days))
    earlier = counts.select(*segment, F.date_add(day, lag_days).alias(day),
                            F.col(total).alias("_before"))
    return (recent.join(earlier, [*segment, day]).filter(F.col(total) != F.col("_before"))
            .select(*segment).distinct())


def unvisited_segments(counts: DataFrame, pages: DataFrame, segment: Sequence[str],
                       on: Sequence[str]) -> DataFrame:
    """Segments with a count on some day for which no page was loaded; ``on`` names the
    region and day columns both frames share."""
    return counts.join(distinct_keys(pages, on), list(on), "left_anti").select(*segment).distinct()


def segments_to_fetch(counts: DataFrame, pages: DataFrame, segment: Sequence[str],
                      on: Sequence[str], day: str = "downloaddate",
                      total: str = "totalposts") -> DataFrame:
    changed = changed_segments(counts, segment, day, total)
    return changed.unionByName(unvisited_segments(counts, pages, segment, on)).distinct()


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``other``. A null key in ``other`` excludes nothing, so
    it needs no filter; unlike NOT IN it cannot empty the result."""
    return df.join(distinct_keys(other, keys), list(keys), "left_anti").select(*df.columns)


def within(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(distinct_keys(other, keys), list(keys), "left_semi").select(*df.columns)


def open_worklist(listing: DataFrame, page: DataFrame, today: date, keys: Sequence[str] = ("uid",),
                  max_days: int = 93) -> DataFrame:
    """Ads no page of which is closed or at least ``max_days`` old."""
    over = closed_or_old(F.col("stat"), F.col("postdate"), today, max_days - 1)
    return without(listing, page.filter(over), keys)


def new_entries(before: DataFrame, after: DataFrame, segment: Sequence[str]) -> DataFrame:
    """Rows per segment before and after a run, and how many were added.

    Both sides are counted in one aggregate, so no join is needed.
    """
    both = before.select(*segment, F.lit(0).alias("_after")).unionByName(
        after.select(*segment, F.lit(1).alias("_after")))
    old = F.count_if(F.col("_after") == 0)
    new = F.count_if(F.col("_after") == 1)
    return (both.groupBy(*segment).agg(old.alias("old_entries"), new.alias("new_entries"))
            .filter(F.col("new_entries") > 0)
            .withColumn("added", F.col("new_entries") - F.col("old_entries")))


def page_status(html: Column, marker: str) -> Column:
    """NOT FOUND without a page, CLOSED without the marker of a live ad, else OPEN."""
    return F.when(html.isNull(), "NOT FOUND").when(~html.contains(marker), "CLOSED").otherwise("OPEN")
