"""Loading and upkeep of the stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlake.operators.combine import distinct_keys, union_tables

PAST_DAYS = 90


def closed_or_old(stat: Column, postdate: Column, today: date, max_days: int = PAST_DAYS) -> Column:
    """An ad that is over: closed, or posted more than ``max_days`` ago."""
    return (stat == "CLOSED") | (postdate < F.lit(today - timedelta(days=max_days)))


def one_row(df: DataFrame, keys: Sequence[str], pick: Callable[[Column, Column], Column],
            order: Column) -> DataFrame:
    """Per key the row with the least or greatest ``order`` (``pick`` is ``min_by`` or ``max_by``).

    An aggregate instead of a row number: each task keeps one row per key before the
    shuffle, so a key that holds a large part of the table never meets in one task. The
    keys stay the grouping columns, so a join on them next needs no further shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    row = pick(F.struct(*others), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """A text that orders rows by all of ``columns``, whatever their types (maps too)."""
    def entries(name: str) -> Column:
        # The entries of a map come in no fixed order.
        if isinstance(df.schema[name].dataType, T.MapType):
            return F.array_sort(F.map_entries(name)).alias(name)
        return F.col(name)

    return F.sha2(F.to_json(F.struct(*[entries(c) for c in columns])), 256)


def earliest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the first row by ``order``, which has to tell all rows of a key apart.

    The least row is taken as one struct that starts with the order, so each column is
    sent once. Columns that have no order, such as maps, need the longer form.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest and not [c for c in order if c not in keys]:
        return df.distinct()
    if any("map<" in df.schema[c].dataType.simpleString() for c in rest):
        return one_row(df, keys, F.min_by, F.struct(*order))
    row = F.min(F.struct(*[c for c in order if c not in keys], *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def any_null(keys: Sequence[str]) -> Column:
    condition = F.col(keys[0]).isNull()
    for key in keys[1:]:
        condition = condition | F.col(key).isNull()
    return condition


def first_wins(new: DataFrame, keys: Sequence[str], order: Sequence[str],
               old: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` that an insert which ignores known keys would add to ``old``.

    Keys already stored are skipped; of the others the first row by ``order`` stays. Rows
    with a null in the key never collide, so all of them stay. Append the result.
    """
    # First one row per key, so that a hot key does not reach the join.
    first = earliest_rows(new.filter(~any_null(keys)), keys, order)
    if old is not None:
        first = first.join(distinct_keys(old, keys), list(keys), "left_anti").select(*new.columns)
    return first.unionByName(new.filter(any_null(keys)))


def refresh_partition(old: DataFrame, new: DataFrame, column: str,
                      values: Sequence[str]) -> DataFrame:
    """``old`` with the partitions ``values`` replaced by the rows of ``new``.

    As a write use ``sources.tables.refresh_partitions``, which leaves the other
    partitions' files alone.
    """
    kept = old.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))
    return kept.unionByName(new.filter(F.col(column).isin(list(values))))


def remove_dead(df: DataFrame, dead: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without the rows whose key is among the dead pages."""
    return df.join(distinct_keys(dead, keys), list(keys), "left_anti").select(*df.columns)


def drop_errors(docs: DataFrame, error: str = "error") -> DataFrame:
    return docs.filter(F.col(error).isNull())


def assert_no_errors(docs: DataFrame, error: str = "error") -> None:
    """Raise if a document with an error is left; stops at the first one found."""
    if not docs.filter(F.col(error).isNotNull()).isEmpty():
        raise AssertionError("documents with errors are left")


def stale_upsert(old: DataFrame, new: DataFrame, key: str, loaded: str, now: date,
                 max_age_days: int = 30) -> DataFrame:
    """Stored documents after a reload.

    A new document takes the place of a stored one only if that was loaded more than
    ``max_age_days`` before ``now``; it is added if the key is not stored, else ignored.
    ``old`` has one document per key; of several new ones the latest counts.

    One aggregate over both sides: fresh stored beats new beats stale stored. Rows of one
    rank and load date go by a digest of the rest, so nested documents and maps will do.
    """
    stale = F.col(loaded) < F.lit(now - timedelta(days=max_age_days))
    both = old.withColumn("_rank", F.when(stale, 0).otherwise(2)).unionByName(
        new.withColumn("_rank", F.lit(1)))
    order = F.struct("_rank", loaded, digest(both, [c for c in old.columns if c not in (key, loaded)]))
    return one_row(both, [key], F.max_by, order).drop("_rank")


def upsert_changes(stored: DataFrame, new: DataFrame, key: str, loaded: str, now: date,
                   max_age_days: int = 30) -> DataFrame:
    """The rows of ``new`` that ``stale_upsert`` would store, to be appended as a change.

    ``stored`` needs only the key and the load date of each document, so the documents
    themselves are neither read nor written again.
    """
    order = F.struct(loaded, digest(new, [c for c in new.columns if c not in (key, loaded)]))
    latest = one_row(new, [key], F.max_by, order)
    fresh = stored.filter(F.col(loaded) >= F.lit(now - timedelta(days=max_age_days)))
    return latest.join(fresh.select(key), key, "left_anti").select(*new.columns)


def gone_ads(page: DataFrame, today: date, max_days: int = PAST_DAYS,
             keys: Sequence[str] = ("uid",), stat: str = "stat",
             postdate: str = "postdate") -> DataFrame:
    """Keys of ads any of whose rows is closed or too old."""
    over = closed_or_old(F.col(stat), F.col(postdate), today, max_days)
    return distinct_keys(page.filter(over), keys)


def archive_moved(page: DataFrame, gone: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """All page rows of the ads that are over: what is appended to the archive."""
    return page.join(gone, list(keys), "left_semi").select(*page.columns)


def archive_live(df: DataFrame, archived_keys: Sequence[DataFrame],
                 keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Rows of a live table (pages or listings) left after archiving. ``archived_keys``
    holds the keys just moved and those of earlier archive tables."""
    archived = union_tables(*[frame.select(*keys) for frame in archived_keys])
    return df.join(distinct_keys(archived, keys), list(keys), "left_anti").select(*df.columns)


def number_in_order(df: DataFrame, order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """Numbers 0, 1, ... over the whole frame by ``order``, without one task sorting it all.

    ``bucket`` has to rise with the order. Rows are numbered inside their bucket; a running
    count over the buckets, one row each, gives where the bucket starts.
    """
    bucketed = df.withColumn("_bucket", bucket)
    # A single-window sum over one row per bucket.
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (bucketed.withColumn("_place", inside).join(starts, "_bucket")
            .withColumn(name, F.col("_start") + F.col("_place") - 1)
            .drop("_bucket", "_place", "_start"))


def extend_status_names(known: DataFrame, seen: DataFrame, value: str, order: Sequence[str],
                        bucket: Column, name: str = "jobstat", id_name: str = "id") -> DataFrame:
    """Status names with their ids: known ones keep theirs, new ones follow in the order
    of first sight, starting at the number of known names.

    ``bucket`` is a column of ``seen`` that rises with ``order``, such as the day.
    """
    first = F.min(F.struct(bucket.alias("_bucket"), *order)).alias("_first")
    new = (seen.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias(name)).agg(first)
           .join(known.select(name), name, "left_anti"))
    numbered = number_in_order(new.select(name, "_first.*"), order, F.col("_bucket"), "_number")
    count_known = known.agg(F.count(F.lit(1)).alias("n")).scalar()
    added = numbered.select((F.col("_number") + count_known).cast("int").alias(id_name), name)
    return known.select(id_name, name).unionByName(added)
