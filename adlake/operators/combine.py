"""Joins, unions and small row filters used by the combine step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys for the right side of a semi or anti join, made distinct before they are shuffled:
    a hot key leaves each task once.

    They are grouped together with their own hash. So they are not yet partitioned by the
    keys alone and the join shuffles them itself, which AQE asks for before it splits a hot
    key on the left side.
    """
    return df.select(*keys, F.xxhash64(*keys).alias("_hash")).distinct().select(*keys)


def lookup_side(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right side of a join with a table that may hold a hot key, set up so that AQE can split
    the key or, once it knows the size, broadcast.

    An aggregate on the keys would hand its partitioning to the join, which then cannot be
    split. So the rows are moved by the hash of the keys first, and the join shuffles them again.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    return hashed.repartition("_hash").select(*df.columns)


def left_with(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left outer join on equal key names."""
    return df.join(other, list(keys), "left")


def left_with_many(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left outer join for an ``other`` that may hold very many rows of one key.

    AQE can split a hot key on the left of an outer join but not on the right; in an inner
    join it can split both. So matches come from an inner join, and the rows without a
    match from an anti join against the distinct keys.
    """
    matched = df.join(other, list(keys))
    unmatched = df.join(distinct_keys(other, keys), list(keys), "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def union_tables(*frames: DataFrame) -> DataFrame:
    """All rows of live and archived tables, by column name; a missing column is null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def map_or_keep(df: DataFrame, column: str, lookup: DataFrame, k: str = "k", v: str = "v") -> DataFrame:
    """The value's entry in the lookup, else the value itself."""
    renamed = lookup_side(lookup.select(F.col(k).alias("_k"), F.col(v).alias("_v")), ["_k"])
    joined = df.join(renamed, F.col(column) == F.col("_k"), "left")
    return joined.withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def map_literal(c: Column, mapping: Mapping[str, str]) -> Column:
    """As ``map_or_keep`` for a short mapping given in code: no join."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), c)


def latest_snapshot(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Rows of the latest date of each key, ties kept.

    The maximum is taken map-side and joined back on key and date. A window over the key
    would bring all rows of a hot key into one task; here AQE can split it.
    """
    latest = df.groupBy(*keys).agg(F.max(day).alias(day))
    return df.join(latest, [*keys, day], "left_semi").select(*df.columns)


def differs(c: Column, value: str) -> Column:
    """Not the value; null counts as different."""
    return ~c.eqNullSafe(F.lit(value))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First n rows by a full order; each task sends on n rows at most."""
    return df.orderBy(*order).limit(n)


def preview(df: DataFrame, column: str, value: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """A few distinct rows of one country."""
    return df.filter(F.col(column) == value).distinct().orderBy(*order).limit(n)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    frames = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
              for name, df in tables.items()]
    return union_tables(*frames)
