"""Helpers shared by the operators: stored tables, ranks over all rows, attaching decisions."""

from __future__ import annotations

import zstandard
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlake.session import scratch_path

SPACE = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs start from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_tasks(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast of an object of bounded size, pickled with its class; tasks call ``cloudpickle.loads`` on it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def zstd_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained Zstandard dictionary of at most ``size`` bytes; empty where the samples are too few, small or alike."""
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 4), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def few_by_rank(df: DataFrame, rows: int, wanted: int) -> DataFrame:
    """About 4 * ``wanted`` of the ``rows`` rows of ``df``, or all if they are fewer: those of small ``rank`` (a hash).

    What all tasks together send to a sort with a limit is then bounded, whatever their number.
    """
    share = 4 * wanted / max(rows, 1)
    return df if share >= 1 else df.filter(F.pmod(F.col("rank"), F.lit(1 << 40)) < int(share * (1 << 40)))


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit digests, ``__k1`` and ``__k2``, that tell rows apart; equal rows share them."""
    plain = [F.to_json(F.struct(df[c])) if _unhashable(df.schema[c].dataType) else df[c] for c in df.columns]
    parts = [x for c in plain for x in (c, c.isNull())]
    return [F.xxhash64(*parts).alias("__k1"), F.xxhash64(F.lit(1), *parts).alias("__k2")]


def _unhashable(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def keyed(df: DataFrame) -> DataFrame:
    return df.select("*", *row_keys(df))


def with_decisions(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per distinct row of ``df`` that has a row in ``decisions``, with its columns.

    ``decisions`` is keyed by ``__k1`` and ``__k2``, each pair once. Repeated rows are folded
    before the shuffle, so that a row which comes a great many times is sent on once a task.
    """
    return keyed(df).dropDuplicates(["__k1", "__k2"]).join(decisions, ["__k1", "__k2"])


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Number the rows of ``df`` from 0 in ``order``, without gathering them in one task.

    Rows are range-partitioned and written; a table of one row per partition then carries
    the running total. ``order`` should tell rows apart, else equal rows are numbered anyhow.
    """
    cut = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("__part")), "ranked")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("__part").count().select(
        "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order)
    return (cut.join(offsets, "__part")
            .withColumn(name, (F.col("__before") + F.row_number().over(within) - 1).cast("long"))
            .drop("__part", "__before"))
