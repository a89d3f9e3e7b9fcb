"""Incremental loading: each micro-batch is checked against the table itself, so no state has
to be bounded and no late row is dropped."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlake.operators.combine import distinct_keys
from adlake.operators.maintenance import first_wins, one_row, upsert_changes


def read_files(spark: SparkSession, path: str, schema: T.StructType, pattern: str,
               files_per_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet files of a folder whose names match ``pattern``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that has arrived to a Parquet table, then stop. The checkpoint and the
    file sink's log make a repeated run add nothing twice."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def first_wins_available(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str],
                         order: Sequence[str]) -> None:
    """Append the rows whose key the table does not hold yet, then stop.

    Each micro-batch writes its own ``version=<batch>``. A batch run again after a failure
    reads the versions before its own and overwrites its own.
    """

    def load(batch: DataFrame, version: int) -> None:
        old = None
        if version > 0:
            # Only keys that arrived: the rest of the table is out before it is shuffled.
            stored = batch.sparkSession.read.parquet(table).filter(F.col("version") < version)
            old = stored.select(*keys).join(distinct_keys(batch, keys), list(keys), "left_semi")
        first_wins(batch, keys, order, old).write.mode("overwrite").parquet(f"{table}/version={version}")

    query = (stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def upsert_available(stream: DataFrame, table: str, checkpoint: str, key: str, loaded: str,
                     now: date, max_age_days: int = 30) -> None:
    """Bring what has arrived into a document table, then stop.

    A micro-batch appends the documents it changes as ``version=<batch>``; what is stored
    is read by key and load date only. A batch that is run again after a failure reads
    the versions before its own and overwrites its own, so it gives the same result.
    Table and checkpoint belong together.
    """

    def load(batch: DataFrame, version: int) -> None:
        stored = batch.limit(0)
        if version > 0:
            # Only keys that arrived: the rest of the table is out before it is grouped.
            arrived = batch.select(key).distinct()
            stored = (batch.sparkSession.read.parquet(table).filter(F.col("version") < version)
                      .select(key, loaded, "version").join(arrived, key, "left_semi")
                      .groupBy(key).agg(F.max_by(loaded, "version").alias(loaded)))
        changes = upsert_changes(stored, batch, key, loaded, now, max_age_days)
        changes.write.mode("overwrite").parquet(f"{table}/version={version}")

    query = (stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def compact(spark: SparkSession, table: str, out: str, key: str | None = None) -> None:
    """One version in place of many, under ``out``: all rows, or per ``key`` those of the latest
    version. The highest version number is kept, so later batches follow it."""
    rows = spark.read.parquet(table)
    last = rows.agg(F.max("version")).first()[0]
    kept = rows.drop("version") if key is None else read_documents(spark, table, key)
    kept.write.mode("overwrite").parquet(f"{out}/version={last}")


def read_documents(spark: SparkSession, table: str, key: str) -> DataFrame:
    """Present document of each key: the one of its latest version."""
    return one_row(spark.read.parquet(table), [key], F.max_by, F.col("version")).drop("version")
