"""Incremental loads whose batches cost what arrived, not what is stored."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlake.operators.maintenance import any_null, one_row, upsert_changes

#: Keys are kept on local disk behind a memory cache, and snapshots go to the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_wins_stateful(spark: SparkSession, folder: str, schema: T.StructType, pattern: str, table: str, checkpoint: str,
                        keys: Sequence[str], order: Sequence[str], files_per_batch: int = 1000) -> None:
    """Append the rows of new Parquet files whose key was never seen, then stop.

    The keys seen are streaming state without a watermark, so a batch reads its own files alone and
    nothing late is dropped. Per key the state has one small row: the least (order, file, row) of the
    batch that brought it. It is an aggregate, so a task sends on one row per key however hot. Rows with
    a null in the key never collide: all of them stay, and the state has one row per file with such
    rows. The winners' rows are fetched from the batch's files by place.

    A batch run again after a failure starts from the same state and overwrites its ``version=<batch>``.
    Set ``STATE_STORE`` as ``spark.sql.streaming.stateStore.providerClass`` where keys outgrow memory. The
    number of state partitions is that of the first run's shuffle partitions.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
              .option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    rows = stream.select(*keys, *[F.col(c) for c in order if c not in keys], *place).withColumn(
        "_null", F.when(any_null(keys), F.col("_file")))
    named = [f"_key{i}" for i in range(len(keys))]
    for name, key in zip(named, keys):   # rows with a null key are one group a file
        rows = rows.withColumn(name, F.when(F.col("_null").isNull(), F.col(key)))
    now = F.current_timestamp()   # one instant a batch, the same if it is run again
    first = F.struct(*[F.col(c) for c in order], "_file", "_row")
    seen = (rows.withColumn("_at", now).groupBy(*named, "_null")
            .agg(F.min(F.struct("_at", first.alias("_first"))).alias("_least"), F.max("_at").alias("_last")))
    won = (seen.filter((F.col("_least._at") == F.col("_last")) & (F.col("_last") == now))
           .select("_null", F.col("_least._first._file").alias("_file"), F.col("_least._first._row").alias("_row")))

    def load(batch: DataFrame, version: int) -> None:
        batch.persist()
        files = [r[0] for r in batch.select("_file").distinct().collect()]   # at most files_per_batch
        out = f"{table}/version={version}"
        if not files:
            batch.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(out)
        else:
            stored = batch.sparkSession.read.schema(schema).parquet(*files).select("*", *place)
            places = batch.filter("_null IS NULL").select("_file", "_row")
            lone = batch.filter("_null IS NOT NULL").select(F.col("_null").alias("_file"))
            kept = stored.filter(~any_null(keys)).join(places, ["_file", "_row"], "left_semi").unionByName(
                stored.filter(any_null(keys)).join(lone, "_file", "left_semi"))
            kept.select(*schema.fieldNames()).write.mode("overwrite").parquet(out)
        batch.unpersist()

    (won.writeStream.foreachBatch(load).outputMode("update").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored_documents(spark: SparkSession, table: str, schema: T.StructType, arrived: Sequence[int], before: int) -> DataFrame | None:
    """The rows of the buckets in ``arrived`` with a version under ``before``; None where there are no such folders.

    Only these folders are listed and opened.
    """
    fs, _ = _fs(spark, table)
    folders = [f"{table}/bucket={b}" for b in arrived]
    there = [f for f in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f))]
    if not there:
        return None
    laid_out = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.IntegerType())])
    return (spark.read.schema(laid_out).option("basePath", table).parquet(*there).filter(F.col("version") < before))


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def upsert_by_bucket(stream: DataFrame, table: str, checkpoint: str, key: str, loaded: str, now: date,
                     max_age_days: int = 30, buckets: int = 256) -> None:
    """Bring what has arrived into a document table laid out as ``bucket=<hash of key>/version=<batch>``, then stop.

    A batch reads key and load date of the buckets that its documents belong to, and appends the
    documents it changes. A batch run again replaces its own version. ``buckets`` is fixed for a table.
    """
    def load(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", _bucket(key, buckets)).persist()
        arrived = [r[0] for r in batch.select("bucket").distinct().collect()]   # at most ``buckets``
        stored = batch.limit(0).drop("bucket")
        rows = stored_documents(spark, table, stored.schema, arrived, version)
        if rows is not None:
            known = rows.select(key, loaded, "version").join(batch.select(key).distinct(), key, "left_semi")
            stored = known.groupBy(key).agg(F.max_by(loaded, "version").alias(loaded))
        changes = upsert_changes(stored, batch.drop("bucket"), key, loaded, now, max_age_days)
        (changes.withColumn("bucket", _bucket(key, buckets)).withColumn("version", F.lit(version))
         .hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "version").parquet(table))
        batch.unpersist()

    (stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def present_documents(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The document of each key's latest version."""
    rows = spark.read.parquet(table).drop("bucket")
    return one_row(rows, [key], F.max_by, F.col("version")).drop("version")


def compact_buckets(spark: SparkSession, table: str, key: str, most_versions: int = 8) -> list[int]:
    """One version in place of many, in the buckets that have more than ``most_versions``; the buckets compacted.

    The documents of a bucket are added to its latest version, which holds no newer ones, and only
    then the older folders go. At each moment the latest version of every key is the same, so
    a run that breaks off, or a batch in between, changes nothing. Run it while no batch is writing.
    """
    fs, where = _fs(spark, table)
    versions: dict[int, list[int]] = {}
    for folder in fs.listStatus(where):
        name = folder.getPath().getName()
        if name.startswith("bucket="):
            versions[int(name[7:])] = sorted(
                int(v.getPath().getName()[8:]) for v in fs.listStatus(folder.getPath())
                if v.getPath().getName().startswith("version="))
    many = {b: v for b, v in versions.items() if len(v) > most_versions}
    if not many:
        return []
    last = spark.createDataFrame([(b, v[-1]) for b, v in many.items()], "bucket int, _last int")
    rows = spark.read.parquet(table).filter(F.col("bucket").isin(list(many)))
    kept = one_row(rows, ["bucket", key], F.max_by, F.col("version"))
    older = kept.join(F.broadcast(last), "bucket").filter(F.col("version") < F.col("_last"))
    (older.withColumn("version", F.col("_last")).select(*rows.columns).hint("rebalance", "bucket")
     .write.mode("append").partitionBy("bucket", "version").parquet(table))
    for bucket, all_versions in many.items():
        for version in all_versions[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/bucket={bucket}/version={version}"), True)
    return sorted(many)
