"""Reading and writing of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOOKUP_SCHEMA = "k string, v string"


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table in even partitions for work that is heavy per row, whatever its files
    look like. The rows are dealt without a key, so no key can be hot; AQE picks the number."""
    return scan.hint("rebalance")


def tasks_for(scan: DataFrame, rows: int = 500_000) -> int | None:
    """Number of partitions for a shuffle of a scanned table, so that a task has about so many rows, and no fewer than the
    cores; None if one task has them all. The session's number does not count: however large, AQE joins its partitions
    into tasks of up to its advisory size, millions of narrow rows. The count is read from the files' footers."""
    tasks = -(-scan.count() // rows)
    return max(tasks, scan.sparkSession.sparkContext.defaultParallelism) if tasks > 1 else None


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             date_format: str = "yyyy-MM-dd", multi_line: bool = False) -> DataFrame:
    """CSV with a header row, read under a declared schema. A file is one task only if
    ``multi_line`` says that values may hold line breaks."""
    return (spark.read.schema(schema).option("header", True).option("dateFormat", date_format)
            .option("multiLine", multi_line).option("escape", '"').csv(path))


def scan_csv_checked(spark: SparkSession, path: str, schema: T.StructType,
                     date_format: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """CSV as in ``scan_csv``, parted into good rows and rejects (``line`` and ``file``).

    A line is rejected if it has another number of columns or a value that is not of its column's
    type; in ``scan_csv`` such values become null. Both frames are lazy, and their rows add up to the lines.
    """
    marked = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    rows = (spark.read.schema(marked).option("header", True).option("dateFormat", date_format).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path))
    good = rows.filter(F.col("_line").isNull()).drop("_line")
    # The reader does not give the marker alone: a condition that always holds names the other columns.
    parsed = F.length(F.concat_ws("", *[F.col(f.name).cast("string") for f in schema.fields])) >= 0
    return good, rows.filter(F.col("_line").isNotNull() & parsed).select(
        F.col("_line").alias("line"), F.col("_metadata.file_path").alias("file"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row and no row number; one file per partition."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def export_csv(frames: Mapping[str, DataFrame], folder: str) -> None:
    """Every table as CSV, in a folder of its name."""
    for name, df in frames.items():
        write_csv(df, f"{folder}/{name}")


def scan_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON-lines documents that carry no ``error``.

    The schema is given, so a missing field is null and no inference pass is made.
    """
    return spark.read.schema(schema).json(path).filter(F.col("error").isNull())


def scan_open_documents(spark: SparkSession, path: str, known: T.StructType, rest: str = "document") -> DataFrame:
    """JSON-lines documents of open schema: the ``known`` fields typed, and the whole document as VARIANT in ``rest``.

    An unknown field stays in ``rest``. So does a known one whose value does not fit its type; its column
    is null, or the JSON text of the value if it is a string. Lines that are no JSON object, and documents with an ``error``, are left out, as in ``scan_documents``.
    """
    lines = spark.read.text(path).select(F.try_parse_json("value").alias(rest))
    error = F.try_variant_get(rest, "$.error", "variant")
    whole = lines.filter(F.schema_of_variant(rest).startswith("OBJECT") & (error.isNull() | F.is_variant_null(error)))
    fields = [F.try_variant_get(rest, f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in known.fields]
    return whole.select(*fields, rest)


def write_open_documents(df: DataFrame, path: str, rest: str = "document") -> None:
    """The documents of ``scan_open_documents`` as JSON lines again, unknown fields and all."""
    df.select(F.to_json(rest)).write.mode("overwrite").text(path)


def scan_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Two-column CSV without header as (k, v); of a repeated key the last line wins.

    "Last" needs an order, so the place of a line in the lookup file decides: the byte
    block it starts in and the line number inside the block.
    """
    lines = (spark.read.schema(LOOKUP_SCHEMA).option("header", False).csv(path)
             .select("k", "v",
                     F.struct("_metadata.file_path", "_metadata.file_block_start",
                              F.monotonically_increasing_id()).alias("at")))
    return lines.groupBy("k").agg(F.max_by("v", "at").alias("v"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                mode: str = "append", max_records_per_file: int = 5_000_000) -> None:
    """Parquet table. ``rebalance`` lets AQE split a hot partition value over several
    tasks and merge the small ones, instead of one task per value."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str,
                   mode: str = "overwrite") -> None:
    """Catalog table clustered by its keys, so that joins and aggregates on them (first-wins,
    archive, work lists) need no shuffle. ``buckets`` sets the size of a task: table size
    over about 1 GB. Not for tables with a hot key: a bucket is not split."""
    (df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(table))


def refresh_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace just the partitions that occur in ``df``; the others stay as they are."""
    (df.hint("rebalance", *partition_by).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))


def flush_archive(archive: DataFrame, path: str, today: date) -> bool:
    """On the first of a month write the staged archive to ``month=yyyyMM``.

    Returns whether it was written; the caller then empties the staging table with
    ``empty_like``. Writing the same month again replaces it, so a retry is harmless.
    """
    if today.day != 1:
        return False
    refresh_partitions(archive.withColumn("month", F.lit(f"{today:%Y%m}")), path, ["month"])
    return True


def save_raw_pages(pages: DataFrame, path: str, day: date, uid: str = "page_id",
                   html: str = "html") -> None:
    """Keep the unparsed page text of a day so it can be parsed again later. A repeated run
    replaces that day and leaves the others."""
    pages.select(uid, html).write.mode("overwrite").parquet(f"{path}/downloaddate={day}")


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, same schema: an archive twin, or a table that is reset."""
    return df.sparkSession.createDataFrame([], df.schema)


def create_empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def migrate(df: DataFrame, schema: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename columns, then fit the frame to ``schema``: reorder, widen, add nulls."""
    return df.withColumnsRenamed(renames or {}).to(schema)
