"""Partitioned tables changed in place: only the partitions that a change touches are written."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from adlake.sources.tables import refresh_partitions


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def staged(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` written to ``path`` once; a run that is repeated takes what is there if it was finished."""
    fs, done = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def of_partitions(by: Sequence[str], values: Sequence[Row]) -> Column:
    """Rows of the given partitions; it reads partition columns only, so other folders are not opened."""
    each = [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v[c])) for c in by]) for v in values]
    return reduce(Column.__or__, each, F.lit(False))


def replace_touched(table: str, by: Sequence[str], touched: Sequence[Row], rows: DataFrame) -> None:
    """Put ``rows`` in place of the partitions ``touched``; one that has no rows left goes. ``rows`` must not read ``table``.

    A repeated run gives the same.
    """
    spark = rows.sparkSession
    left = {tuple(r) for r in rows.select(*by).distinct().collect()}   # at most the partitions touched
    gone = [v for v in touched if tuple(v[c] for c in by) not in left]
    if gone:
        # The files that rows of these partitions come from; ``inputFiles`` would name those of the whole table.
        files = (spark.read.schema(rows.schema).parquet(table).filter(of_partitions(by, gone))
                 .select("_metadata.file_path").distinct().collect())
        for folder in sorted({f[0].rsplit("/", 1)[0] for f in files}):
            fs, where = _fs(spark, folder)
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder)), True)
    if left:
        refresh_partitions(rows, table, by)
