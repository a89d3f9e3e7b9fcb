"""A training corpus from ``documents``: each stage calls one operator and feeds the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlake.llm import decontaminate, langid, mixing, sharding, simhash
from adlake.llm.common import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells clearly; the others go."""
    return langid.accepted(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 3-word SimHash fingerprints are linked at 3 bits."""
    return simhash.one_of_each(docs, shingle=3, distance=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in a uniform order over 24 shards of equal counts, with ``shard`` and ``slot``."""
    return sharding.sharded(docs, shards=24)


STAGES = [("language_id", known_language), ("simhash_near_dedup", without_near_duplicates),
          ("benchmark_decontamination", without_benchmark), ("mix_sources", mixed_sources), ("sharding", sharded)]

#: The stages need compression, hashes and seeded draws that SQL lacks; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
