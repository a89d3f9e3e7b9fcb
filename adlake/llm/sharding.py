"""Exact shard sizes by a hypergeometric communication matrix.

The rows lie in partitions of known size, the shards have exact sizes. How many rows of each
partition go to each shard is drawn from the multivariate hypergeometric law, which is what a
uniform shuffle of all rows would give. Each partition then deals out its rows by a random
permutation of those counts, the rows are exchanged, and each shard is permuted again. A shard is
permuted in cells of bounded size: a row's random number picks its cell, cells lie one after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlake.llm.common import stored

#: numpy draws the law for populations below this.
NUMPY_LIMIT = 1_000_000_000
CELL_ROWS = 10_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def draw(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` draws without return are good, for populations of any size."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, taken)) if taken else 0
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low

    def weight(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, taken - k, bad - taken + k))

    # ratio of uniforms around the mode (exact up to the rounding of lgamma)
    whole = good + bad
    mode = (taken + 1) * (good + 1) // (whole + 2)
    spread = math.sqrt(taken * (good / whole) * (bad / whole) * (whole - taken) / (whole - 1) + 0.5)
    centre, top = taken * (good / whole) + 0.5, weight(mode)
    width = 1.7155277699214135 * spread + 0.8989161620588988      # fixed values: 2 sqrt(2/e), 3 - 2 sqrt(3/e)
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(centre + width * (v - 0.5) / u) if u > 0 else low - 1
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def matrix(parts: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows of each partition that go to each shard; row and column sums are exact."""
    rng = np.random.default_rng(seed)
    room, out = list(shards), np.zeros((len(parts), len(shards)), np.int64)
    for p, n in enumerate(parts):
        rest = sum(room)
        for s in range(len(shards)):
            rest -= room[s]
            out[p, s] = got = draw(rng, room[s], rest, n)
            room[s] -= got
            n -= got
    return out


def sharded(rows: DataFrame, shards: int = 24, seed: int = 11, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, from 0 without gaps in each shard).

    Law ``rows``: counts of shards are at most one apart, whatever the sizes or copies of rows, and each
    order of all rows is equally likely. Equal rows, nulls and empty tables need no care: rows are dealt by place.
    The rows are first written, each with its partition and place there, so a lost task or another
    split of the files finds the same rows again. Columns named ``shard`` or ``slot`` are replaced.
    """
    rows = rows.drop("shard", "slot")
    keep = rows.columns
    written = stored(rows.withColumn("__sharding_id", F.monotonically_increasing_id()), "shard-input")
    part = F.shiftright("__sharding_id", 33)
    counts = {r["part"]: r["count"] for r in written.groupBy(part.alias("part")).count().collect()}  # a row per partition
    order = sorted(counts)
    sizes = shard_sizes(sum(counts.values()), shards)
    dealt = matrix([counts[p] for p in order], sizes, seed)
    shared = rows.sparkSession.sparkContext.broadcast({p: dealt[i] for i, p in enumerate(order)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = labels = numbers = None
        for batch in batches:
            ids = batch.column(len(keep)).to_numpy()
            parts, places = ids >> 33, ids & ((1 << 33) - 1)
            shard, number = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
            for p in np.unique(parts).tolist():
                if p != at:                                     # the permutation of one partition
                    at, rng = p, np.random.default_rng([seed, p])
                    labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), shared.value[p]))
                    numbers = rng.integers(0, 1 << 62, len(labels))
                mine = parts == p
                shard[mine], number[mine] = labels[places[mine]], numbers[places[mine]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(shard), pa.array(number)], [*keep, "shard", "__sharding_r"])

    schema = T.StructType(list(rows.schema.fields)).add("shard", T.IntegerType()).add("__sharding_r", T.LongType())
    out = written.mapInArrow(deal, schema)
    cells = max(1, -(-max(sizes) // cell_rows)) if sizes else 1
    out = out.withColumn("__sharding_cell", F.floor(F.col("__sharding_r") / F.lit((1 << 62) / cells)).cast("int"))
    if cells == 1:
        out = out.withColumn("__sharding_first", F.lit(0).cast("long"))
    else:
        before = Window.partitionBy("shard").orderBy("__sharding_cell").rowsBetween(Window.unboundedPreceding, -1)
        first = out.groupBy("shard", "__sharding_cell").count().select(
            "shard", "__sharding_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__sharding_first"))
        out = out.join(first, ["shard", "__sharding_cell"])
    place = F.row_number().over(Window.partitionBy("shard", "__sharding_cell").orderBy("__sharding_r"))
    return out.withColumn("slot", (F.col("__sharding_first") + place - 1).cast("long")).select(*keep, "shard", "slot")
