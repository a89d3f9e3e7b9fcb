"""Exact k best scores of each query, by distributed histogram selection.

Every row is scored against every query; scores are integers. A first histogram over the whole
range of scores tells in which bin a query's k-th best score lies, the next one looks into that
bin only, until a bin is a single score. Then all rows above that score are taken, and of those
that tie with it the smallest ids: each task gives at most k of them.

Queries are handled in blocks of bounded bytes that are sent to all tasks; scores are made in each
task by matrix products and are never stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlake.llm.common import stored, to_tasks

BLOCK_BYTES = 16 << 20
ROWS_AT_ONCE = 2048
QUERIES_AT_ONCE = 512


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and has only finite components."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(math.inf)))
    return vectors.filter(x.isNotNull() & ~bad)


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The vector with each component x as floor(scale * x), in exact whole doubles."""
    return vectors.withColumn(vector, F.transform(
        vector, lambda v: F.floor(v.cast("double") * scale).cast("double")))


def _matrix(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows by length: (length, places, matrix)."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    start, length = ends[:-1] - ends[0], np.diff(ends)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        yield n, at, flat[start[at][:, None] + np.arange(n)].reshape(len(at), n)


def _products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products as int64: by floats where no sum can pass 2**53, else by whole numbers."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    if most < 2 ** 53:
        return (rows @ queries.T).astype(np.int64)
    if most >= 2 ** 63:
        raise ArithmeticError("scores do not fit a long")
    return rows.astype(np.int64) @ queries.astype(np.int64).T


class _Block:
    """Queries of one length with the window of scores that is looked into."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.low = self.high = self.need = None      # scores low..high hold the need-th best
        self.bins = 512

    def width(self) -> np.ndarray:
        return np.maximum(1, -(-(self.high - self.low + 1) // self.bins))


def _scored(batches: Iterator[pa.RecordBatch], block: _Block):
    """(query places, ids, scores) piece by piece; a query's own row is masked by the caller."""
    n = block.vectors.shape[1]
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for length, at, rows in _matrix(batch.column(1)):
            if length != n:
                continue
            for r in range(0, len(at), ROWS_AT_ONCE):
                for q in range(0, len(block.ids), QUERIES_AT_ONCE):
                    part = slice(q, q + QUERIES_AT_ONCE)
                    yield part, ids[at[r:r + ROWS_AT_ONCE]], _products(rows[r:r + ROWS_AT_ONCE], block.vectors[part])


def _histogram(vectors: DataFrame, block: _Block) -> DataFrame:
    """(query, bin, n): rows per bin of each query's window; bins above the window are bin -1."""
    shared = to_tasks(vectors.sparkSession, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = cloudpickle.loads(shared.value)
        width, size = block.width(), block.bins + 1
        counts = np.zeros((len(block.ids), size), np.int64)
        for part, ids, scores in _scored(batches, block):
            place = (block.high[part] - scores) // width[part] + 1
            place[scores > block.high[part]] = 0
            valid = (scores >= block.low[part]) & (ids[:, None] != block.ids[part])
            flat = (place + np.arange(scores.shape[1]) * size)[valid]
            counts[part] += np.bincount(flat, minlength=scores.shape[1] * size).reshape(-1, size)
        query, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(place - 1, pa.int64()), pa.array(counts[query, place])],
            ["query", "bin", "n"])

    return vectors.mapInArrow(run, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _refine(vectors: DataFrame, block: _Block, k: int) -> None:
    """Narrow each query's window to the k-th best score; a query with fewer rows keeps them all."""
    running = Window.partitionBy("query").orderBy("bin")
    while (block.high > block.low).any():
        places = _histogram(vectors, block).withColumn("so_far", F.sum("n").over(running))
        least = places.filter(F.col("so_far") >= k).groupBy("query").agg(F.min("bin").alias("bin")).collect()
        width, found = block.width(), np.zeros(len(block.ids), bool)
        for row in least:                            # at most one row per query of this block
            q, place = row["query"], row["bin"]
            found[q] = True
            high = block.high[q] - place * width[q]
            block.low[q], block.high[q] = max(block.low[q], high - width[q] + 1), high
        block.high = np.where(found, block.high, block.low)


def _best(vectors: DataFrame, block: _Block, k: int) -> DataFrame:
    """Rows above the k-th best score, and at it the k smallest ids that each task has."""
    shared = to_tasks(vectors.sparkSession, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = cloudpickle.loads(shared.value)
        kept, n = [(np.zeros(0, np.int64),) * 3], 0
        for part, ids, scores in _scored(batches, block):
            r, q = np.nonzero((scores >= block.low[part]) & (ids[:, None] != block.ids[part]))
            kept.append((q + part.start, ids[r], scores[r, q]))
            n += len(q)
            if n > 4 * k * len(block.ids):
                kept = [_first(*map(np.concatenate, zip(*kept)), k)]
                n = len(kept[0][0])
        queries, found, values = _first(*map(np.concatenate, zip(*kept)), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids[queries]), pa.array(found), pa.array(values)], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def _first(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    opens = np.flatnonzero(np.r_[True, queries[1:] != queries[:-1]]) if len(queries) else queries
    place = np.arange(len(queries)) - np.repeat(opens, np.diff(np.r_[opens, len(queries)]))
    return queries[place < k], ids[place < k], scores[place < k]


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[_Block]:
    """Queries of one length at a time, at most ``block_bytes`` of them."""
    lengths = queries.groupBy("length").count().orderBy("length").collect()
    for row in lengths:
        length, n = row["length"], row["count"]
        most = max(1, block_bytes // (8 * (length + 8)))
        parts = -(-n // most)
        for part in range(parts):
            mine = queries.filter(F.col("length") == length)
            if parts > 1:
                mine = mine.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
            got = mine.select("id", "vector").distinct().orderBy("id").toArrow()
            if len(got):
                column = got.column(1).combine_chunks()
                yield _Block(got.column(0).to_numpy(), column.flatten().to_numpy().reshape(len(got), length))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for each row of ``queries``.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with
    a null id; only vectors of a query's own length are scored, and no row with the query's own
    id. Ties go to smaller ids. A repeated row is a candidate as often as it comes, a repeated
    query is asked once. A score beyond a long is an error.
    """
    def ready(df: DataFrame) -> DataFrame:
        return quantised(usable(df.filter(F.col(vec_id).isNotNull()), vector), vector, scale).select(
            F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))

    rows = stored(ready(vectors), "vectors")
    asked = stored(ready(queries).withColumn("length", F.size("vector")), "queries")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    longest = {r["n"]: r["norm"] for r in rows.groupBy(F.size("vector").alias("n")).agg(F.max(norm).alias("norm")).collect()}
    out = None
    for block in _blocks(asked, block_bytes):
        n = block.vectors.shape[1]
        bound = np.sqrt((block.vectors ** 2).sum(axis=1) * longest.get(n, 0.0))
        if (bound >= 2 ** 62).any():
            raise ArithmeticError("scores do not fit a long")
        block.high = (bound * (1 + 1e-9)).astype(np.int64) + 2
        block.low = -block.high
        _refine(rows, block, k)
        best = _best(rows, block, k)
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
