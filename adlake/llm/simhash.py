"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Two fingerprints within ``distance`` bits agree in at least one of ``distance + 1`` blocks of
bits. So each distinct fingerprint is filed under one root node per block, whose pattern is the
block's bits; a root that holds too many is factored again by the blocks of its other bits.
Under a root the fingerprints lie in Gray order, where neighbours share long bit patterns. Each
run of four is factored into an upper node that keeps only the bits all of its members share.
Pairs of nodes are walked from the top: a pair whose shared bits already differ too often is
dropped with all below it, one that cannot differ too often is linked whole.

Links leave a task as one edge per fingerprint to the first of its group, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import keyed, stored, with_decisions

BITS = 64
FANOUT = 4
#: Node pairs expanded at a time, and shingles hashed at a time; they bound a task's memory.
PAIRS_AT_ONCE = 1 << 18
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """The bits set in over half of the hashes of a text's word shingles, as a signed long."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, last, SHINGLES_AT_ONCE):
        part = words[start:min(start + SHINGLES_AT_ONCE, last) + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle))) if len(part) >= shingle else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(run), 42) for run in runs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long.

    Null texts and texts without words have fingerprint zero. Texts are hashed a bounded number
    of shingles at a time, whatever their length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary()).to_pylist()
            fps = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*keep, "fp"])

    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema
    return source.mapInArrow(run, schema)


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order, as a long that sorts in that (unsigned) order."""
    rank = fp
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def block_masks(free: int, parts: int) -> list[int]:
    """Split the set bits of ``free`` into ``parts`` masks of about equal size."""
    places = [i for i in range(BITS) if free >> i & 1]
    edges = [len(places) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in places[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _under(fp: Column, mask: Column) -> Column:
    return F.xxhash64(mask, fp.bitwiseAND(mask))


def filed(fps: DataFrame, distance: int, node_rows: int) -> DataFrame:
    """Each fingerprint under its root nodes (node, fp); roots above ``node_rows`` are factored again."""
    everything = (1 << BITS) - 1
    roots = block_masks(everything, distance + 1)
    below = {_signed(m): [_signed(x) for x in block_masks(everything & ~m, distance + 1)] for m in roots}
    masks = F.array(*[F.lit(m).cast("long") for m in below])
    top = (fps.select("fp", F.explode(masks).alias("mask"))
           .withColumn("node", _under(F.col("fp"), F.col("mask"))))
    sizes = top.groupBy("node").count().filter(F.col("count") > node_rows).select("node")
    hot = stored(sizes, "simhash-hot")
    n = hot.count()
    if not n:
        return top.select("node", "fp")
    mark = F.broadcast(hot) if n <= 100_000 else hot
    deeper = F.create_map(*[x for m, subs in below.items() for x in (
        F.lit(m).cast("long"), F.array(*[F.lit(s).cast("long") for s in subs]))])
    split = (top.join(mark, "node", "left_semi")
             .select("fp", "node", F.explode(deeper[F.col("mask")]).alias("sub"))
             .select(F.xxhash64("node", _under(F.col("fp"), F.col("sub"))).alias("node"), "fp"))
    return top.join(mark, "node", "left_anti").select("node", "fp").unionByName(split)


class Index:
    """Levels of nodes over fingerprints that are sorted by (root node, Gray rank)."""

    def __init__(self, roots: np.ndarray, fps: np.ndarray):
        self.ands, self.ors, self.first = [fps], [fps], []
        group = np.r_[True, roots[1:] != roots[:-1]] if len(roots) else np.zeros(0, bool)
        while len(group) and not group.all():
            starts_of_group = np.flatnonzero(group)
            place = np.arange(len(group)) - np.repeat(
                starts_of_group, np.diff(np.r_[starts_of_group, len(group)]))
            first = np.flatnonzero(place % FANOUT == 0)
            self.first.append(np.r_[first, len(group)])
            self.ands.append(np.bitwise_and.reduceat(self.ands[-1], first))
            self.ors.append(np.bitwise_or.reduceat(self.ors[-1], first))
            group = group[first]

    def bounds(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance between any member of a and any of b."""
        both = ~((self.ands[level][a] ^ self.ors[level][a]) | (self.ands[level][b] ^ self.ors[level][b]))
        least = np.bitwise_count((self.ands[level][a] ^ self.ands[level][b]) & both).astype(np.int16)
        return least, least + np.bitwise_count(~both)

    def members(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First fingerprint under each node, and the end of its run."""
        start, end = node, node + 1
        for down in range(level - 1, -1, -1):
            start, end = self.first[down][start], self.first[down][end]
        return start, end


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = parent[x]
    while True:
        up = parent[at]
        if np.array_equal(up, at):
            return at
        at = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        differ = a != b
        a, b = np.maximum(a, b)[differ], np.minimum(a, b)[differ]
        np.minimum.at(parent, a, b)


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the runs, and the first place of its run."""
    n = end - start
    head = np.repeat(start, n)
    return head + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), head


def grouped(roots: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the place of the first one it is linked to, directly or not."""
    index, parent = Index(roots, fps), np.arange(len(fps))
    top = len(index.first)
    nodes = np.arange(len(index.ands[top]))
    todo = [(top, nodes, nodes)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > PAIRS_AT_ONCE:
            todo.append((level, a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]))
            a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE]
        least, most = index.bounds(level, a, b)
        whole = most <= distance
        if whole.any():
            (start, end), (other, stop) = index.members(level, a[whole]), index.members(level, b[whole])
            _union(parent, *_runs(start, end))
            _union(parent, *_runs(other, stop))
            _union(parent, start, other)
        open_ = (least <= distance) & ~whole
        if level == 0 or not open_.any():
            continue
        a, b, below = a[open_], b[open_], index.first[level - 1]
        i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
        left, right = below[a][:, None] + i, below[b][:, None] + j
        fits = (left < below[a + 1][:, None]) & (right < below[b + 1][:, None]) & (left <= right)
        todo.append((level - 1, left[fits], right[fits]))
    return _roots(parent, np.arange(len(fps)))


def links(fps: DataFrame, distance: int = 3, node_rows: int = 50_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that keep every group within ``distance`` together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        roots, keys = (np.concatenate(x) for x in zip(*got))
        first = grouped(roots, keys.view(np.uint64), distance)
        tied = np.flatnonzero(first != np.arange(len(first)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[tied]), pa.array(keys[first[tied]])], ["a", "b"])

    return (filed(fps, distance, node_rows).repartition("node")
            .sortWithinPartitions("node", gray_rank(F.col("fp")))
            .mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``: root is the least node that can be reached.

    Each round hooks every node to its least neighbour, follows the hooks to their ends and
    joins the edges to those ends; rounds go on until no edge is left between two ends.
    """
    spark = edges.sparkSession
    labels, rest = None, stored(edges.filter("a <> b"), "edges")
    while not rest.isEmpty():
        both = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy(F.col("a").alias("node")).agg(
            F.least("node", F.min("b")).alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("__up"))
            hooks = stored(hooks.join(up, "root").select(
                "node", F.col("__up").alias("root"), (F.col("__up") != F.col("root")).alias("moved")), "hooks")
            moved = not hooks.filter("moved").isEmpty()
            hooks = hooks.drop("moved")
            if not moved:
                break
        of_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("__a"))
        of_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("__b"))
        rest = stored(rest.join(of_a, "a").join(of_b, "b").filter("__a <> __b")
                      .select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct(), "edges")
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("__up"))
            labels = stored(labels.join(up, "root", "left").select(
                "node", F.coalesce("__up", "root").alias("root")), "labels")
    return spark.createDataFrame([], "node long, root long") if labels is None else labels


def near_duplicates(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3,
                    distance: int = 3, node_rows: int = 50_000) -> DataFrame:
    """``keep`` (its first column is the id), ``fp``, ``root`` and ``component``.

    ``root`` tells the groups apart; ``component`` is the least id that can be reached.

    Every row takes part: null and blank texts have fingerprint zero and are linked like any
    other, repeated rows come back as often as they came. Rows with a null id belong to a
    component but never name it: a component without any id has a null name.
    """
    marked = stored(fingerprints(docs, keep, text, shingle), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(keep[0]).alias("__least"))
    distinct = stored(least, "distinct-fingerprints")
    reach = components(links(distinct.select("fp"), distance, node_rows))
    rooted = distinct.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "__least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("__least").alias("component"))
    return marked.join(rooted.join(named, "root").select("fp", "root", "component"), "fp", "left").select(
        *keep, "fp", "root", "component")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each group of near duplicates: the least ``doc_id`` (null last), then the least digest."""
    ids = keyed(docs).select("doc_id", "__k1", "__k2", "text")
    groups = near_duplicates(ids, ["doc_id", "__k1", "__k2"], shingle=shingle, distance=distance)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "__k1", "__k2")
    kept = groups.groupBy("root").agg(F.min(first).alias("kept")).select("kept.__k1", "kept.__k2")
    return with_decisions(docs, kept).select(docs.columns)
