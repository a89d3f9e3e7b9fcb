"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target gives its documents one expected number of copies; the whole part is
certain, the rest is a probability. Pairs of documents are visited: mass (probability times
size) moves at random from one to the other, fairly, until one of them is settled at none or
one copy; the other goes on to the next pair. So a source's words never change by more than the
one document that is left at the very end. Rows meet in buckets of bounded size by hash; what is left
of each bucket, one row a source, meets in the next round: a tree over buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import keyed, ranked, stored, with_decisions, word_count

BUCKET_ROWS = 50_000
FAN_IN = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` of all
    sizes. A target stops at ``cap`` times its source's size; the excess goes to the others by
    weight until no target is above. Each round of that takes sums over the table of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.array(*[F.lit(float(w)) for w in weights])[F.pmod("place", F.lit(len(weights))).cast("int")]
    table = stored(ranked(totals, [F.col("source").asc_nulls_last()]).select(
        "source", "source_size", turn.alias("weight"), (F.col("source_size") * cap).alias("limit")), "sources")
    whole = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    while level != before:
        before, full = level, F.col("limit") < F.col("weight") * level
        spent, open_ = table.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)),
                                 F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_:
            break
        level = max(level, (whole - spent) / open_)
    return table.select("source", "source_size", F.least("limit", F.col("weight") * level).alias("target"))


def settle(mass: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``mass`` between pairs until at most one entry is neither 0 nor its ``size``.

    Large entries are visited first, so the one that is left open tends to be small.
    """
    live = np.flatnonzero((mass > 0) & (mass < size))
    live = live[np.argsort(-size[live], kind="stable")].tolist()
    masses, sizes, draws = mass.tolist(), size.tolist(), rng.random(len(live)).tolist()
    if not live:
        return mass
    i, m = live[0], masses[live[0]]
    for j, draw in zip(live[1:], draws):
        if i is None:
            i, m = j, masses[j]
            continue
        n, room, rest = masses[j], sizes[i] - m, sizes[j] - masses[j]
        up, down = min(room, n), min(m, rest)
        if draw * (up + down) < down:                       # j gives to i
            if room <= n:
                masses[i], i, m = sizes[i], j, n - room
            else:
                masses[j], m = 0.0, m + n
        elif m <= rest:                                     # i gives to j, all it has
            masses[i], i, m = 0.0, j, n + m
        else:
            masses[j], m = sizes[j], m - rest
        if i is not None and not 0 < m < sizes[i]:
            masses[i], i = (0.0 if m <= 0 else sizes[i]), None
    if i is not None:
        masses[i] = m
    return np.array(masses)


def _round(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """One round of the tree: every (source, bucket) keeps at most one open row."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table["__tie"].to_numpy(), table["__order"].to_numpy()))
        table = table.take(pa.array(order))
        size = table["size"].to_numpy().astype(float)
        rng = np.random.default_rng([seed, level, *np.frombuffer(table["__order"].to_numpy()[:1].tobytes(), "<u4")])
        mass = settle(table["chance"].to_numpy() * size, size, rng)
        chance = np.where(mass >= size, 1.0, mass / size)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chance))

    return rows.groupBy("source", "bucket").applyInArrow(run, rows.schema)


def copies(rows: DataFrame, keep: list[str], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
           cap: float = 2.0, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keep, source, size, source_size, target, n, copies): copies of all ``n`` equal rows together.

    ``rows`` has the columns ``keep`` (hashable), ``source`` and ``size``. Rows equal in all of
    them are settled among themselves first and then count as one, so a row that comes a great
    many times is one entry. Rows of size 0 carry no mass: each is taken once. The draws depend on the
    rows' values and ``seed`` alone, not on partitions or order.
    """
    sized = stored(rows.select(*keep, "source", "size"), "sizes")
    table = stored(source_targets(sized, weights, share, cap), "targets")
    folded = sized.groupBy(*keep, "source", "size").agg(F.count("*").alias("n"))
    folded = stored(folded, "folded")
    counts = folded.groupBy("source").agg(F.ceil(F.count("*") / bucket_rows).alias("buckets"))
    about = table.join(counts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    about = stored(about.select(F.col("source").alias("__of"), "source_size", "target", "buckets"), "sources")
    each = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    whole = F.floor("each")
    extra = F.col("n") * (F.col("each") - whole)                       # expected copies beyond the whole part
    near = F.when(F.abs(extra - F.round(extra)) < 1e-9, F.round(extra)).otherwise(extra)
    parts = [x for c in [*keep, "source", "size"] for x in (F.col(c), F.col(c).isNull())]
    units = (folded.join(about, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
             .withColumn("each", each)
             .withColumn("sure", (F.col("n") * whole + F.floor(near)).cast("long"))
             .withColumn("chance", (near - F.floor(near)).cast("double"))
             .drop("each")
             .withColumn("__order", F.xxhash64(F.lit(seed), *parts)).withColumn("__tie", F.xxhash64(*parts))
             .withColumn("bucket", F.pmod("__order", "buckets").cast("long")).drop("buckets"))
    open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
    level = 0
    units = stored(units, "units")
    done = [units.filter(~open_)]
    left = units.filter(open_)
    while True:
        last = left.agg(F.max("bucket")).first()[0]
        if last is None:
            break
        turn = stored(_round(left, seed, level), "settled")
        if last == 0:                                                  # one bucket a source: the end of the tree
            near = (F.col("chance") >= 0.5).cast("double")                # one row a source; the nearer end
            done.append(turn.withColumn("chance", F.when(open_, near).otherwise(F.col("chance"))))
            break
        done.append(turn.filter(~open_))
        left = turn.filter(open_).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*keep, "source", "size", "source_size", "target", "n",
                      (F.col("sure") + F.col("chance").cast("long")).alias("copies"))


def per_row(mix: DataFrame) -> DataFrame:
    """One row for each of the equal rows that ``copies`` folded, with its own number of copies."""
    each = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("__i") < F.pmod("copies", "n"), 1).otherwise(0)
    return (mix.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            .withColumn("copies", each.cast("long")).drop("__i", "n"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; sizes are words.

    Null texts have no words, a null source is a source of its own. The text is shuffled once.
    """
    sizes = keyed(docs).select("__k1", "__k2", F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    taken = copies(sizes, ["__k1", "__k2"], **how).filter("copies > 0").select(
        "__k1", "__k2", F.col("copies").alias("__copies"))
    rows = with_decisions(docs, taken)
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)


def summary(mix: DataFrame) -> DataFrame:
    """Words taken of each source against its target."""
    return mix.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum(F.col("copies") * F.col("size")).alias("taken"))
