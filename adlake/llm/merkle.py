"""Merkle manifest of a dataset: one tree per group, a tree of their roots, a witness per leaf.

Leaves are appended in order. An appended leaf opens a partial witness, and a run of ``arity`` nodes
stays open until its last sibling comes; its completion extends the witness of every leaf below
it and appends the run's node one level up. A subtree can be appended whole where the tree is
aligned to it, so blocks of ``arity ** height`` leaves are built by tasks of their own, and their
roots are the appends of the next tier, until each group has one root. A group of any size is
therefore cut into blocks of equal size. Digests are hexadecimal text, hashed as such.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlake.llm.common import stored

ARITY, HEIGHT = 16, 2
STEPS = "array<struct<place:int,siblings:array<string>>>"
ABOVE = f"steps {STEPS}, subroot string, root string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Witnesses:
    """A tree that grows by appends; members carry their witness, a list of (place, siblings) per finished run."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[str, list[list]]]] = [[]]

    def append(self, node: str, witness: list | None = None, level: int = 0) -> None:
        """Append a leaf, or at ``level`` the root of a whole subtree; no run below it may be open."""
        if any(self.open[:level]):
            raise ValueError("a subtree must be appended where the tree is aligned to it")
        self._push(level, node, [] if witness is None else [witness])

    def _push(self, level: int, node: str, members: list[list]) -> None:
        while len(self.open) <= level:
            self.open.append([])
        self.open[level].append((node, members))
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes, below = [node for node, _ in run], []
        for place, (_, members) in enumerate(run):
            if members:
                step = (place, nodes[:place] + nodes[place + 1:])
                for witness in members:
                    witness.append(step)
                below += members
        self._push(level + 1, digest(nodes), below)

    def root(self, height: int = 0) -> str:
        """Complete the open runs from below until one node is left, at ``height`` or above."""
        level = 0
        while True:
            run, above = self.open[level], any(self.open[level + 1:])
            if len(run) == 1 and not above and level >= height:
                return run[0][0]
            if run:
                self._complete(level)
            level += 1


def folded(leaf: str, witness: Iterable[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for place, siblings in witness:
        leaf = digest([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def proof_digest(witness: Iterable[tuple[int, list[str]]]) -> str:
    return digest(s for _, siblings in witness for s in siblings)


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: each column as byte count, colon and value, or ``-`` where it is null."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def ascii_lower(text: Column) -> Column:
    """Only A-Z are lower-cased."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, within ``group`` by ``order``, nulls first) and ``size`` of the group.

    Rows are dealt out by range, so a large group lies in many tasks; ``order`` should tell rows apart.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    cut = stored(rows.repartitionByRange(F.col(group), *by).select("*", F.spark_partition_id().alias("__part")), "cut")
    over = Window.partitionBy(group)
    parts = (cut.groupBy("__part", group).count()
             .withColumn("__before", F.sum("count").over(over.orderBy("__part")) - F.col("count"))
             .withColumn("size", F.sum("count").over(over)).drop("count"))
    within = Window.partitionBy("__part", group).orderBy(*by)
    return (cut.join(parts, ["__part", group])
            .withColumn("place", (F.col("__before") + F.row_number().over(within) - 1).cast("long"))
            .drop("__part", "__before"))


def _block(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {width}"))


def _height(size: int, arity: int, height: int) -> int:
    """Blocks of a group that has several are all of one height."""
    return height if size > arity ** height else 0


def block_roots(nodes: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """The next tier of ``nodes`` (group, place, digest, size): the root of each block as a node of its own."""
    width = arity ** height

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, size = Witnesses(arity), table["size"][0].as_py()
        for _, node in sorted(zip(table["place"].to_pylist(), table["digest"].to_pylist())):
            tree.append(node)
        return pa.table({"group": [key[0].as_py()], "place": pa.array([key[1].as_py()], pa.int64()),
                         "digest": [tree.root(_height(size, arity, height))],
                         "size": pa.array([-(-size // width)], pa.int64())})

    return (_block(nodes.select("group", "place", "digest", "size"), width).groupBy("group", "block")
            .applyInArrow(run, "group string, place long, digest string, size long"))


def tiers(nodes: DataFrame, arity: int = ARITY, height: int = HEIGHT, done: list[DataFrame] | None = None) -> list[DataFrame]:
    """``nodes``, their block roots, those of these, and so on until each group has one node."""
    out = [nodes, *(done or [])]
    most = out[-1].agg(F.max("size")).first()[0] or 0
    while most > 1:
        out.append(stored(block_roots(out[-1], arity, height), "block-roots"))
        most = -(-most // arity ** height)
    return out


def _extended(nodes: DataFrame, above: DataFrame, arity: int, height: int, made, schema: str) -> DataFrame:
    """``made(row, witness, subroot, root)`` of each node; ``above`` has the witness of each block root."""
    width = arity ** height

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["place"])
        top = right.to_pylist()[0] if rows else None
        rest = [(s["place"], s["siblings"]) for s in top["steps"]] if rows else []
        tree, partial = Witnesses(arity), [[] for _ in rows]
        for row, witness in zip(rows, partial):
            tree.append(row["digest"], witness)
        if rows:
            tree.root(_height(rows[0]["size"], arity, height))
        return pa.Table.from_pylist([made(r, w + rest, top["subroot"], top["root"]) for r, w in zip(rows, partial)],
                                    schema=kinds)

    kinds = _arrow(schema)
    return (_block(nodes, width).groupBy("group", "block").cogroup(above.groupBy("group", "place"))
            .applyInArrow(run, schema))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(schema))


def _down(levels: list[DataFrame], top: DataFrame, arity: int, height: int) -> DataFrame:
    """Witnesses of the nodes of ``levels[1]``, or of ``levels[0]`` if there is no other; ``top`` has those of the last."""
    def made(row, witness, subroot, root):
        return {"group": row["group"], "place": row["place"], "subroot": subroot, "root": root,
                "steps": [{"place": p, "siblings": s} for p, s in witness]}

    for nodes in reversed(levels[1:-1]):
        top = stored(_extended(nodes, top, arity, height, made, f"group string, place long, {ABOVE}"), "witnesses")
    return top


@dataclass
class Manifest:
    """``leaves`` (group, place, size, digest and own columns), the ``levels`` of block roots over them, and ``above``:
    the witness, subroot and root that each block of leaves is handed down."""

    leaves: DataFrame
    levels: list[DataFrame]
    above: DataFrame
    arity: int = ARITY
    height: int = HEIGHT

    def _each(self, made, schema: str) -> DataFrame:
        return _extended(self.leaves, self.above, self.arity, self.height, made, schema)

    def witnesses(self, own: str) -> DataFrame:
        """Each leaf's own columns (``own`` is their schema), digest, subroot, root and steps."""
        names = [f.strip().split()[0] for f in own.split(",")]

        def made(row, witness, subroot, root):
            return {**{n: row[n] for n in names}, "digest": row["digest"], "subroot": subroot, "root": root,
                    "steps": [{"place": p, "siblings": s} for p, s in witness]}

        return self._each(made, f"{own}, digest string, {ABOVE}")

    def checked(self, own: str, presented: str) -> DataFrame:
        """Each leaf's own columns, digest, subroot, root and proof_sha256, and what the digest ``presented`` folds to."""
        names = [f.strip().split()[0] for f in own.split(",")]

        def made(row, witness, subroot, root):
            back = folded(row[presented], witness)
            return {**{n: row[n] for n in names}, "leaf": row["digest"], "subroot": subroot, "root": root,
                    "proof_sha256": proof_digest(witness), "folded_root": back, "verified": back == root}

        return self._each(made, f"{own}, leaf string, subroot string, root string, proof_sha256 string, "
                                "folded_root string, verified boolean")


def _above(levels: list[DataFrame], arity: int, height: int) -> DataFrame:
    """Witnesses of the blocks of a forest, led up to the one root over all groups."""
    subroots = levels[-1].select(F.col("group").alias("name"), F.col("digest"))
    top = stored(placed(subroots.withColumn("group", F.lit("")), "group", ["name"]), "subroots")
    heads = tiers(top, arity, height)
    bare = heads[-1].select("group", "place", F.array().cast(STEPS).alias("steps"), F.lit(None).cast("string").alias("subroot"),
                            F.col("digest").alias("root"))
    whole = Manifest(top, heads, _down(heads, bare, arity, height), arity, height).witnesses("name string")
    above = stored(whole.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("place"), "steps",
                                F.col("digest").alias("subroot"), "root"), "heads")
    return _down(levels, above, arity, height)


def manifest(rows: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> Manifest:
    """Manifest of ``rows``: ``group`` (string, null is a group of its own, first), ``id`` (long), ``digest`` and more columns.

    Leaves of a group ascend by id (null first), then by digest; rows equal in both are leaves of
    their own, in any order. An empty table has a manifest without leaves.
    """
    named = stored(rows.withColumn("group", F.when(F.col("group").isNull(), "").otherwise(F.concat(F.lit("="), "group")))
                   .withColumn("__row", F.monotonically_increasing_id()), "leaves")
    leaves = stored(placed(named, "group", ["id", "digest", "__row"]).drop("__row"), "placed-leaves")
    levels = tiers(leaves, arity, height)
    return Manifest(leaves, levels, _above(levels, arity, height), arity, height)


def grown(old: Manifest, rows: DataFrame) -> Manifest:
    """``old`` with ``rows`` appended; each id must come after all ids of its group, as in a log.

    Only the open last block of a group is hashed again, with the new leaves; closed blocks keep
    their roots, and the witnesses inside them are extended by what lies above.
    """
    width = old.arity ** old.height
    last = old.leaves.groupBy("group").agg(F.max("id").alias("__last"), F.max("size").alias("__size"))
    named = stored(rows.withColumn("group", F.when(F.col("group").isNull(), "").otherwise(F.concat(F.lit("="), "group")))
                   .withColumn("__row", F.monotonically_increasing_id()), "more-leaves")
    fresh = stored(placed(named, "group", ["id", "digest", "__row"]).drop("__row")
                   .join(last, "group", "left")
                   .withColumn("place", F.col("place") + F.coalesce("__size", F.lit(0))), "more-placed")
    if not fresh.filter(F.col("__size").isNotNull() & ~F.coalesce(F.col("id") > F.col("__last"), F.lit(False))).isEmpty():
        raise ValueError("an appended id must be greater than all ids of its group")
    sizes = fresh.groupBy("group").agg((F.max("place") + 1).alias("__new"))
    leaves = stored(old.leaves.unionByName(fresh.drop("__last", "__size")).join(sizes, "group", "left")
                    .withColumn("size", F.coalesce("__new", "size")).drop("__new"), "grown-leaves")
    first = fresh.groupBy("group").agg(F.expr(f"min(place) div {width}").alias("__first"))
    touched = leaves.join(first, "group").filter(F.expr(f"place div {width}") >= F.col("__first")).drop("__first")
    again = block_roots(touched, old.arity, old.height)
    before = old.levels[1] if len(old.levels) > 1 else block_roots(old.leaves, old.arity, old.height)
    kept = (before.join(first, "group", "left").filter(F.coalesce(F.col("place") < F.col("__first"), F.lit(True)))
            .join(sizes, "group", "left")
            .withColumn("size", F.coalesce(F.expr(f"(__new + {width - 1}) div {width}"), "size"))
            .select(*again.columns))
    levels = tiers(leaves, old.arity, old.height, [stored(kept.unionByName(again), "grown-blocks")])
    return Manifest(leaves, levels, _above(levels, old.arity, old.height), old.arity, old.height)
