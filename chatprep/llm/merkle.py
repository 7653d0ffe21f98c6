"""Merkle manifest of a table: one root, and a witness for every row.

Rows are leaves. Per group they ascend by id, and every two consecutive nodes become one
of the next level; what remains is the group's subroot. Subroots, in the order of their
groups, likewise give the root. A witness holds the siblings on the way up, so anyone
with it, the root and the place of a row can check that row alone.

Leaves are appended in order, a block of ``BLOCK`` places at a time and each block by
itself: a leaf opens a subtree, two subtrees of one height become one, and at that moment
every member of each gets the root of the other as the next part of its witness. Roots of
blocks are appended in the same way in the next round, as many rounds as it takes until
each group is one block (groups of 10^12 rows take four). Then witnesses are extended from
the top down: what a block still lacks is the witness of its root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.operators import ordering
from chatprep.sources.stages import scratch

#: Levels of a block, and the places it has.
LEVELS = 10
BLOCK = 1 << LEVELS


def node_hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and its text, ``-`` for null."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Frontier:
    """The open subtrees of one block, from left to right, each lower than the one before."""

    def __init__(self):
        self.open: list[tuple[int, str, list[list[str]]]] = []

    def append(self, digest: str, witness: list[str]) -> None:
        self._join((0, digest, [witness]))

    def _join(self, tree: tuple[int, str, list[list[str]]]) -> None:
        height, root, members = tree
        while self.open and self.open[-1][0] == height:
            _, left, earlier = self.open.pop()
            for w in earlier:
                w.append(root)
            for w in members:
                w.append(left)
            height, root, members = height + 1, node_hash(left, root), earlier + members
        self.open.append((height, root, members))

    def close(self, height: int = 0) -> str:
        """The root once no leaf follows: a node without a sibling is hashed alone, until
        one node of at least ``height`` is left."""
        while len(self.open) > 1 or self.open[-1][0] < height:
            low, root, members = self.open.pop()
            self._join((low + 1, node_hash(root), members))
        return self.open.pop()[1]


def fold(digest: str, siblings: Iterator[str], place: int, size: int) -> str:
    """The root over a node at ``place`` of ``size``; takes what siblings it needs."""
    while size > 1:
        if place % 2:
            digest = node_hash(next(siblings), digest)
        elif place + 1 < size:
            digest = node_hash(digest, next(siblings))
        else:
            digest = node_hash(digest)
        place, size = place // 2, (size + 1) // 2
    return digest


def _append(nodes: DataFrame) -> DataFrame:
    """``nodes`` ``(grp, at, size, digest, ..)`` with what their own block tells them: their
    ``witness`` inside it, and, on the last node of a block, its ``block_root``.

    Nodes of a block lie together in one task and in order; a task holds one block and
    one batch at a time.
    """
    names = nodes.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frontier = Frontier()
        waiting: list[tuple[pa.RecordBatch, list, list]] = []
        for batch in batches:
            witnesses: list[list[str]] = []
            roots: list[str | None] = []
            waiting.append((batch, witnesses, roots))
            values = (batch.column(c).to_pylist() for c in ("digest", "at", "size"))
            for digest, at, size in zip(*values):
                witnesses.append([])
                frontier.append(digest, witnesses[-1])
                last = (at + 1) % BLOCK == 0 or at + 1 == size
                roots.append(frontier.close(LEVELS if size > BLOCK else 0) if last else None)
            # A batch can go once no block with one of its nodes is open.
            done = len(waiting) if not frontier.open else len(waiting) - 1 if any(roots) else 0
            for held, of_rows, of_blocks in waiting[:done]:
                made = [[bytes.fromhex(d) for d in w] for w in of_rows]
                yield pa.RecordBatch.from_arrays(
                    [*held.columns, pa.array(made, pa.list_(pa.binary())), pa.array(of_blocks, pa.string())],
                    names=[*names, "witness", "block_root"],
                )
            del waiting[:done]
        assert not waiting, "a block without its last node"

    placed = nodes.repartition("grp", F.expr(f"at div {BLOCK}")).sortWithinPartitions("grp", "at")
    return placed.mapInArrow(run, f"{kinds}, witness array<binary>, block_root string")


def _grown(nodes: DataFrame, largest: int, label: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with their whole ``witness`` up to the root of their ``grp``, and ``(grp,
    root)``; ``largest`` is the size of the largest group."""
    levels, roots = [], None
    while True:
        made = scratch(_append(nodes), label)
        levels.append(made.drop("block_root"))
        closed = made.filter("block_root IS NOT NULL")
        whole = closed.filter(F.col("size") <= BLOCK).select("grp", F.col("block_root").alias("root"))
        roots = whole if roots is None else roots.unionByName(whole)
        if largest <= BLOCK:
            break
        largest = -(-largest // BLOCK)
        nodes = closed.filter(F.col("size") > BLOCK).select(
            "grp", F.expr(f"at div {BLOCK}").alias("at"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"),
            F.col("block_root").alias("digest"),
        )
    rows = levels.pop()
    while levels:
        above = rows.select("grp", F.col("at").alias("block"), F.col("witness").alias("above"))
        below = levels.pop().withColumn("block", F.expr(f"at div {BLOCK}"))
        none = F.array().cast("array<binary>")
        rows = below.join(above, ["grp", "block"], "left").withColumn(
            "witness", F.concat("witness", F.coalesce("above", none))
        ).drop("block", "above")
    return rows, roots


def manifest(docs: DataFrame, columns: Sequence[str], id_column: str = "doc_id", group_column: str = "lang",
             carried: dict[str, Column] | None = None) -> DataFrame:
    """``(id, grp, leaf, at, size, group_at, n_groups, subroot, root, witness)`` of every row,
    and the ``carried`` values, which are expressions over ``docs``.

    ``leaf`` digests ``columns``; the row is number ``at`` of the ``size`` rows of its
    group, the group number ``group_at`` of ``n_groups``. ``witness`` lists the siblings up
    to ``root`` as binary digests. Null groups and ids are values of their own and come
    first. Rows with one id follow each other by their leaf; equal rows are leaves of
    their own. Very long texts are digested whole, where they lie. An empty table gives
    an empty manifest. Other columns of ``docs`` are not looked at.
    """
    carried = carried or {}
    # A leading mark keeps null apart and first, and the order of the others.
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_column}`").cast("string")), F.lit("-"))
    rows = scratch(
        docs.select(
            group.alias("name"), F.col(f"`{id_column}`").alias("id"), leaf([F.col(f"`{c}`") for c in columns]).alias("digest"),
            *[c.alias(f"carried_{n}") for n, c in carried.items()], F.monotonically_increasing_id().alias("tie"),
        ),
        "merkle-leaves",
    )
    order = [F.col("name").asc(), F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("tie").asc()]
    rows = ordering.numbered(rows, order, "place", "merkle-sorted").drop("tie")
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first"))
    groups = scratch(ordering.numbered(sizes, [F.col("name").asc()], "grp", "merkle-group-order"), "merkle-groups")
    n_groups, largest = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    nodes = rows.join(groups, "name").withColumn("at", F.col("place") - F.col("first")).drop("place", "first")
    rows, subroots = _grown(nodes, largest, "merkle-rows")
    tops, root = _grown(
        subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("at"), F.lit(n_groups).cast("bigint").alias("size"), F.col("root").alias("digest")),
        n_groups, "merkle-subroots",
    )
    root = root.first()
    tops = tops.select(F.col("at").alias("grp"), F.col("digest").alias("subroot"), F.col("witness").alias("above"))
    return rows.join(tops, "grp").select(
        "id", F.when(F.col("name") != "-", F.expr("substr(name, 2)")).alias("grp"), F.col("digest").alias("leaf"), "at", "size",
        F.col("grp").alias("group_at"), F.lit(n_groups).cast("bigint").alias("n_groups"), "subroot",
        F.lit(root.root if root else None).cast("string").alias("root"), F.concat("witness", "above").alias("witness"),
        *[F.col(f"carried_{n}").alias(n) for n in carried],
    )


def folded(rows: DataFrame, leaf_column: str = "leaf", name: str = "folded_root") -> DataFrame:
    """Rows of a manifest with the root that ``leaf_column`` leads to under their witness;
    a witness too short for its place leads to null."""
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            columns = (leaf_column, "at", "size", "group_at", "n_groups", "witness")
            for digest, at, size, group_at, n_groups, witness in zip(*(batch.column(names.index(c)).to_pylist() for c in columns)):
                siblings = (w.hex() for w in witness)
                try:
                    made.append(fold(fold(digest, siblings, at, size), siblings, group_at, n_groups))
                except StopIteration:
                    made.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*names, name])

    return rows.mapInArrow(run, f"{kinds}, `{name}` string")
