"""Merkle manifests: one tree per group of rows, kept in blocks of Van Emde Boas layout.

Nodes have up to ``ARITY`` children: while several nodes remain, each ``ARITY`` consecutive ones become the digest of their
digests (the last run may be shorter). A tree is cut in aligned subtrees of ``HEIGHT`` levels above their leaves, the
blocks. The nodes of a block lie in one array in Van Emde Boas order: a tree of levels is split at half height, the top
part is stored first and then the bottom subtrees one after the other, each laid out by the same rule. So a path stays
within few consecutive stretches whatever the size of a cache line or page, and the place of a node follows from level and
index by arithmetic. Building a block writes through that arithmetic, and proofs read siblings through it. The roots of
the blocks of one layer are the leaves of the blocks of the next, until each tree has one block. The roots of the trees
are the leaves of a last tree.

Leaves are ranked by a range partitioned sort, and a task holds one block at a time, so neither a group with most of the
rows nor the number of groups matters. Proofs are completed from the top layer down; a block passes its own path on.

Defined results: rows with a null group are one group, before all others; within a group a null id comes first, and equal
ids are ordered by their leaf digest; a null or empty text is a leaf like any other; an empty table has no root and gives
no rows. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.labelled import stored

ARITY = 8
#: Levels of a block above its leaves.
HEIGHT = 4
BLOCK = ARITY**HEIGHT
_DIGEST, _HEX = 32, 64


def nodes_in(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places, in a tree of ``levels`` levels, of the nodes with these indexes ``depth`` levels below the root."""
    if levels == 1:
        return np.zeros(len(index), np.int64)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    span = ARITY ** (depth - top)
    inside = address(levels - top, depth - top, index % span)
    return nodes_in(top) + index // span * nodes_in(levels - top) + inside


def _hex(digests: np.ndarray) -> bytes:
    return digests.tobytes().hex().encode()


def _widths(leaves: int, height: int) -> list[int]:
    """Nodes on each level, from the root down."""
    out = [leaves]
    for _ in range(height):
        out.append(-(-out[-1] // ARITY))
    return out[::-1]


def lay_out(leaves: list[str], height: int) -> np.ndarray:
    """The nodes of a block, one row each, from the hexadecimal digests of its leaves."""
    levels = height + 1
    nodes = np.zeros((nodes_in(levels), _DIGEST), np.uint8)
    widths = _widths(len(leaves), height)
    below = np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, _DIGEST)
    nodes[address(levels, height, np.arange(len(leaves)))] = below
    run = ARITY * _HEX
    for depth in range(height - 1, -1, -1):
        children = _hex(nodes[address(levels, depth + 1, np.arange(widths[depth + 1]))])
        made = b"".join(hashlib.sha256(children[at : at + run]).digest() for at in range(0, len(children), run))
        nodes[address(levels, depth, np.arange(widths[depth]))] = np.frombuffer(made, np.uint8).reshape(-1, _DIGEST)
    return nodes


def paths(nodes: np.ndarray, leaves: int, height: int, slots: np.ndarray) -> tuple[list[list[str]], list[list[str]]]:
    """Of each slot, the joined digests of the siblings to its left and to its right, from the leaves up."""
    widths = _widths(leaves, height)
    left: list[list[str]] = [[] for _ in slots]
    right: list[list[str]] = [[] for _ in slots]
    index = slots
    for depth in range(height, 0, -1):
        level = _hex(nodes[address(height + 1, depth, np.arange(widths[depth]))]).decode()
        first = index // ARITY * ARITY
        last = np.minimum(first + ARITY, widths[depth])
        for k, (a, i, b) in enumerate(zip((first * _HEX).tolist(), (index * _HEX).tolist(), (last * _HEX).tolist(), strict=True)):
            left[k].append(level[a:i])
            right[k].append(level[i + _HEX : b])
        index = index // ARITY
    return left, right


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` within ``tree``, from 0, and ``n``, the rows of the tree; ``order`` must tell unequal rows apart.

    Rows are dealt out by ranges of (tree, order), and numbered from the counts of the ranges before.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held"))
    # One row per tree and range: a tree has at most as many as there are partitions.
    tree = Window.partitionBy("tree")
    before = F.sum("_held").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(
        "tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_held").over(tree).alias("n")
    )
    return placed.join(starts, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _height(n: Column) -> Column:
    """Levels above the leaves of a block, in a tree of ``n`` nodes."""
    out = F.lit(HEIGHT)
    for height in reversed(range(HEIGHT)):
        out = F.when(n <= ARITY**height, height).otherwise(out)
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """Blocks of (tree, place, n, digest): tree, block, n (blocks of the tree), leaves, height, nodes and root."""

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["slot"].combine_chunks()))
        leaves = table["digest"].combine_chunks().take(pa.array(order)).to_pylist()
        height = table["height"][0].as_py()
        nodes = lay_out(leaves, height)
        return pa.table(
            {
                "tree": table["tree"].slice(0, 1),
                "block": table["block"].slice(0, 1),
                "n": table["blocks"].slice(0, 1),
                "leaves": pa.array([len(leaves)], pa.int32()),
                "height": pa.array([height], pa.int32()),
                "nodes": pa.array([nodes.tobytes()], pa.binary()),
                "root": pa.array([nodes[0].tobytes().hex()]),
            }
        )

    slots = _slots(members).withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")).drop("n", "place")
    schema = "tree string, block long, n long, leaves int, height int, nodes binary, root string"
    return slots.select("tree", "block", "slot", "height", "blocks", "digest").groupBy("tree", "block").applyInArrow(build, schema)


def _slots(members: DataFrame) -> DataFrame:
    return members.select(
        "*",
        F.expr(f"place div {BLOCK}").alias("block"),
        F.pmod("place", F.lit(BLOCK)).cast("int").alias("slot"),
        _height(F.col("n")).alias("height"),
    )


def _layers(members: DataFrame) -> list[DataFrame]:
    """Stored blocks of ``members``, of their roots, and so on, until every tree has one block."""
    out: list[DataFrame] = []
    while True:
        out.append(stored(_blocks(members), f"merkle-{len(out)}"))
        if out[-1].filter("n > 1").isEmpty():
            return out
        members = out[-1].filter("n > 1").select("tree", F.col("block").alias("place"), "n", F.col("root").alias("digest"))


def _with_paths(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``members`` (tree, block, slot, kept) as kept, left, right and given: the paths through their block and above it.

    ``blocks`` has the path of every block in its own ``left`` and ``right``, and ``given`` is handed on. A task meets one
    block and its members.
    """

    def retrieve(mine: pa.Table, block: pa.Table) -> pa.Table:
        left: list[list[str]] = []
        right: list[list[str]] = []
        given = [None] * mine.num_rows
        if mine.num_rows:
            height, leaves = block["height"][0].as_py(), block["leaves"][0].as_py()
            nodes = np.frombuffer(block["nodes"][0].as_py(), np.uint8).reshape(-1, _DIGEST)
            left, right = paths(nodes, leaves, height, np.asarray(mine["slot"].combine_chunks()).astype(np.int64))
            above = [block[c][0].as_py() for c in ("left", "right", "given")]
            left, right = [x + above[0] for x in left], [x + above[1] for x in right]
            given = [above[2]] * mine.num_rows
        kind = pa.list_(pa.string())
        return pa.table(
            {
                "kept": mine["kept"].combine_chunks(),
                "left": pa.array(left, kind),
                "right": pa.array(right, kind),
                "given": pa.array(given, pa.list_(pa.string())),
            }
        )

    kind = members.schema["kept"].dataType.simpleString()
    key = ("tree", "block")
    return (
        members.select(*key, "slot", "kept").groupBy(*key).cogroup(blocks.groupBy(*key))
        .applyInArrow(retrieve, f"kept {kind}, left array<string>, right array<string>, given array<string>")
    )


def _with_above(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the first layer with left, right and given; ``above`` (tree, left, right, given) has those of the trees."""
    columns = ["tree", "block", "leaves", "height", "nodes", "left", "right", "given"]
    whole = layers[-1].join(above, "tree").select(columns)
    for layer in reversed(layers[:-1]):
        inner = layer.filter("n > 1")
        kept = F.struct("tree", "block").alias("kept")
        members = _slots(inner.select("tree", F.col("block").alias("place"), "n", kept))
        found = _with_paths(members, whole).select("kept.tree", "kept.block", "left", "right", "given")
        whole = (
            inner.join(found, ["tree", "block"]).select(columns)
            .unionByName(layer.filter("n = 1").join(above, "tree").select(columns))
        )
    return whole


@dataclass(frozen=True)
class Manifest:
    """Stored layers of blocks, from the rows up, of the trees of the groups, and of the tree over these groups."""

    layers: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """One row with the root over all groups; none for an empty table."""
        return self.top[-1].select("root")

    def proofs(self, leaves: DataFrame) -> DataFrame:
        """(kept, left, right, subroot, root) of (tree, place, n, kept) rows.

        ``left`` and ``right`` have an entry per level, from the leaf to the root: the joined digests of the siblings
        before and after the node.
        """
        none = F.array().cast("array<string>")
        start = self.top[-1].select("tree", none.alias("left"), none.alias("right"), F.array("root").alias("given"))
        top = _with_above(self.top, start)
        kept = F.struct("name", "digest").alias("kept")
        found = _with_paths(_slots(self.groups.select("tree", "place", "n", kept)), top)
        given = F.array(F.col("kept.digest"), F.col("given")[0])
        above = found.select(F.col("kept.name").alias("tree"), "left", "right", given.alias("given"))
        blocks = _with_above(self.layers, stored(above, "merkle-paths"))
        return _with_paths(_slots(leaves), blocks).select(
            "kept", "left", "right", F.col("given")[0].alias("subroot"), F.col("given")[1].alias("root")
        )


def build(leaves: DataFrame) -> Manifest:
    """The manifest of (tree, place, n, digest) rows, as ``ranked`` gives them."""
    layers = _layers(leaves.select("tree", "place", "n", "digest"))
    trees = layers[0].filter("n = 1")
    for layer in layers[1:]:
        trees = trees.unionByName(layer.filter("n = 1"))
    groups = trees.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    groups = stored(ranked(groups, ["name"]), "merkle-groups")
    return Manifest(layers, groups, _layers(groups.select("tree", "place", "n", "digest")))


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its length in bytes, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def tree_of(group: str) -> Column:
    """A name of the group that is never null; null comes before all others, which keep their order of bytes."""
    return F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))


def proof_digest(left: str = "left", right: str = "right") -> Column:
    """Digest of all siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def folded(start: Column, left: str = "left", right: str = "right") -> Column:
    """The root that a leaf digest leads to along a path."""
    levels = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(levels, start, lambda node, x: F.sha2(F.concat(x["a"], node, x["b"]), 256))
