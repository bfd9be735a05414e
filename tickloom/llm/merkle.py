"""A Merkle manifest of a dataset: one hash for all rows, and a short proof for each row.

Rows are leaves. Within a group they are ordered, and while several nodes remain every three consecutive ones become the
hash of their hex digests; a last run may have fewer. What remains is the subroot of the group, and the subroots, in the
order of the groups, give the root in the same way.

A tree is stored in blocks, aligned subtrees of ``HEIGHT`` levels above at most 3**HEIGHT nodes (a parameter). A block holds its nodes in
van Emde Boas order: split at half height, the upper part first, then the lower subtrees from left to right, each in that
order again. ``addresses`` finds any node by arithmetic alone, whatever the size of a cache line or page; building a block
and reading siblings from it both use it. The roots of the blocks are the leaves of the next round, until one block is left
in every group, so 3**HEIGHT times fewer nodes go into each round.

Places of rows come from a sort by range and counts per (group, partition), so a group of any size is spread over all tasks,
and a task holds one block at a time. Rounds, places and blocks are stored in the shared folder. One number comes to the
driver: the size of the largest group.

Odd rows: a null group is a group of its own and the first, null order values come first, equal rows have equal leaves and
any of their places, each with its own proof. A group of one row has that row's leaf as its subroot. No rows give no rows.
Only the columns named are read, so further ones may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import ship, stored
from tickloom.operators.tables import small_side

ship(__name__)

ARITY = 3
HEIGHT = 6
DIGEST = 32


# --- hashes and addresses -----------------------------------------------------------------------


def leaf(columns: Sequence[str | Column]) -> Column:
    """The hash of a row as 32 bytes: of every value its length in bytes, a colon and the value, or ``-`` for a null."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(digests: bytes) -> bytes:
    """The hash over the digests of a run, as hex text one after the other."""
    return sha256(digests.hex().encode()).digest()


def nodes_in(levels: int) -> int:
    """Nodes of a full tree."""
    return (ARITY**levels - 1) // (ARITY - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth (the root has 0) lie in a tree of so many levels in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return addresses(upper, depth, index)
    lower, below = levels - upper, depth - upper
    tree, within = np.divmod(index, ARITY**below)
    return nodes_in(upper) + tree * nodes_in(lower) + addresses(lower, below, within)


PLACES: dict[tuple[int, int], list[int]] = {}


def places(levels: int, depth: int) -> list[int]:
    """The addresses of all nodes of a depth, as byte offsets."""
    if (levels, depth) not in PLACES:
        PLACES[levels, depth] = (addresses(levels, depth, np.arange(ARITY**depth, dtype=np.int64)) * DIGEST).tolist()
    return PLACES[levels, depth]


def height_over(width: int) -> int:
    """Levels above ``width`` nodes until one remains."""
    height = 0
    while width > 1:
        width, height = -(-width // ARITY), height + 1
    return height


def block_of(leaves: Sequence[bytes], height: int) -> tuple[bytes, bytes]:
    """(nodes, root) of a block over at most 3**height leaves. Slots after the last node in use are left out."""
    held, end = bytearray(nodes_in(height + 1) * DIGEST), 0
    row = list(leaves)
    for depth in range(height, -1, -1):
        at = places(height + 1, depth)
        for digest, place in zip(row, at):
            held[place:place + DIGEST] = digest
        end = max(end, max(at[: len(row)]) + DIGEST)
        if depth:
            row = [parent(b"".join(row[i:i + ARITY])) for i in range(0, len(row), ARITY)]
    return bytes(held[:end]), row[0]


def proofs_in(nodes: bytes, height: int, width: int) -> tuple[list[bytes], list[bytes]]:
    """For each of ``width`` leaves of a block its siblings up to the block's root, level by level and left to right, and
    the shape: one byte per level, 4 times the node's place in its run plus the number of siblings."""
    widths = [width]
    for _ in range(height):
        widths.append(-(-widths[-1] // ARITY))
    siblings, shapes = [b""], [b""]
    for depth in range(1, height + 1):
        at, count = places(height + 1, depth), widths[height - depth]
        below_siblings, below_shapes = [], []
        for first in range(0, count, ARITY):
            run = [nodes[p:p + DIGEST] for p in at[first:min(first + ARITY, count)]]
            up, shape = siblings[first // ARITY], shapes[first // ARITY]
            for i in range(len(run)):
                below_siblings.append(b"".join(run[:i] + run[i + 1:]) + up)
                below_shapes.append(bytes((4 * i + len(run) - 1,)) + shape)
        siblings, shapes = below_siblings, below_shapes
    return siblings, shapes


def folded(digest: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for step in shape:
        left, end = at + (step >> 2) * DIGEST, at + (step & 3) * DIGEST
        digest = parent(siblings[at:left] + digest + siblings[left:end])
        at = end
    return digest


# --- trees as tables ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Blocks of all rounds, the leaves' first: of the groups' trees, and of the tree over their subroots."""

    groups: list[DataFrame]
    top: list[DataFrame]
    height: int


BLOCK = "key string, block bigint, n bigint, width int, height int, nodes binary, root binary"


def _ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` (key, ...) with ``n``, the rows of its key, and ``position``, the row's place among them from 0."""
    by = [F.col("key").asc(), *[F.col(o).asc_nulls_first() for o in order]]
    # Equal rows may lie in any order; the random number spreads them over partitions.
    dealt = df.withColumn("tie", F.rand(11)).repartitionByRange(*by, F.col("tie")).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    lying = stored(dealt.drop("tie").withColumns({"part": F.spark_partition_id(), "place": place}), "merkle-places")
    counts = lying.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    every = Window.partitionBy("key")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    shifts = counts.select("key", "part", shift.alias("shift"), F.sum("rows").over(every).alias("n"))
    joined = lying.join(small_side(shifts), ["key", "part"])
    return joined.withColumn("position", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _blocks(nodes: DataFrame, full: int, name: str) -> DataFrame:
    """The blocks of at most ``full`` levels over nodes (key, n, position, digest, and perhaps row), stored."""
    span = ARITY**full
    row = [c for c in ("row",) if c in nodes.columns]
    block = F.call_function("div", F.col("position"), F.lit(span).cast("bigint"))
    members = F.sort_array(F.collect_list(F.struct("position", "digest", *row)))
    gathered = nodes.groupBy("key", block.alias("block"), "n").agg(members.alias("members"))
    shape = gathered.select("key", "block", "n", F.col("members.digest").alias("digests"),
                            *[F.col("members.row").alias("rows") for _ in row])
    schema = T.StructType([*T.StructType.fromDDL(BLOCK), *[shape.schema["rows"] for _ in row]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                leaves, n = one.column("digests")[0].as_py(), one.column("n")[0].as_py()
                height = full if n > span else height_over(n)
                held, root = block_of(leaves, height)
                made = [pa.array([len(leaves)], pa.int32()), pa.array([height], pa.int32()), pa.array([held], pa.binary()),
                        pa.array([root], pa.binary())]
                kept = [one.column(c) for c in ("key", "block", "n")]
                yield pa.RecordBatch.from_arrays([*kept, *made, *([one.column("rows")] if row else [])], names=schema.names)

    return stored(shape.mapInArrow(build, schema), name)


def _forest(ranked: DataFrame, full: int, name: str) -> list[DataFrame]:
    """The blocks of every round until each key has one."""
    span = ARITY**full
    rounds = [_blocks(ranked, full, name)]
    most = rounds[0].agg(F.max("n").alias("n")).first()["n"] or 0
    while most > span:
        fewer = F.ceil(F.col("n") / span).cast("bigint")
        below = rounds[-1].filter(F.col("n") > span)
        nodes = below.select("key", fewer.alias("n"), F.col("block").alias("position"), F.col("root").alias("digest"))
        rounds.append(_blocks(nodes, full, name))
        most = -(-most // span)
    return rounds


def _subroots(rounds: Sequence[DataFrame], full: int) -> DataFrame:
    """(key, digest) of every tree, from the round in which it has one block."""
    found = [r.filter(F.col("n") <= ARITY**full).select("key", F.col("root").alias("digest")) for r in rounds]
    result = found[0]
    for f in found[1:]:
        result = result.unionByName(f)
    return result


def build(
    docs: DataFrame, group: str, order: Sequence[str], digest: Column, carry: Sequence[Column] = (), height: int = HEIGHT
) -> Manifest:
    """The manifest of ``docs``: one tree per value of ``group`` over the leaves ``digest``, ascending by ``order`` and leaf.

    The ``carry`` columns lie beside the leaves and come back with the proofs. Blocks have ``height`` levels above their leaves.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all others
    names = [f"o{i}" for i in range(len(order))]
    leaves = docs.select(
        key.alias("key"), *[F.col(o).alias(n) for o, n in zip(order, names)], digest.alias("digest"),
        *[F.struct(*carry).alias("row") for _ in carry[:1]],
    )
    groups = _forest(_ranked(leaves, [*names, "digest"]).drop(*names), height, "merkle-blocks")
    over = _subroots(groups, height).select(F.lit("").alias("key"), F.col("key").alias("o0"), "digest", F.struct("key").alias("row"))
    return Manifest(groups, _forest(_ranked(over, ["o0"]).drop("o0"), height, "merkle-top"), height)


def _opened(blocks: DataFrame, above: DataFrame, full: int) -> DataFrame:
    """The nodes below ``blocks`` with their proofs, each continued by that of its block in ``above``."""
    row = "rows" in blocks.columns
    joined = blocks.select("key", "block", "width", "height", "nodes", *["rows"][:row]).join(above, ["key", "block"])
    further = [f for f in above.schema.fields if f.name not in ("key", "block", "siblings", "shape")]
    fields = [T.StructField("key", T.StringType()), T.StructField("block", T.LongType()), T.StructField("leaf", T.BinaryType()),
              T.StructField("siblings", T.BinaryType()), T.StructField("shape", T.BinaryType()), *further]
    if row:
        fields.append(T.StructField("row", blocks.schema["rows"].dataType.elementType))
    schema = T.StructType(fields)
    span = ARITY**full

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                key, block, width, height, nodes, up, shape = (
                    one.column(c)[0].as_py() for c in ("key", "block", "width", "height", "nodes", "siblings", "shape"))
                siblings, shapes = proofs_in(nodes, height, width)
                at = places(height + 1, height)[:width]
                made = [
                    pa.array([key] * width, pa.string()), pa.array(range(block * span, block * span + width), pa.int64()),
                    pa.array([nodes[p:p + DIGEST] for p in at], pa.binary()), pa.array([s + up for s in siblings], pa.binary()),
                    pa.array([s + shape for s in shapes], pa.binary()),
                    *[pa.repeat(one.column(f.name)[0], width) for f in further],
                ]
                if row:
                    made.append(one.column("rows").flatten())
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return joined.mapInArrow(expand, schema)


def _descended(rounds: Sequence[DataFrame], above: DataFrame, full: int) -> DataFrame:
    """Proofs of the leaves of all trees; ``above`` has (key, siblings, shape, ...) for each tree's own root."""
    found = None
    for blocks in reversed(rounds):
        ends = blocks.filter(F.col("n") <= ARITY**full).select("key", "block").join(above, "key")
        # Each block of a larger tree is a node of the round above.
        found = _opened(blocks, ends if found is None else ends.unionByName(found.select(ends.columns)), full)
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """(row, leaf, siblings, shape, subroot, root) for every leaf; ``row`` has the carried columns.

    ``siblings`` holds the digests beside the way from the leaf to the root, ``shape`` tells where they go.
    """
    empty = F.unhex(F.lit(""))
    root = _subroots(manifest.top, manifest.height).select("key", F.col("digest").alias("root"), empty.alias("siblings"), empty.alias("shape"))
    tops = _descended(manifest.top, root, manifest.height)
    above = tops.select(F.col("row.key").alias("key"), F.col("leaf").alias("subroot"), "siblings", "shape", "root")
    return _descended(manifest.groups, above, manifest.height).drop("key", "block")


def fold(df: DataFrame, digest: str, name: str = "folded_root") -> DataFrame:
    """``df`` with the root that column ``digest`` and the proof of the row lead to."""
    place = [df.columns.index(c) for c in (digest, "siblings", "shape")]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(p).to_pylist() for p in place]
            made = pa.array([folded(d, s, h) for d, s, h in zip(*given)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return df.mapInArrow(run, schema)
