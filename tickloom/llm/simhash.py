"""Near duplicates by SimHash fingerprints, linked through hierarchical indexes in Gray order.

Two fingerprints that differ in at most k bits agree on one of k + 1 blocks of bits, so the different fingerprints are
dealt out by (block, value). Each group is sorted by Gray rank, which puts fingerprints with common bits next to each
other, and a tree is built over it: a node holds the bits on which everything below agrees, without those that its
parent holds already. A search adds up the differences on the way down and drops a whole node once they exceed k.
Groups that are too large are dealt out again by blocks of their other bits, as often as it takes, which loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import add_columns, fresh, ship, stored
from tickloom.llm.components import components
from tickloom.operators.tables import small_side

ship(__name__)

SHINGLE = 4  # words
DISTANCE = 4  # bits
SEED = 42
FAN_OUT = 8
GROUP_ROWS = 50_000  # larger groups of different fingerprints are dealt out again
CHUNK_ROWS = 1 << 16  # rows whose groups are searched together
FRONTIER = 1 << 21  # pairs of query and node held at a time
STRETCH = 1 << 22  # bytes of a long text whose words are held at a time

BITS = np.array([[(value >> bit) & 1 for bit in range(8)] for value in range(256)], np.int64)


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = (starts[:len(words) - size + 1], ends[size - 1:]) if len(words) >= size else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(8) * 256
    return (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of a whole text; 0 without words."""
    counts, total = np.zeros(64, np.int64), 0
    if len(text) <= STRETCH:
        words = text.lower().split()
        if words:
            hashes = _shingle_hashes(words, size)
            counts, total = _bit_counts(hashes), len(hashes)
    else:
        left, held = b"", []
        for a in range(0, len(text), STRETCH):
            block = left + text[a:a + STRETCH].lower()
            words = block.split()
            # A word may go on in the next stretch.
            left = words.pop() if a + STRETCH < len(text) and words and block[-1:] not in b" \t\n\v\f\r" else b""
            held += words
            if len(held) >= size:
                hashes = _shingle_hashes(held, size)
                counts, total, held = counts + _bit_counts(hashes), total + len(hashes), held[len(held) - size + 1:]
        held += [left] if left else []
        if len(held) >= size or (held and not total):
            hashes = _shingle_hashes(held, size)
            counts, total = counts + _bit_counts(hashes), total + len(hashes)
    bits = np.flatnonzero(2 * counts > total)
    return int(np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))) if len(bits) else 0


def add_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint_bits", size: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a long; null and empty texts have 0."""
    def compute(column: pa.Array) -> list[pa.Array]:
        values = [fingerprint(t, size) for t in column.cast(pa.binary()).to_pylist()]
        return [pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())]

    return add_columns(docs, text, [(fresh(docs, name), T.LongType())], compute)


def _blocks(free: int, count: int) -> list[int]:
    """The set bits of ``free`` cut into ``count`` masks of nearly equal size, as signed longs."""
    bits = [b for b in range(64) if free >> b & 1]
    masks = []
    for k in range(count):
        mask = sum(1 << b for b in bits[k * len(bits) // count:(k + 1) * len(bits) // count])
        masks.append(mask)
    return [m for m in masks if m] or [free]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _dealt(rows: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """One row per fingerprint and block: the group's bits so far (``mask``) widened by each block of the others."""
    cases = F.create_map(*[
        part for mask in masks
        for part in (F.lit(_signed(mask)), F.array(*[F.lit(_signed(mask | b)) for b in _blocks(~mask & (1 << 64) - 1, distance + 1)]))
    ])
    wide = rows.select("bits", F.explode(F.element_at(cases, F.col("mask"))).alias("mask"))
    return wide.withColumn("value", F.col("bits").bitwiseAND(F.col("mask")))


def groups(prints: DataFrame, distance: int = DISTANCE, limit: int = GROUP_ROWS) -> DataFrame:
    """(bits, mask, value) of different fingerprints so that every linked pair shares a group of at most ``limit`` rows.

    Groups stop being dealt out when their free bits cannot hold more rows than the limit.
    """
    rows, masks, done = prints.select("bits", F.lit(0).cast("bigint").alias("mask")), [0], None
    while True:
        dealt = _dealt(rows, masks, distance)
        masks = sorted({m | b for m in masks for b in _blocks(~m & (1 << 64) - 1, distance + 1)})
        large = dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("mask", "value")
        large = stored(large, "large-groups")
        masks = [m for m in masks if 1 << (64 - bin(m).count("1")) > limit]
        if large.isEmpty() or not masks:
            return dealt if done is None else done.unionByName(dealt)
        side = small_side(large)
        kept = dealt.join(side, ["mask", "value"], "left_anti").select(*dealt.columns)
        done = kept if done is None else done.unionByName(kept)
        rows = stored(dealt.join(side, ["mask", "value"], "left_semi").select("bits", "mask"), "large-rows")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Trees over fingerprints sorted by (group, Gray rank), one per group, all levels in flat arrays."""

    def __init__(self, group: np.ndarray, bits: np.ndarray, fan_out: int = FAN_OUT) -> None:
        self.bits = bits
        owner, ones, some = group, bits, bits
        first = np.arange(len(bits))  # first child of each node; at the lowest level the row itself
        levels = [(np.full(len(bits), ~np.uint64(0)), bits, first, np.arange(1, len(bits) + 1))]
        count = len(np.unique(group))
        while len(owner) > count or len(levels) < 2:
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
            head = np.flatnonzero(place % fan_out == 0)
            end = np.append(head[1:], len(owner))
            ones, some, owner = np.bitwise_and.reduceat(ones, head), np.bitwise_or.reduceat(some, head), owner[head]
            last_row = levels[-1][3][end - 1]
            levels.append((ones | ~some, ones, head, last_row))
        self.levels, self.owner = levels, owner
        # Every level: agreed bits that the parent does not hold, their values, first child, end of children, last row + 1.
        self.nodes = []
        for k, (agreed, values, head, last) in enumerate(levels):
            if k + 1 < len(levels):
                above = levels[k + 1]
                size = np.diff(np.append(above[2], len(agreed)))
                own = agreed & ~np.repeat(above[0], size)
            else:
                own = agreed
            self.nodes.append((own, values, head, np.append(head[1:], len(levels[k - 1][0]) if k else len(agreed)), last))
        self.root = np.searchsorted(owner, group)

    def links(self, first: int, end: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, later row) within ``distance`` for the rows from ``first`` to ``end``."""
        waiting = [(len(self.nodes) - 1, np.arange(first, end), self.root[first:end], np.zeros(end - first, np.uint8))]
        while waiting:
            level, query, node, spent = waiting.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                waiting += [(level, query[half:], node[half:], spent[half:]), (level, query[:half], node[:half], spent[:half])]
                continue
            own, values, head, tail, last = self.nodes[level]
            spent = spent + np.bitwise_count((self.bits[query] ^ values[node]) & own[node])
            kept = (spent <= distance) & (last[node] > query + 1)
            query, node, spent = query[kept], node[kept], spent[kept]
            if not len(query):
                continue
            if level == 0:
                yield query, node
                continue
            size = tail[node] - head[node]
            child = np.repeat(head[node] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            waiting.append((level - 1, np.repeat(query, size), child, np.repeat(spent, size)))


def _root_of(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def linked(group: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints with a group number each: those linked to others of their group, and the first of their cluster."""
    order = np.lexsort((gray_rank(bits), group))
    group, bits = group[order], bits[order]
    index, label = GrayIndex(group, bits), np.arange(len(bits))
    for first in range(0, len(bits), CHUNK_ROWS):
        for a, b in index.links(first, min(first + CHUNK_ROWS, len(bits)), distance):
            while True:
                label = _root_of(label)
                x, y = label[a], label[b]
                if np.array_equal(x, y):
                    break
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
    label = _root_of(label)
    moved = np.flatnonzero(label != np.arange(len(bits)))
    return bits[moved], bits[label[moved]]


def links(prints: DataFrame, distance: int = DISTANCE, limit: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all pairs within ``distance`` bits.

    Within a group every pair is found, but only a link to the first of each cluster leaves the task, so clusters of
    many copies stay small. Several groups share a task's arrays; one group never exceeds the limit.
    """
    dealt = groups(prints, distance, limit).repartition("mask", "value").sortWithinPartitions("mask", "value")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def found(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(np.diff(rows[1:], axis=1, prepend=rows[1:, :1] - 1) != 0, axis=0)
            number = np.cumsum(new)
            own = np.bincount(number)[number] > 1
            a, b = linked(number[own], rows[0][own].view(np.uint64), distance) if own.any() else (rows[0][:0], rows[0][:0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]))
                count += batch.num_rows
            if count >= CHUNK_ROWS:
                rows = np.ascontiguousarray(np.concatenate(held, axis=1))
                borders = np.flatnonzero(np.any(np.diff(rows[1:], axis=1) != 0, axis=0))
                if len(borders):
                    whole = int(borders[-1]) + 1
                    yield found(np.ascontiguousarray(rows[:, :whole]))
                    rows = rows[:, whole:]
                held, count = [rows], rows.shape[1]
        if count:
            yield found(np.ascontiguousarray(np.concatenate(held, axis=1)))

    return dealt.select("bits", "mask", "value").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE,
                    size: int = SHINGLE, limit: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, bits, component_id, root): each document's fingerprint, the smallest id it can reach, and its group.

    One row per row of ``docs``, repeated ones included. Null and empty texts have fingerprint 0 and are linked like any
    other. Null ids count for nothing as long as the group has another; a group without any has a null component.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(add_fingerprints(plain, size=size).select("doc_id", F.col("fingerprint_bits").alias("bits")), "fingerprints")
    different = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    tied = components(links(different.select("bits"), distance, limit))
    roots = different.join(tied.select(F.col("node").alias("bits"), "root"), "bits", "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    roots = stored(roots, "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_bits = roots.select("bits", "root").join(least, "root").select("bits", "component_id", "root")
    return prints.join(by_bits, "bits").select("doc_id", "bits", "component_id", "root")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id, nulls last.

    Where several rows of a group share that id, the one whose text has the smallest hash stays, of equal rows one.
    """
    found = near_duplicates(docs, text, doc_id, distance, size)
    keys = found.groupBy("root", "doc_id", "bits").agg(F.count(F.lit(1)).alias("n"))
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "bits")).alias("row"))
    winners = stored(first.select("root", "row.doc_id", "row.bits"), "winners")
    # An id that only one row has names that row; the rows of other ids have to be told apart by their texts.
    lone = keys.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n = 1").select("doc_id")
    sole = stored(winners.join(lone, "doc_id", "left_semi").select(F.col("doc_id").alias("__sole")), "sole-winners")
    # The ids grow with the documents, so the join is a shuffle of the texts at any size.
    kept = docs.join(sole.hint("merge"), docs[doc_id] == sole["__sole"], "left_semi")
    shared = winners.join(sole, winners["doc_id"] == sole["__sole"], "left_anti")
    if shared.isEmpty():
        return kept
    return kept.unionByName(_told_apart(docs, stored(shared, "shared-winners"), text, doc_id, size))


def _told_apart(docs: DataFrame, winners: DataFrame, text: str, doc_id: str, size: int) -> DataFrame:
    """The winning row of each group where several rows have its id, or none has one."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own_id, own_text = names[docs.columns.index(doc_id)], names[docs.columns.index(text)]
    side = winners.select(F.col("doc_id").alias("__id"), F.col("bits").alias("__own"), F.col("root").alias("__root"))
    ids = side.select("__id").distinct()
    some = plain.join(ids, plain[own_id].eqNullSafe(ids["__id"]), "left_semi")
    printed = add_fingerprints(some, text=own_text, name="__bits", size=size)
    tied = printed.join(side, printed[own_id].eqNullSafe(side["__id"]) & (printed["__bits"] == side["__own"]))
    order = F.struct(F.xxhash64(F.coalesce(F.col(own_text), F.lit(""))), *[F.col(n).cast("string") for n in names])
    best = tied.groupBy("__root").agg(F.min_by(F.struct(*names), order).alias("row"))
    return best.select("row.*").toDF(*docs.columns)
