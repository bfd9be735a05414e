"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the largest length, and 0 for queries,
which are scaled to length M. Balanced halving of a sample gives the centroids, of which there is a bounded number. They
are joined into a neighbour graph that each task holds in memory. Vectors go to the list of their nearest centroid, and
boundary vectors also to others that are nearly as near, in different directions; a walk of the graph finds them. A query
walks the graph to its nearest centroid, then on from every centroid within a ratio of that one's distance, until none of
these is left unvisited, and searches their lists, however many these are. Neighbouring lists form cells, of which there
are at most CELLS, and a vector or query goes once to each cell it has lists in, with a bit per list. Cells are cut into
blocks of bounded size, and so are the queries of a cell; a pair of blocks is searched list by list, or in one matrix
product if that takes fewer products.

Bounds: MAX_CENTROIDS and SAMPLE_PER_CENTROID of the index, DEGREE links and WIDTH held candidates of the graph, REPLICAS
lists a vector, CELLS. None of them leaves out a vector or limits the lists that a query searches. RATIO is chosen by
recall of the 20 nearest, which the README states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import ship, stored, unit_hash

ship(__name__)

NEIGHBOURS = 20
LIST_ROWS = 128  # vectors per centroid, as long as there are fewer than MAX_CENTROIDS
MAX_CENTROIDS = 8192
SAMPLE_PER_CENTROID = 40
DEGREE = 24
FAR = 8  # random links of each centroid, which join pieces of the graph that have no near links
WIDTH = 96  # candidates that a walk of the graph holds
PAIRS = 1 << 15  # distances, or steps of a walk, that are computed at a time
CELLS = 64
REPLICAS = 4
NEARLY = 1.10  # a vector also joins centroids up to this ratio of its least distance
APART = 0.1  # least gap to the centroids a vector has joined, as a share of its distance
RATIO = 1.15  # a query searches lists up to this ratio of its least distance
BLOCK_ROWS = 16_384
QUERY_EVERY = 20


@dataclass
class Index:
    centroids: np.ndarray  # with the extra component
    links: np.ndarray  # neighbours of each centroid
    entry: np.ndarray  # where walks start
    length: float  # M


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite numbers, not all zero; floats stay floats."""
    kind = "array<float>" if vectors.select(column).dtypes[0][1] == "array<float>" else "array<double>"
    plain = vectors.select("vec_id", F.col(column).cast(kind).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return plain.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def of_one_length(rows: DataFrame) -> DataFrame:
    """The rows whose vectors have the length that is met most often; one row comes to the driver."""
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return rows.filter(F.size("v") == most["size"]) if most else rows


def squared_length(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def lifted(rows: np.ndarray, length: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(length * length - (rows * rows).sum(axis=1), 0))
    return np.column_stack([rows, rest]).astype(np.float32)


def as_queries(rows: np.ndarray, length: float) -> np.ndarray:
    size = np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)
    return np.column_stack([rows / size * length, np.zeros(len(rows))]).astype(np.float32)


def balanced_centroids(rows: np.ndarray, count: int, seed: int = 4) -> np.ndarray:
    """Means of ``count`` groups of equal size, by halving along the line between two cluster centres."""
    rng = np.random.default_rng(seed)
    waiting, found = [(rows, max(1, min(count, len(rows))))], []
    while waiting:
        group, parts = waiting.pop()
        if parts == 1:
            found.append(group.mean(axis=0))
            continue
        ends = group[rng.choice(len(group), 2, replace=False)]
        for _ in range(6):
            side = group @ (ends[1] - ends[0])
            order = np.argsort(side, kind="stable")
            cut = len(group) * (parts // 2) // parts
            ends = np.stack([group[order[:cut]].mean(axis=0), group[order[cut:]].mean(axis=0)])
        waiting += [(group[order[:cut]], parts // 2), (group[order[cut:]], parts - parts // 2)]
    return np.stack(found).astype(np.float32)


def graph_of(centroids: np.ndarray, degree: int = DEGREE, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Near neighbours of each centroid plus a few far ones that keep the graph in one piece, and entry points."""
    count, rng = len(centroids), np.random.default_rng(seed)
    near = []
    size = (centroids * centroids).sum(axis=1)
    k = min(degree, count - 1)
    for a in range(0, count, 1024):
        d = size[None, :] - 2 * centroids[a:a + 1024] @ centroids.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near.append(np.argpartition(d, max(k - 1, 0), axis=1)[:, :k] if k else np.empty((len(d), 0), np.int64))
    links = np.vstack(near)
    ring = np.stack([np.roll(np.arange(count), s) for s in (1, -1)], axis=1)
    far = rng.integers(0, count, (count, FAR))
    entry = rng.choice(count, min(count, max(32, 4 * int(count ** 0.5))), replace=False)
    return np.hstack([links, ring, far]).astype(np.int64), np.sort(entry)


def walk(index: Index, rows: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroids that a best-first walk finds, nearest first: numbers and distances."""
    centroids, count, n = index.centroids, len(index.centroids), len(rows)
    size, own = (centroids * centroids).sum(axis=1), (rows * rows).sum(axis=1)

    def distance(row: np.ndarray, to: np.ndarray) -> np.ndarray:
        inner = np.einsum("bkd,bd->bk", centroids[to], rows[row])
        return np.maximum(size[to] - 2 * inner + own[row][:, None], 0)

    width = min(width, count)
    seen = np.zeros((n, count), bool)
    every = np.arange(n)
    start = np.broadcast_to(index.entry, (n, len(index.entry)))
    seen[:, index.entry] = True
    ids, dist = start.copy(), distance(every, start)
    done = np.zeros(ids.shape, bool)
    active = every
    while len(active):
        open_dist = np.where(done[active], np.inf, dist[active])
        best = np.argmin(open_dist, axis=1)
        going = open_dist[np.arange(len(active)), best] < np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        to = index.links[ids[active, best]]
        new = ~seen[active[:, None], to]
        # The same neighbour twice in one row of links counts once.
        order = np.argsort(to, axis=1, kind="stable")
        sorted_to = np.take_along_axis(to, order, axis=1)
        twice = np.zeros_like(new)
        np.put_along_axis(twice, order[:, 1:], sorted_to[:, 1:] == sorted_to[:, :-1], axis=1)
        new &= ~twice
        seen[active[:, None], to] = True
        more = np.where(new, distance(active, to), np.inf)
        joined_ids, joined = np.hstack([ids[active], to]), np.hstack([dist[active], more])
        joined_done = np.hstack([done[active], ~new])
        keep = np.argsort(joined, axis=1, kind="stable")[:, :width]
        if ids.shape[1] < keep.shape[1]:
            grow = keep.shape[1] - ids.shape[1]
            ids = np.hstack([ids, np.zeros((n, grow), np.int64)])
            dist, done = np.hstack([dist, np.full((n, grow), np.inf)]), np.hstack([done, np.ones((n, grow), bool)])
        wide = keep.shape[1]
        ids[active, :wide] = np.take_along_axis(joined_ids, keep, axis=1)
        dist[active, :wide] = np.take_along_axis(joined, keep, axis=1)
        done[active, :wide] = np.take_along_axis(joined_done, keep, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.sqrt(np.take_along_axis(dist, order, axis=1))


def fit(vectors: DataFrame, list_rows: int = LIST_ROWS, max_centroids: int = MAX_CENTROIDS) -> tuple[Index | None, int]:
    """The index from a sample of at most about SAMPLE_PER_CENTROID * max_centroids vectors, and how many rows there are."""
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(squared_length(F.col("v"))).alias("m")).first()
    if not row["n"]:
        return None, 0
    count = max(1, min(max_centroids, row["n"] // list_rows))
    chance = min(1.0, SAMPLE_PER_CENTROID * count / row["n"])
    sample = vectors.filter(unit_hash("vec_id", seed=9) < chance).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    if not sample:
        sample = vectors.limit(1).collect()
    length = float(np.sqrt(row["m"]))
    rows = lifted(np.array([r["v"] for r in sorted(sample, key=lambda r: r["vec_id"])]), length)
    centroids = balanced_centroids(rows, count)
    links, entry = graph_of(centroids)
    return Index(centroids, links, entry, length), row["n"]


def _per_cell(lists: int) -> int:
    return -(-lists // CELLS)


def searched_lists(index: Index, rows: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """Whether each query, as :func:`as_queries` makes them, searches each list.

    A walk finds the nearest centroid; from there on every centroid within the ratio is visited and its neighbours are
    measured, until all within the ratio have been visited. Centroids that no such path meets are never measured.
    """
    centroids, count = index.centroids, len(index.centroids)
    size, own = (centroids * centroids).sum(axis=1), (rows * rows).sum(axis=1)
    dist = np.full((len(rows), count), np.inf, np.float32)
    found, away = walk(index, rows)
    row, place = np.nonzero(np.isfinite(away))
    dist[row, found[row, place]] = away[row, place]
    visited = np.zeros(dist.shape, bool)
    while True:
        near = dist <= ratio * dist.min(axis=1, keepdims=True) + 1e-6
        row, at = np.nonzero(near & ~visited)
        if not len(row):
            return near
        visited[row, at] = True
        met = np.zeros(dist.shape, bool)
        for a in range(0, len(row), PAIRS):
            met[row[a:a + PAIRS, None], index.links[at[a:a + PAIRS]]] = True
        row, to = np.nonzero(met & np.isinf(dist))
        for a in range(0, len(row), PAIRS):
            r, c = row[a:a + PAIRS], to[a:a + PAIRS]
            inner = np.einsum("pd,pd->p", centroids[c], rows[r])
            dist[r, c] = np.sqrt(np.maximum(size[c] - 2 * inner + own[r], 0))


def _packed(member: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows and cells that have any of their ``per`` lists, and these as bits."""
    count, lists = member.shape
    cells = -(-lists // per)
    member = np.pad(member, ((0, 0), (0, cells * per - lists))).reshape(count, cells, per)
    row, cell = np.nonzero(member.any(axis=2))
    bits = np.packbits(member[row, cell], axis=1)
    ends = np.arange(len(row) + 1, dtype=np.int32) * bits.shape[1]
    return row, cell, pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(bits.tobytes())])


def _unpacked(bits: pd.Series, per: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1, count=per).astype(np.float32)


def _listed(vectors: DataFrame, index: Index, name: str, queries: bool) -> DataFrame:
    """(cell, id, lists, v) rows: the lists a vector joins, or those a query searches."""
    per = _per_cell(len(index.centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                rows = flat.reshape(part.num_rows, -1)
                if queries:
                    member = searched_lists(index, as_queries(rows, index.length))
                else:
                    ids, dist = (x[:, :8 * REPLICAS] for x in walk(index, lifted(rows, index.length)))
                    row, place = np.nonzero(_spread(index.centroids, ids, dist))
                    member = np.zeros((len(rows), len(index.centroids)), bool)
                    member[row, ids[row, place]] = True
                row, cell, bits = _packed(member, per)
                yield pa.RecordBatch.from_arrays([
                    pa.array(cell.astype(np.int32)), part.column(0).take(pa.array(row)), bits, part.column(1).take(pa.array(row)),
                ], names=["cell", name, "lists", "v"])

    return vectors.select("vec_id", "v").mapInArrow(assign, f"cell int, {name} long, lists binary, v {vectors.dtypes[1][1]}")


def _spread(centroids: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Lists of each vector: the nearest, and nearly as near ones, unless their centroid all but meets one chosen before."""
    chosen = np.zeros(ids.shape, bool)
    chosen[:, 0] = True
    count = np.ones(len(ids), np.int64)
    for k in range(1, ids.shape[1]):
        fits = (dist[:, k] <= NEARLY * dist[:, 0] + 1e-9) & np.isfinite(dist[:, k]) & (count < REPLICAS)
        rows = np.flatnonzero(fits)
        if not len(rows):
            continue
        gaps = np.linalg.norm(centroids[ids[rows, :k]] - centroids[ids[rows, k]][:, None, :], axis=2)
        crowded = (chosen[rows, :k] & (gaps < APART * dist[rows, k][:, None])).any(axis=1)
        chosen[rows[~crowded], k] = True
        count[rows[~crowded]] += 1
    return chosen


def _blocks(rows: DataFrame, block: int) -> Column:
    """How many blocks each cell has, as an array by cell number; one count per cell comes to the driver."""
    counts = [1] * CELLS
    for r in rows.groupBy("cell").count().collect():
        counts[r["cell"]] = -(-r["count"] // block)
    return F.array(*[F.lit(c) for c in counts])


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest finite scores of each row, equal ones (but for rounding) from the left."""
    if scores.shape[1] <= k:
        return np.nonzero(np.isfinite(scores))
    least = np.partition(scores, -k, axis=1)[:, -k:].min(axis=1, keepdims=True)
    slack = np.where(np.isfinite(least), 1e-13 * np.abs(least), 0)
    row, place = np.nonzero((scores >= least - slack) & np.isfinite(scores))
    above = scores[row, place] > (least + slack)[row, 0]
    ties = np.cumsum(~above)
    first = np.searchsorted(row, np.arange(len(scores)))
    before = np.concatenate([[0], ties])[first]
    room = k - np.bincount(row[above], minlength=len(scores))
    taken = above | (ties - before[row] <= room[row])
    return row[taken], place[taken]


def _pairs(
    names: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, wants: np.ndarray | None, has: np.ndarray | None, k: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query_id, vec_id, score) of the best of ``v``, which are in order of their ids, for every row of ``q``.

    Products of equal vectors may differ in the last bit by their place in a matrix: what is chosen is computed once
    more pair by pair, so that ties stay ties.
    """
    found = []
    first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    for a in range(0, len(q), 256):
        scores = q[a:a + 256] @ v.T
        scores[names[a:a + 256, None] == ids] = -np.inf
        if wants is not None and not wants[a:a + 256].all():
            scores[wants[a:a + 256] @ has.T == 0] = -np.inf
        if len(first) < len(ids):  # one candidate per id
            best = np.maximum.reduceat(scores, first, axis=1)
            row, place = _best(best, k)
            found.append((names[a + row], ids[first[place]], best[row, place]))
        else:
            row, place = _best(scores, k)
            found.append((names[a + row], ids[place], np.einsum("pd,pd->p", q[a + row], v[place])))
    return found


def _searched(postings: DataFrame, queries: DataFrame, lists: int, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every pair of a block of a cell and a block of its queries.

    A query is compared with those vectors of the block that share a list with it.
    """
    list_blocks, query_blocks, per = _blocks(postings, block), _blocks(queries, block), _per_cell(lists)

    def dealt(rows: DataFrame, own: Column, other: Column, key: str, names: tuple[str, str]) -> DataFrame:
        at = F.pmod(F.xxhash64(key), F.get(own, F.col("cell"))).cast("int")
        with_own = rows.withColumn(names[0], at)
        return with_own.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.get(other, F.col("cell")) - 1)))

    left = dealt(postings, list_blocks, query_blocks, "vec_id", ("block", "turn"))
    right = dealt(queries, query_blocks, list_blocks, "query_id", ("turn", "block"))

    def best(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "f8"))]
        if len(vectors) and len(asked):
            ids, names = vectors["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v, q = ids[order], np.stack(vectors["v"].to_numpy()).astype(float)[order], np.stack(asked["v"].to_numpy()).astype(float)
            has, wants = _unpacked(vectors["lists"], per)[order], _unpacked(asked["lists"], per)
            if (has.sum(axis=0) * wants.sum(axis=0)).sum() < len(v) * len(q):
                for one in np.flatnonzero(has.any(axis=0) & wants.any(axis=0)):
                    mine, theirs = np.flatnonzero(has[:, one]), np.flatnonzero(wants[:, one])
                    found += _pairs(names[theirs], q[theirs], ids[mine], v[mine], None, None, k)
            else:
                found += _pairs(names, q, ids, v, wants, has, k)
        out = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*found)))))
        # A vector may have been met in several lists.
        out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
        return out[out.groupby("query_id").cumcount() < k]

    keys = ["cell", "block", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = QUERY_EVERY, column: str = "embedding",
            list_rows: int = LIST_ROWS, max_centroids: int = MAX_CENTROIDS, block: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with an id divisible by ``every``, nearest first, ties to smaller ids.

    Rows that share an id count as one candidate, with the best of their scores, and never as a neighbour of their own
    id. Vectors of another length than most rows have (of the greater one, if as many) have no product with those and
    take no part. A query whose lists hold fewer than ``k`` others searches all lists. No rows give no rows.
    """
    rows = of_one_length(stored(usable(vectors, column), "vectors"))
    index, total = fit(rows, list_rows, max_centroids)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    lists = len(index.centroids)
    asked = rows.filter(F.col("vec_id") % every == 0)
    postings = stored(_listed(rows, index, "vec_id", False), "postings")
    queries = stored(_listed(asked, index, "query_id", True), "query-lists")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = stored(ranked(_searched(postings, queries, lists, k, block)), "found")
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("__full"))
    short = asked.join(full, asked["vec_id"] == full["__full"], "left_anti").select(F.col("vec_id").alias("query_id"), "v")
    per = _per_cell(lists)
    every_list = F.lit(bytes([255] * -(-per // 8)))
    cells = F.sequence(F.lit(0), F.lit(-(-lists // per) - 1))
    short = stored(short.select(F.explode(cells).alias("cell"), "query_id", every_list.alias("lists"), "v"), "short-queries")
    if not short.isEmpty():
        rest = _searched(postings, short, lists, k, block)
        found = ranked(found.select("query_id", "vec_id", "score").unionByName(rest))
    return found.select("query_id", "rank", "vec_id", "score")
