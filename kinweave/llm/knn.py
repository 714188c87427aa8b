"""Exact top-k search by inner product with KD-trees.

The upper levels of one KD-tree, whose medians come from a bounded sample, cut
the vectors into cells, and a cell with too many rows is dealt into shards by a
hash of the ids.  All rows are indexed; the cells' boxes are tight around all of
their rows, so the sample decides how well the search prunes, never what it
finds.  Each shard is a KD-tree of its own: median splits along the widest side,
with the tight box of the points below each node.

No point of a box scores more against a query than the sum over the sides of the
better of the box's two ends.  The search is best-first on both levels.  Of all
cells a query visits the one with the best bound first; the kth score that it
reaches there is propagated, and only cells whose bounds reach that score see
the query again.  Inside a shard the node with the best bound is taken from the
frontier: an inner node gives its two children, a leaf its scores, and the
search ends when the best bound left is below the kth score.

Queries travel to the shards and pass as a stream; a task holds one shard and
some thousand queries at a time.

Scores are exact integers.  Ties go to the smaller id, so a node whose bound
equals the kth score is visited.

Defined results: null ids, null vectors and vectors with null or non-finite
components take no part; vectors meet only vectors of the same length; all rows
with an id equal to the query's are its own; rows may repeat and each counts,
but a query id asks once: of several vectors with one id the smallest asks.
Scores beyond 64 bits overflow.  An empty table has no neighbours; columns other
than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, give_back


def median_split(points: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The widest side and the order that puts the lower half first; None if all points are equal."""
    spread = points.max(axis=0) - points.min(axis=0)
    side = int(spread.argmax()) if spread.size else 0
    if not spread.size or not spread[side]:
        return None
    return side, np.argpartition(points[:, side], len(points) // 2)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that any point of each box can score: (queries x boxes)."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def enough_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the ``k`` best of any query, whatever id is its own.

    Of equal vectors the k + 1 smallest ids, each k times at most: without those
    of one id there are k left at least, and no larger id can come before them.
    """
    order = np.lexsort((ids, *vectors.T))
    i, v = ids[order], vectors[order]
    at = np.arange(len(i))
    new = np.concatenate(([True], (v[1:] != v[:-1]).any(axis=1)))
    other = new | np.concatenate(([True], i[1:] != i[:-1]))
    nth_copy = at - np.maximum.accumulate(np.where(other, at, 0))
    nth = np.cumsum(other)
    nth_id = nth - np.maximum.accumulate(np.where(new, nth, 0))
    return order[(nth_id <= k) & (nth_copy < k)]


class Tree:
    """A KD-tree over integer vectors; node 0 is the root, a leaf has no children but a range of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_size: int = 256):
        low, high, child, rows = [], [], [], []
        order: list[np.ndarray] = []
        done = 0
        stack = [(np.arange(len(ids)), -1)] if len(ids) else []
        while stack:
            part, parent = stack.pop()
            node = len(low)
            if parent >= 0:
                child[parent].append(node)
            points = vectors[part]
            low.append(points.min(axis=0))
            high.append(points.max(axis=0))
            child.append([])
            rows.append((0, 0))
            split = median_split(points) if len(part) > leaf_size else None
            if split is None:
                order.append(part)
                rows[node] = (done, done + len(part))
                done += len(part)
                continue
            middle = len(part) // 2
            stack += [(part[split[1][middle:]], node), (part[split[1][:middle]], node)]
        at = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        self.ids, self.vectors = ids[at], vectors[at]
        self.low = np.array(low).reshape(len(low), vectors.shape[1])
        self.high = np.array(high).reshape(len(high), vectors.shape[1])
        self.child = np.array([c or (-1, -1) for c in child], dtype=np.int64).reshape(-1, 2)
        self.rows = np.array(rows, dtype=np.int64).reshape(-1, 2)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best of each query, best first: places of the queries, scores and ids.

        ``floor`` is a score that is known to be reached k times: lower ones are
        left out.
        """
        n = len(queries)
        least = np.iinfo(np.int64).min if self.vectors.dtype.kind == "i" else -np.inf
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places of queries, scores, ids
        top = np.full((n, k), least, dtype=self.vectors.dtype)
        kth = floor.astype(top.dtype)
        bound = bounds(queries, self.low, self.high) if len(self.rows) else np.zeros((n, 0), top.dtype)
        frontier = np.full(bound.shape, least, dtype=top.dtype)
        waits = np.zeros(bound.shape, dtype=bool)
        frontier[:, :1], waits[:, :1] = bound[:, :1], True
        active = np.arange(n if len(self.rows) else 0)
        while len(active):
            node = frontier[active].argmax(axis=1)
            go = waits[active, node] & (bound[active, node] >= kth[active])
            active, node = active[go], node[go]
            order = np.argsort(node, kind="stable")
            edges = np.flatnonzero(np.diff(node[order], prepend=-1))
            for x, who in zip(node[order][edges].tolist(), np.split(active[order], edges[1:])):
                frontier[who, x], waits[who, x] = least, False
                if self.child[x, 0] >= 0:
                    for c in self.child[x]:
                        near = who[bound[who, c] >= kth[who]]
                        frontier[near, c], waits[near, c] = bound[near, c], True
                    continue
                a, z = self.rows[x]
                got = queries[who] @ self.vectors[a:z].T
                got[query_ids[who][:, None] == self.ids[None, a:z]] = least
                ready = np.flatnonzero((got.max(axis=1) >= kth[who]) & (got.max(axis=1) > least))
                if len(ready):
                    who, got = who[ready], got[ready]
                    i, j = np.nonzero((got >= kth[who][:, None]) & (got > least))
                    found.append((who[i], got[i, j], self.ids[a:z][j]))
                    both = np.concatenate((top[who], got), axis=1)
                    top[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    kth[who] = np.maximum(kth[who], top[who].min(axis=1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, top.dtype), np.zeros(0, np.int64)
        who, score, ids = (np.concatenate(x) for x in zip(*found))
        last = score >= kth[who]
        who, score, ids = who[last], score[last], ids[last]
        order = np.lexsort((ids, -score if score.dtype.kind == "f" else ~score, who))
        who, score, ids = who[order], score[order], ids[order]
        at = np.arange(len(who))
        rank = at - np.maximum.accumulate(np.where(np.diff(who, prepend=-1) != 0, at, 0))
        best = rank < k
        return who[best], score[best], ids[best]


def kind_of(largest: int, dim: int) -> np.dtype:
    """The fastest type in which sums of ``dim`` products of components up to ``largest`` are exact."""
    most = largest * largest * max(dim, 1)
    return np.dtype(np.float32) if most < 1 << 24 else np.dtype(np.float64) if most < 1 << 53 else np.dtype(np.int64)


def _largest(*vectors: np.ndarray) -> int:
    return max((max(int(v.max()), -int(v.min())) for v in vectors if v.size), default=0)


@dataclass
class Directory:
    """The upper levels of the tree for one vector length, with what is known of each cell.

    ``side`` and ``at`` are the inner nodes' splits and ``child`` their children;
    a child below 0 is the cell -1 - child.
    """

    dim: int
    side: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    child: list[list[int]] = field(default_factory=list)
    n_cells: int = 1
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    shards: np.ndarray | None = None

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = np.zeros(len(vectors), dtype=np.int32)
        stack = [(0, np.arange(len(vectors)))] if self.side else []
        while stack:
            node, part = stack.pop()
            if node < 0:
                out[part] = -1 - node
                continue
            lower = vectors[part, self.side[node]] <= self.at[node]
            stack += [(self.child[node][0], part[lower]), (self.child[node][1], part[~lower])]
        return out


def make_directory(sample: np.ndarray, n_cells: int) -> Directory:
    """Median splits of a sample, the largest part first, down to ``n_cells`` cells."""
    d = Directory(sample.shape[1])
    parts: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
    while len(parts) < n_cells:
        # a part of equal points can't be split, nor one whose median is its largest value
        for i in sorted(range(len(parts)), key=lambda i: -len(parts[i][0])):
            part, parent, which = parts[i]
            split = median_split(sample[part]) if len(part) > 1 else None
            if split is None:
                continue
            values = sample[part, split[0]]
            at = int(np.sort(values)[(len(part) - 1) // 2])
            if at == values.max():
                at = int(values[values < at].max())
            break
        else:
            break
        node = len(d.side)
        d.side.append(split[0])
        d.at.append(at)
        d.child.append([0, 0])
        if parent >= 0:
            d.child[parent][which] = node
        lower = values <= at
        parts[i : i + 1] = [(part[lower], node, 0), (part[~lower], node, 1)]
    for cell, (_, parent, which) in enumerate(parts):
        if parent >= 0:
            d.child[parent][which] = -1 - cell
    d.n_cells = len(parts)
    return d


def scaled(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): components as floor(scale * x) of the vectors that take part."""
    x = F.col("embedding")
    whole = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(
        F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    )
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches whose vectors have one length."""
    for batch in batches:
        dims = column(batch, "dim").to_numpy()
        for dim in np.unique(dims).tolist():
            yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def directories(rows: DataFrame, n: int, shard_rows: int, max_cells: int, sample_rows: int) -> dict[int, Directory]:
    """The directory of each vector length in a sample of ``rows`` (vec_id, v, dim): about ``sample_rows`` rows.

    Boxes and sizes of the cells are taken over all rows.
    """
    n_shards = max(1, round(n / shard_rows))
    h = F.xxhash64("vec_id").cast("double") / 2.0**64 + 0.5
    few = min(sample_rows, 16 * min(max_cells, n_shards))
    picked = rows.where(h <= min(1.0, few / max(1, n))).select("vec_id", "v", "dim").limit(2 * few + 100).toArrow().sort_by([("vec_id", "ascending")])
    by_dim: dict[int, list] = {}
    for dim, v in zip(picked["dim"].to_pylist(), picked["v"].to_pylist()):
        by_dim.setdefault(dim, []).append(v)
    made = {}
    for dim, vs in by_dim.items():
        sample = np.array(sorted(vs), dtype=np.int64).reshape(len(vs), dim)
        made[dim] = make_directory(sample, max(1, min(max_cells, round(n_shards * len(vs) / picked.num_rows))))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for dim, batch in _by_dim(batches):
            if dim not in made:
                continue
            v = _matrix(column(batch, "v"), dim)
            cells = made[dim].cells(v)
            for c in np.unique(cells).tolist():
                own = v[cells == c]
                n0, lo, hi = found.get((dim, c), (0, own[0], own[0]))
                found[(dim, c)] = [n0 + len(own), np.minimum(lo, own.min(axis=0)), np.maximum(hi, own.max(axis=0))]
        if found:
            keys = list(found)
            yield pa.RecordBatch.from_pydict(
                {"dim": pa.array([d for d, _ in keys], pa.int32()), "cell": pa.array([c for _, c in keys], pa.int32()), "n": [found[x][0] for x in keys], "low": [found[x][1].tolist() for x in keys], "high": [found[x][2].tolist() for x in keys]}
            )

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = np.array(pdf["low"].tolist()).min(axis=0), np.array(pdf["high"].tolist()).max(axis=0)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "cell": pdf["cell"].iloc[:1], "n": [int(pdf["n"].sum())], "low": [low.tolist()], "high": [high.tolist()]})

    schema = "dim int, cell int, n long, low array<long>, high array<long>"
    for r in rows.select("v", "dim").mapInArrow(boxes, schema).groupBy("dim", "cell").applyInPandas(joined, schema).collect():
        d = made[r["dim"]]
        if d.low is None:
            d.low, d.high, d.shards = np.zeros((d.n_cells, d.dim), np.int64), np.zeros((d.n_cells, d.dim), np.int64), np.zeros(d.n_cells, np.int64)
        d.low[r["cell"]], d.high[r["cell"]], d.shards[r["cell"]] = r["low"], r["high"], max(1, round(r["n"] / shard_rows))
    return {dim: d for dim, d in made.items() if d.low is not None}


_PLACED = "dim int, cell int, shard int, part int, kind int, id long, v array<long>, floor long"
_NAMES = [x.split()[0] for x in _PLACED.split(", ")]


def _placed(dim: int, cell, shard, part, kind: int, ids, v: pa.Array, floor) -> pa.RecordBatch:
    m = len(ids)
    same = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), m), t)
    return pa.RecordBatch.from_arrays(
        [same(dim, pa.int32()), same(cell, pa.int32()), same(shard, pa.int32()), same(part, pa.int32()), same(kind, pa.int32()), pa.array(ids, pa.int64()), v, floor], names=_NAMES
    )


def _hash_part(ids: np.ndarray, n: int | np.ndarray, salt: int) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.asarray(n, dtype=np.uint64)).astype(np.int32)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_rows: int | None = None, part_queries: int = 262_144, max_cells: int = 1024, sample_rows: int = 16_384
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query row of ``vectors`` (vec_id, embedding).

    ``shard_rows`` rows make a shard (by default as many as give some dozen
    shards, 65,536 at most); a shard with more than ``part_queries`` queries is
    searched by several tasks.
    """
    rows = scaled(vectors.select("vec_id", "embedding"), scale).withColumn("dim", F.size("v"))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min_by("dim", "v").alias("dim"), F.min("v").alias("v"))
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shard_rows = shard_rows or min(65_536, max(4_096, n // 32))
    known = directories(rows, n, shard_rows, max_cells, sample_rows)
    n_parts = max(1, -(-n_asked // part_queries))
    blind_shards = max(1, -(-n // shard_rows))  # of lengths that the sample doesn't hold: one cell without a box

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_dim(batches):
            ids, v, d = column(batch, "vec_id").to_numpy(), column(batch, "v"), known.get(dim)
            cell = d.cells(_matrix(v, dim)) if d else np.zeros(len(ids), dtype=np.int32)
            shard = _hash_part(ids, d.shards[cell] if d else blind_shards, 1)
            for p in range(n_parts):
                yield _placed(dim, cell, shard, p, 0, ids, v, pa.nulls(len(ids), pa.int64()))

    def best_cells(d: Directory | None, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the cells for each query, in whole numbers, and the cell with the best."""
        if d is None:
            return np.full((len(queries), 1), np.iinfo(np.int64).max), np.zeros(len(queries), np.int64)
        kind = kind_of(_largest(queries, d.low, d.high), d.dim)
        b = bounds(queries.astype(kind), d.low.astype(kind), d.high.astype(kind)).astype(np.int64)
        b[:, d.shards == 0] = np.iinfo(np.int64).min
        return b, b.argmax(axis=1)

    def first_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_dim(batches):
            ids, v, d = column(batch, "vec_id").to_numpy(), column(batch, "v"), known.get(dim)
            _, cell = best_cells(d, _matrix(v, dim))
            yield _placed(dim, cell, _hash_part(ids, d.shards[cell] if d else blind_shards, 2), _hash_part(ids, n_parts, 3), 1, ids, v, pa.nulls(len(ids), pa.int64()))

    def later_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To every shard whose cell's bound reaches the floor, but for the one visited first."""
        for dim, batch in _by_dim(batches):
            d = known.get(dim)
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                ids, v, floor = column(some, "vec_id").to_numpy(), column(some, "v"), column(some, "floor")
                b, home = best_cells(d, _matrix(v, dim))
                shards = d.shards if d else np.array([blind_shards])
                own = _hash_part(ids, shards[home], 2)
                part = _hash_part(ids, n_parts, 3)
                reached = floor.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                for c in np.flatnonzero((b >= reached[:, None]).any(axis=0) & (shards > 0)).tolist():
                    for s in range(int(shards[c])):
                        at = np.flatnonzero((b[:, c] >= reached) & ~((home == c) & (own == s)))
                        if len(at):
                            take = pa.array(at)
                            yield _placed(dim, c, s, part[at], 1, ids[at], v.take(take), floor.take(take))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards and their queries, sorted: rows of a shard first, then the queries that pass."""
        key, tree, held = None, None, []
        for batch in batches:
            keys = np.stack([column(batch, c).to_numpy() for c in ("dim", "cell", "shard", "part")], axis=1)
            kinds = column(batch, "kind").to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1])) + 1
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                now = tuple(keys[a].tolist())
                if now != key:
                    key, tree, held = now, None, []
                ids, v = column(batch, "id").slice(a, z - a).to_numpy(), _matrix(column(batch, "v").slice(a, z - a), now[0])
                if kinds[a] == 0:
                    held.append((ids, v))
                    continue
                if tree is None:
                    if not held:
                        continue
                    all_ids, all_v = np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
                    some = enough_copies(all_ids, all_v, k)
                    tree, held = Tree(all_ids[some], all_v[some]), []
                    largest = _largest(tree.vectors)
                floors = column(batch, "floor").slice(a, z - a).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                for q in range(0, len(ids), 2048):
                    mine, queries, floor = ids[q : q + 2048], v[q : q + 2048], floors[q : q + 2048]
                    kind = kind_of(max(largest, _largest(queries)), now[0])
                    if tree.vectors.dtype != kind:
                        tree.vectors, tree.low, tree.high = (x.astype(kind) for x in (tree.vectors, tree.low, tree.high))
                    lowest = np.where(floor == np.iinfo(np.int64).min, np.iinfo(np.int64).min if kind.kind == "i" else -np.inf, floor)
                    who, score, best = tree.search(mine, queries.astype(kind), k, lowest)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[who]), pa.array(best), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])
        del tree, held
        give_back()

    def visited(visits: DataFrame) -> DataFrame:
        shards = rows.select("vec_id", "v", "dim").mapInArrow(indexed, _PLACED)
        n_tasks = max(1, min(10_000, sum(int(d.shards.sum()) for d in known.values()) * n_parts))
        at = ["dim", "cell", "shard", "part"]
        return shards.unionByName(visits).repartition(n_tasks, *at).sortWithinPartitions(*at, "kind").mapInArrow(search, "query_id long, vec_id long, score long")

    first = cut(visited(asked.select("vec_id", "v", "dim").mapInArrow(first_visits, _PLACED)))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    floors = kth.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("score")).alias("floor"))
    rest = visited(asked.join(floors, "vec_id", "left").select("vec_id", "v", "dim", "floor").mapInArrow(later_visits, _PLACED))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
