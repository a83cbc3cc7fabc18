"""Neighbours: joins by distance.

Balls of a stated radius: points get the key of their cubic cell; a query point is sent to
the cells that its ball may touch and joined with them by equality, so that no pair of
distant points is ever made and large cells are split by the skew handling of the join.

The k nearest: space is cut at medians into blocks of about as many points, however they
cluster (the cuts, a few numbers for each block, come from a bounded sample).  Each block
finds its queries' k nearest among its own points, in leaves of a k-d tree.  Only queries
whose ball leaves their block are sent on, once, to the blocks that it touches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..snapshot import ROW, Snapshot
from .columns import column_counts
from .filters import wrapped

XYZ = ("x", "y", "z")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _wrap_cell(c: Column, cells: int | None) -> Column:
    return F.pmod(c, F.lit(cells)) if cells else c


def ball_join(queries: DataFrame, points: DataFrame, radius: float | Column, largest: float, box: float | None = None, cell: float | None = None) -> DataFrame:
    """Pairs of a query and a point at most a radius apart (closed), with d2.

    Both frames have x, y, z.  `radius` may be a column of queries of at most `largest`.
    The queries' other columns are kept with a `q_` prefix, the points' as they are."""
    size = cell or largest or 1.0
    cells = max(1, int(box // size)) if box else None
    if box:
        size = box / cells
    reach = int(largest // size) + 1
    q = queries.withColumn("__r", radius if isinstance(radius, Column) else F.lit(float(radius)))
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], "__r")
    near = lambda c: F.array_distinct(F.transform(F.sequence(_cell(c - F.col("__r"), size), F.least(_cell(c + F.col("__r"), size), _cell(c - F.col("__r"), size) + 2 * reach + 1)), lambda k: _wrap_cell(k, cells)))
    for c in XYZ:
        q = q.withColumn(f"__c{c}", F.explode(near(F.col(f"q_{c}"))))
    p = points.select("*", *[_wrap_cell(_cell(F.col(c), size), cells).alias(f"__c{c}") for c in XYZ])
    d2 = sum(wrapped(F.col(c) - F.col(f"q_{c}"), box) * wrapped(F.col(c) - F.col(f"q_{c}"), box) for c in XYZ)
    out = q.join(p, [f"__c{c}" for c in XYZ]).withColumn("d2", d2)
    return out.where(F.col("d2") <= F.col("__r") * F.col("__r")).drop("__r", *[f"__c{c}" for c in XYZ])


def ball_counts(s: Snapshot, radius: float, block_points: int | None = None) -> DataFrame:
    """Rows within a radius of each row (closed), itself among them.

    No pair of rows is made: each block of rows gets the points that its balls may reach, and
    counts there, once.  These are dealt packed, a block's points for another block as a few
    values, since each point goes to many blocks.  Where points share two coordinates, as on grids, it counts by columns
    (see `columns`), else whole branches of a k-d tree are counted or left out against whole
    branches of balls, and only leaves that a surface cuts compare points.  Rows without
    coordinates have no count.  In a periodic box the radius is less than half a box, else
    pairs are made."""
    box = s.properties.get("boxsize")
    pts = s.df.select(ROW, *[s.col(c).cast("double").alias(c) for c in XYZ])
    if box and 2 * radius >= box:
        hit = ball_join(pts, pts.select(*XYZ), radius, radius, box)
        return hit.groupBy(F.col(f"q_{ROW}").alias(ROW)).agg(F.count(F.lit(1)).alias("n"))
    pts = _placed(pts).select(F.col(ROW).cast("long").alias("id"), *XYZ)
    at = cuts(pts, block_points or min(max(math.ceil(pts.count() / BALL_BLOCKS), BALL_POINTS[0]), BALL_POINTS[1]))
    placed = pts.mapInPandas(_dealt(at, True, None), "id long, x double, y double, z double, block long")
    dealt = placed.repartitionById(at.inner + 1, F.col("block").cast("int")).mapInArrow(_with_reach(at, radius, box), "block int, image int, ids binary, points binary")
    moves = _images(box)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, xyz, image = [], [], [], []
        for batch in batches:
            for k, i, p in zip(*(batch.column(c) for c in ("image", "ids", "points")), strict=True):
                got = unpacked(p.as_buffer())
                if i.is_valid:
                    ids.append(np.frombuffer(i.as_buffer(), np.int64))
                    own.append(got)
                else:
                    xyz.append(got)
                    image.append(np.full(len(got), k.as_py(), np.int8))
        if own:
            q, p, image = np.concatenate(own), np.concatenate(xyz), np.concatenate(image)
            own.clear()
            xyz.clear()
            n = sum((_counted_at_once(q, p[rows], moves[image[rows]], radius) for rows in _slabs(p, AT_ONCE)), np.zeros(len(q), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(n)], [ROW, "n"])

    # a block is a partition
    return dealt.repartitionById(at.inner + 1, F.col("block")).mapInArrow(count, f"{ROW} long, n long")


def _counted_at_once(q: np.ndarray, p: np.ndarray, move: np.ndarray, radius: float) -> np.ndarray:
    n = column_counts(q, p, move, radius, COLUMN_POINTS)
    return counts_within(q, p, radius, move) if n is None else n


def _slabs(p: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of points in pieces of about `most` at most, cut between values of the axis that
    has the fewest, so that columns stay whole."""
    if len(p) <= most:
        return [np.arange(len(p))]
    axis = np.argmin([len(np.unique(p[:, c])) for c in range(3)])
    order = np.argsort(p[:, axis], kind="stable")
    v = p[order, axis]
    # where values begin, and of these the ends that are taken
    begin = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v))
    ends = [0]
    while ends[-1] < len(v):
        ends.append(int(max(begin[np.searchsorted(begin, ends[-1] + most, "right") - 1], begin[np.searchsorted(begin, ends[-1], "right")])))
    return [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def packed(xyz: np.ndarray) -> bytes:
    """Points as bytes, without loss: each axis as its values and their numbers, if that is
    shorter, as steps from point to point; points in the order of columns give few bytes."""
    head, parts = [len(xyz)], []
    for v in xyz.T:
        values, code = np.unique(v, return_inverse=True)
        code = code.astype(np.min_scalar_type(max(len(values) - 1, 0)))
        short = 8 * len(values) + code.nbytes < 8 * len(v)
        head.append(len(values) if short else 0)
        code = np.diff(code, prepend=code[:1] * 0) if short else np.ascontiguousarray(v)
        parts += [values.tobytes()] * short + [code.view(np.uint8).reshape(len(v), code.itemsize).T.tobytes()]
    raw = np.array(head, np.int64).tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(packed_: pa.Buffer) -> np.ndarray:
    """The points of `packed`."""
    raw = memoryview(pa.decompress(packed_[8:], int.from_bytes(packed_[:8].to_pybytes(), "little"), "zstd"))
    n, *sizes = np.frombuffer(raw[:32], np.int64).tolist()
    out, at = np.empty((n, 3)), 32
    for c, size in enumerate(sizes):
        kind = np.min_scalar_type(size - 1) if size else np.dtype(float)
        values = np.frombuffer(raw[at : at + 8 * size])
        at += 8 * size
        code = np.frombuffer(raw[at : at + n * kind.itemsize], np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel()
        at += n * kind.itemsize
        out[:, c] = values[np.cumsum(code, dtype=kind)] if size else code
    return out


def _with_reach(at: Cuts, radius: float, box: float | None):
    """The rows of a block, packed: as its queries (with ids), and as points for the blocks that
    they are within reach of, for each image of a box."""
    moves = _images(box)
    reach = radius * (1 + 1e-9) + 2.0**-48 * float(max(np.abs(at.lo).max(), np.abs(at.hi).max()) + (box or 0.0))

    def rows(block: int, image: int, xyz: np.ndarray, ids: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(xyz), PACKED):
            part = slice(k, k + PACKED)
            row = (block, image, None if ids is None else ids[part].tobytes(), packed(xyz[part]))
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "image", "ids", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        cols = {n: c.to_numpy() for n, c in zip(held[0].schema.names, pa.Table.from_batches(held).columns, strict=True)}
        xyz = _places(cols)
        # in the order of columns, along the axis with the most values
        axes = np.argsort([len(np.unique(v)) for v in xyz.T], kind="stable")
        order = np.lexsort(xyz.T[axes[::-1]])
        xyz = xyz[order]
        yield from rows(int(cols["block"][0]), -1, xyz, cols["id"][order])
        for k, move in enumerate(moves):
            row, block = at.touched(xyz + move, np.full(len(xyz), reach))
            by_block = np.lexsort((row, block))
            row, block = row[by_block], block[by_block]
            for to, first, last in zip(*(v.tolist() for v in _runs(block)), strict=True):
                yield from rows(to, k, xyz[row[first:last]])

    return run


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted column, and where each begins and ends."""
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
    return v[first], first, np.append(first[1:], len(v))[: len(first)]


def _images(box: float | None) -> np.ndarray:
    """Moves by one box length at most along each axis, none first."""
    return np.array([(a, b, c) for a in (0, -1, 1) for b in (0, -1, 1) for c in (0, -1, 1)], float) * box if box else np.zeros((1, 3))


@dataclass(frozen=True)
class Tree:
    """Points in the order of a balanced k-d tree: node k of level l holds the points
    from (k n >> l) up to (k + 1) n >> l, within lo[l][k] and hi[l][k]."""

    order: np.ndarray
    lo: list[np.ndarray]
    hi: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.lo) - 1

    def begin(self, level: int, node: np.ndarray) -> np.ndarray:
        return node * len(self.order) >> level


def tree(xyz: np.ndarray, leaf: int) -> Tree:
    """Cut at medians along the widest axis until nodes have at most `leaf` points."""
    n = len(xyz)
    depth, order = max(0, math.ceil(math.log2(n / leaf))), np.arange(n)
    for level in range(depth):
        for k in range(1 << level):
            a, m, b = k * n >> level, (2 * k + 1) * n >> level + 1, (k + 1) * n >> level
            rows = order[a:b]
            part = xyz[rows, np.ptp(xyz[rows], axis=0).argmax()]
            order[a:b] = rows[np.argpartition(part, m - a)]
    first = [np.arange(1 << level) * n >> level for level in range(depth + 1)]
    return Tree(order, *[[f.reduceat(xyz[order], at, axis=0) for at in first] for f in (np.minimum, np.maximum)])


def counts_within(q: np.ndarray, p: np.ndarray, r: float, move: np.ndarray | None = None) -> np.ndarray:
    """How many points p, moved if they are images, lie at most r from each point q."""
    out = np.zeros(len(q), np.int64)
    if not len(q) or not len(p):
        return out
    moved = move is not None and move.any()
    a, b, r2 = tree(q, LEAF), tree(p + move if moved else p, LEAF), r * r
    # what whole branches add, where it begins and ends
    more = np.zeros(len(q) + 1, np.int64)
    i = j = np.zeros(1, np.int64)
    last = max(a.depth, b.depth)
    for step in range(last + 1):
        u, v = min(step, a.depth), min(step, b.depth)
        gap = np.maximum(np.maximum(b.lo[v][j] - a.hi[u][i], a.lo[u][i] - b.hi[v][j]), 0)
        far = np.maximum(b.hi[v][j] - a.lo[u][i], a.hi[u][i] - b.lo[v][j])
        near2, far2 = ((d * d) @ np.ones(3) for d in (gap, far))
        inside = far2 <= r2 * (1 - 1e-12)
        size = b.begin(v, j[inside] + 1) - b.begin(v, j[inside])
        np.add.at(more, a.begin(u, i[inside]), size)
        np.subtract.at(more, a.begin(u, i[inside] + 1), size)
        open_ = ~inside & (near2 <= r2 * (1 + 1e-12))
        i, j = i[open_], j[open_]
        if step < a.depth:
            i, j = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
        if step < b.depth:
            i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
    x, y, way = q[a.order], p[b.order], move[b.order] if moved else None
    span = np.arange(LEAF)
    for k in range(0, len(i), 256):
        m, n = (t.begin(t.depth, node[k : k + 256])[:, None] + span for t, node in ((a, i), (b, j)))
        there = [at < t.begin(t.depth, node[k : k + 256] + 1)[:, None] for t, node, at in ((a, i, m), (b, j, n))]
        m, n = np.minimum(m, len(x) - 1), np.minimum(n, len(y) - 1)
        d = [y[n, c][:, None, :] - x[m, c][:, :, None] + (way[n, c][:, None, :] if moved else 0.0) for c in range(3)]
        hit = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= r2) & there[0][:, :, None] & there[1][:, None, :]
        np.add.at(out, m[there[0]], hit.sum(axis=2)[there[0]])
    result = np.empty_like(out)
    result[a.order] = out + np.cumsum(more[:-1])
    return result


def in_sphere(s: Snapshot, centre, radius: float) -> Snapshot:
    """Rows at most a radius from a point (closed, unlike the filter)."""
    box = s.properties.get("boxsize")
    d = [wrapped(c - F.lit(float(v)), box) for c, v in zip(s.vector("pos"), centre, strict=True)]
    return s.where(sum(v * v for v in d) <= float(radius) ** 2)


#: Points of a block, sampled points for each block, and points of a leaf within a block.
BLOCK_POINTS = 20_000
MAX_BLOCKS = 1 << 16
SAMPLED = 64
LEAF = 64
#: Blocks of rows whose balls are counted, least and most points of one, and the points that a column has on average to be worth a look-up.
BALL_BLOCKS = 128
BALL_POINTS = (4_000, 250_000)
COLUMN_POINTS = 1.2
#: Points of a block that are counted at once, and points that are packed as one value, at most.
AT_ONCE = 1 << 21
PACKED = 1 << 17


@dataclass(frozen=True)
class Cuts:
    """Space cut into 2**depth blocks: node i is cut at `at[i]` along `axis[i]` into nodes
    2 i + 1 (below) and 2 i + 2; lo and hi bound all points."""

    axis: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @property
    def inner(self) -> int:
        return len(self.axis)

    def block(self, xyz: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(xyz), np.int64), np.arange(len(xyz))
        while self.inner and len(node) and node[0] < self.inner:
            node = 2 * node + 1 + (xyz[rows, self.axis[node]] >= self.at[node])
        return node - self.inner

    def touched(self, xyz: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which balls touch which blocks: numbers of balls and of blocks."""
        far = np.maximum(np.maximum(self.lo - xyz, xyz - self.hi), 0)
        ball = np.flatnonzero((far * far).sum(axis=1) <= r * r)
        node = np.zeros(len(ball), np.int64)
        while self.inner and len(node) and node[0] < self.inner:
            x, cut = xyz[ball, self.axis[node]], self.at[node]
            below, above = x - r[ball] <= cut, x + r[ball] >= cut
            ball, node = np.concatenate([ball[below], ball[above]]), np.concatenate([2 * node[below] + 1, 2 * node[above] + 2])
        return ball, node - self.inner


def cuts(points: DataFrame, block_points: int = BLOCK_POINTS) -> Cuts:
    """Cuts at the medians of a sample of at most 2 x SAMPLED points for each block, along
    the axis on which a block's are spread most."""
    row = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in XYZ]).first()
    lo, hi = (np.array([row[f"{f}_{c}"] if row["n"] else 0.0 for c in XYZ], float) for f in ("min", "max"))
    depth = min(math.ceil(math.log2(max(1, row["n"] / block_points))), int(math.log2(MAX_BLOCKS)))
    most = SAMPLED << depth
    got = points.select(*XYZ).sample(min(1.0, most / max(1, row["n"])), seed=7).limit(2 * most).toPandas().to_numpy(float) if depth else np.zeros((0, 3))
    axis, at, parts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), [got]
    for node in range(len(axis)):
        part = parts[node]
        if len(part):
            axis[node] = np.ptp(part, axis=0).argmax()
            at[node] = np.median(part[:, axis[node]])
        above = part[:, axis[node]] >= at[node]
        parts += [part[~above], part[above]]
    return Cuts(axis, at, lo, hi)


def _leaves(xyz: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of a k-d tree's leaves, cut at medians along the widest axis."""
    todo, out = [np.arange(len(xyz))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        axis, half = np.ptp(xyz[rows], axis=0).argmax(), len(rows) // 2
        order = rows[np.argpartition(xyz[rows, axis], half)]
        todo += [order[:half], order[half:]]
    return [r for r in out if len(r)]


def nearest(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest points p of each query q (at most as far as `within`): numbers of
    queries, ids of points and squared distances; ties by the least id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # of points at one place no query gets more than the k of least ids
    place = np.lexsort((ids, *p.T))
    new = np.ones(len(p), bool)
    new[1:] = (p[place[1:]] != p[place[:-1]]).any(axis=1)
    at = np.arange(len(p))
    keep = place[at - np.maximum.accumulate(np.where(new, at, 0)) < k]
    p, ids = p[keep], ids[keep]
    leaves = _leaves(p, LEAF)
    low, high = (np.array([f(p[r], axis=0) for r in leaves]).reshape(-1, 3) for f in (np.min, np.max))
    count = np.array([len(r) for r in leaves], np.int64)
    for mine in _leaves(q, LEAF) if leaves else []:
        x = q[mine]
        gap = np.maximum(np.maximum(low - x.max(axis=0), x.min(axis=0) - high), 0)
        gap = (gap * gap).sum(axis=1)
        order = np.argsort(gap, kind="stable")
        limit = np.full(len(mine), np.inf) if within is None else within[mine] ** 2
        first = int(np.searchsorted(np.cumsum(count[order]), min(k, count.sum()))) + 1
        near = _squares(x, p, np.concatenate([leaves[i] for i in order[:first]]))
        if near.shape[1] >= k:
            limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
        rows = np.concatenate([leaves[i] for i in order[: int(np.searchsorted(gap[order], limit.max(), "right"))]] or [np.zeros(0, np.int64)])
        d2 = _squares(x, p, rows)
        if len(rows) > k:
            limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(d2 <= limit[:, None])
        found = np.lexsort((ids[rows[j]], d2[i, j], i))
        i, j = i[found], j[found]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < k
        out.append((mine[i[top]], ids[rows[j[top]]], d2[i[top], j[top]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _squares(x: np.ndarray, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of all x to some p."""
    d = [x[:, None, c] - p[None, rows, c] for c in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _dealt(at: Cuts, own: bool, box: float | None, done: bool = True):
    """Rows with their block; balls with all blocks that they touch (but their own, if that
    is done), as images moved by one box length at most."""
    shifts = _images(box)

    def run(batches):
        for pdf in batches:
            xyz = pdf[list(XYZ)].to_numpy(float)
            if own:
                yield pdf.assign(block=at.block(xyz))
                continue
            for s in shifts:
                ball, block = at.touched(xyz + s, pdf["r"].to_numpy(float))
                part = pdf.iloc[ball].assign(block=block, **{c: xyz[ball, n] + s[n] for n, c in enumerate(XYZ)})
                yield part if s.any() or not done else part[at.block(xyz[ball]) != block]

    return run


def _row_lists(rows: int, i: np.ndarray, **values: np.ndarray) -> dict[str, pa.Array]:
    """Values as one list for each of so many rows; i are the rows, ascending."""
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=rows))]).astype(np.int32))
    return {k: pa.ListArray.from_arrays(ends, pa.array(v)) for k, v in values.items()}


def _sides(t: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The queries and the points of a group, by column."""
    cols = {n: t[n].to_numpy() for n in t.column_names}
    return tuple({n: v[cols["side"] == k] for n, v in cols.items()} for k in (0, 1))


def _places(side: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([side[c] for c in XYZ], axis=1).astype(float)


def _found(q: dict, p: dict, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`nearest` of two sides in the order of queries: numbers of queries and of points (by
    the order of ids), d2."""
    by_id = np.argsort(p["id"], kind="stable")
    i, j, d2 = nearest(_places(q), _places(p)[by_id], np.arange(len(by_id)), k, within)
    rows = np.argsort(i, kind="stable")
    return i[rows], by_id[j[rows]], d2[rows]


def _first_round(at: Cuts, k: int, box: float | None):
    def run(t: pa.Table) -> pa.Table:
        q, p = _sides(t)
        xyz, n = _places(q), len(q["id"])
        i, j, d2 = _found(q, p, k)
        r = np.full(n, np.inf)
        full = np.bincount(i, minlength=n) >= k
        last = np.zeros(n)
        np.maximum.at(last, i, d2)
        r[full] = np.sqrt(last[full]) * (1 + 1e-9)
        # which balls stay within the block: those that touch no other, and no image's
        open_ = np.zeros(n, bool)
        for pdf in _dealt(at, False, box)(iter([pd.DataFrame({"n": np.arange(n), "r": r, **{c: xyz[:, m] for m, c in enumerate(XYZ)}})])):
            open_[pdf["n"].to_numpy()] = True
        lists = _row_lists(n, i, d2=d2, neighbour=p["id"][j], w=p["w"][j])
        return pa.table({"id": q["id"], **lists, "open": open_, "r": r, **{c: xyz[:, m] for m, c in enumerate(XYZ)}})

    return run


def _second_round(k: int):
    def run(t: pa.Table) -> pa.Table:
        q, p = _sides(t)
        i, j, d2 = _found(q, p, k, q["r"])
        return pa.table({"id": q["id"], **_row_lists(len(q["id"]), i, d2=d2, neighbour=p["id"][j], w=p["w"][j])})

    return run


_LISTS = "d2 array<double>, neighbour array<long>, w array<double>"


def near_lists(queries: DataFrame, points: DataFrame, k: int, id_q: str = ROW, id_p: str = ROW, box: float | None = None, block_points: int = BLOCK_POINTS, weight: str | None = None) -> DataFrame:
    """One row for each query: id and `near`, its k nearest points (d2, neighbour, w: a
    column of the points), ascending; checkpointed.  What is moved grows with the rows: only
    the lists of queries whose ball leaves their block are shuffled."""
    place = lambda df, name, side, w: _placed(df).select(F.col(name).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in XYZ], F.lit(side).alias("side"), F.lit(0.0).alias("r"), w.alias("w"))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(0.0)
    q, p = place(queries, id_q, 0, F.lit(0.0)), place(points, id_p, 1, w)
    at = cuts(p, block_points)
    cols = "id long, x double, y double, z double, side int, r double, w double"
    dealt = q.unionByName(p).mapInPandas(_dealt(at, True, None), f"{cols}, block long")
    first = checkpointed(dealt.groupBy("block").applyInArrow(_first_round(at, k, box), f"id long, {_LISTS}, open boolean, r double, x double, y double, z double"))
    zipped = F.arrays_zip("d2", "neighbour", "w").alias("near")
    more = first.where("open").select("id", *XYZ, F.lit(0).alias("side"), "r", F.lit(0.0).alias("w")).mapInPandas(_dealt(at, False, box), f"{cols}, block long")
    held = p.mapInPandas(_dealt(at, True, None), f"{cols}, block long")
    second = more.unionByName(held).groupBy("block").applyInArrow(_second_round(k), f"id long, {_LISTS}")
    both = first.where("open").select("id", zipped).unionByName(second.select("id", zipped))
    if box:
        # of a point's images the nearest counts
        each = both.select("id", F.explode("near").alias("n")).groupBy("id", F.col("n.neighbour").alias("neighbour")).agg(F.min("n.d2").alias("d2"), F.first("n.w").alias("w"))
        both = each.groupBy("id").agg(F.collect_list(F.struct("d2", "neighbour", "w")).alias("near"))
    else:
        both = both.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    merged = both.select("id", F.slice(F.sort_array("near"), 1, k).alias("near"))
    return first.where("not open").select("id", zipped).unionByName(merged).withColumnRenamed("id", id_q)


def knn(queries: DataFrame, points: DataFrame, k: int, id_q: str = ROW, id_p: str = ROW, box: float | None = None, block_points: int = BLOCK_POINTS) -> DataFrame:
    """The k nearest points of each query: id_q, id_p (as `neighbour`), d2 and rank from 1;
    ties by the least id.  A query that is a point has itself as its first neighbour.

    Ids are integers.  Queries that can't have k points get those there are; rows without
    coordinates are neither queries nor points.  Points at one and the same place stay in
    one block."""
    return _exploded(near_lists(queries, points, k, id_q, id_p, box, block_points), id_q)


def _exploded(lists: DataFrame, name: str = ROW) -> DataFrame:
    each = lists.select(name, F.posexplode("near").alias("rank", "n"))
    return each.select(name, F.col("n.neighbour").alias("neighbour"), F.col("n.d2").alias("d2"), (F.col("rank") + 1).alias("rank"))


def kernel_sums(rows: DataFrame, k: int, box: float | None, values: list[str], term: Callable[..., dict[str, np.ndarray]], out: list[str], block_points: int = BLOCK_POINTS) -> DataFrame:
    """Sums over the points within the radius 2 h of each row (at most k): pidx and `out`.

    `rows` has pidx, x, y, z, h and columns of values.  Balls go to the blocks that they
    touch; `term` takes d2, h, the way from the row to the point (three columns), and the
    values of the points and of the rows, and gives a summand for each pair, which is summed
    in its task: pairs are never moved."""
    rows = _placed(rows)
    at = cuts(rows, block_points)
    cols = ["id", *XYZ, "side", "r", *values]
    kind = ", ".join(f"{c} {'long' if c == 'id' else 'int' if c == 'side' else 'double'}" for c in cols) + ", block long"
    side = lambda n: rows.select(F.col(ROW).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in XYZ], F.lit(n).alias("side"), (2 * F.col("h") * (1 + 1e-9)).alias("r"), *[F.col(v).cast("double").alias(v) for v in values])

    def run(t: pa.Table) -> pa.Table:
        q, p = _sides(t)
        i, j, d2 = _found(q, p, k, q["r"])
        d = [p[c][j] - q[c][i] for c in XYZ]
        if box:
            # the nearest image of a point
            near = np.all([np.abs(v) <= box / 2 for v in d], axis=0)
            i, j, d2, d = i[near], j[near], d2[near], [v[near] for v in d]
        with np.errstate(all="ignore"):
            terms = term(d2, (q["r"] / (2 * (1 + 1e-9)))[i], d, {v: p[v][j] for v in values}, {v: q[v][i] for v in values})
        return pa.table({"id": q["id"], **{c: np.bincount(i, terms[c], len(q["id"])) for c in out}})

    balls = side(0).mapInPandas(_dealt(at, False, box, False), kind)
    held = side(1).mapInPandas(_dealt(at, True, None), kind)
    parts = balls.unionByName(held).groupBy("block").applyInArrow(run, "id long, " + ", ".join(f"{c} double" for c in out))
    return parts.groupBy(F.col("id").alias(ROW)).agg(*[F.sum(c).alias(c) for c in out])


def _placed(df: DataFrame) -> DataFrame:
    """Rows with finite coordinates."""
    far = F.lit(float("inf"))
    return df.where((F.abs("x") < far) & (F.abs("y") < far) & (F.abs("z") < far))


def smoothing_lists(s: Snapshot, k: int = 32) -> DataFrame:
    """pidx and the list `near` of the k nearest rows of all rows, with their mass as w."""
    pts = s.df.select(ROW, *[s.col(c).alias(c) for c in XYZ], *([s.col("mass").alias("m")] if s.has_key("mass") else []))
    return near_lists(pts, pts, k, box=s.properties.get("boxsize"), weight="m" if "m" in pts.columns else None)


def smoothing_neighbours(s: Snapshot, k: int = 32) -> DataFrame:
    """The k nearest neighbours of all rows among themselves, with mass and other columns of
    the neighbours left to join by `neighbour`."""
    return _exploded(smoothing_lists(s, k))
