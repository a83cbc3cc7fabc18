"""Gravity by direct summation at stated points.

The points are few and are broadcast against the particles once; the sums are partial
aggregates, so that each task sends one row for each point."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..snapshot import Snapshot
from .neighbours import tree
from .profile import gravity_constant

MAX_POINTS = 100_000


def direct(s: Snapshot, points: DataFrame | Sequence[Sequence[float]], eps: float | Column | None = None) -> DataFrame:
    """Potential and acceleration at points (point, px, py, pz): phi, ax, ay, az.

    The softening is the argument, else the column eps, else the property eps, else 0.
    More than MAX_POINTS points are summed in blocks of that size."""
    if not isinstance(points, DataFrame):
        points = s.spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point int, px double, py double, pz double")
    e = eps if isinstance(eps, Column) else F.lit(float(eps)) if eps is not None else s.col("eps") if s.has_key("eps") else F.lit(float(s.properties.get("eps", 0.0)))
    n = points.count()
    if n <= MAX_POINTS:
        return _direct(s, points, e)
    blocks = math.ceil(n / MAX_POINTS)
    key = F.pmod(F.xxhash64("point"), F.lit(blocks))
    out = None
    for k in range(blocks):
        part = _direct(s, points.where(key == k), e)
        out = part if out is None else out.unionByName(part)
    return out


def _direct(s: Snapshot, points: DataFrame, e: Column) -> DataFrame:
    x, y, z = s.vector("pos")
    src = s.df.select(x.alias("sx"), y.alias("sy"), z.alias("sz"), s.col("mass").alias("sm"), (e * e).alias("e2"))
    pairs = src.join(F.broadcast(points))
    d = [F.col(f"p{c}") - F.col(f"s{c}") for c in "xyz"]
    r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + F.col("e2")
    # on an unsoftened particle the potential is infinite and the force undefined (NaN)
    inv = F.when(r2 == 0, F.lit(math.inf)).otherwise(1 / F.sqrt(r2))
    g = gravity_constant(s)
    sums = pairs.withColumn("inv", inv).groupBy("point").agg(F.sum(F.col("sm") * F.col("inv")).alias("p"), *[F.sum(F.col("sm") * v * F.col("inv") * F.col("inv") * F.col("inv")).alias(f"f{c}") for c, v in zip("xyz", d, strict=True)])
    out = F.broadcast(sums)
    got = points.select("point").join(out, "point", "left")
    return got.select("point", (-g * F.coalesce("p", F.lit(0.0))).alias("phi"), *[(-g * F.coalesce(f"f{c}", F.lit(0.0))).alias(f"a{c}") for c in "xyz"])


def _ring(radii: Sequence[float]) -> list[tuple[float, float, float]]:
    return [(r * a, r * b, 0.0) for r in radii for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1))]


def rotation_curve(s: Snapshot, radii: Sequence[float], eps: float | None = None) -> DataFrame:
    """Circular speed in the plane z = 0: from the mean inward pull at four points of each
    ring; 0 where the pull points outward."""
    at = _ring(radii)
    got = direct(s, at, eps)
    pts = s.spark.createDataFrame([(i, i // 4, *p) for i, p in enumerate(at)], "point int, k int, px double, py double, pz double")
    inward = -(F.col("ax") * F.col("px") + F.col("ay") * F.col("py") + F.col("az") * F.col("pz"))
    both = got.join(F.broadcast(pts), "point").groupBy("k").agg(F.avg(inward).alias("v2"))
    rs = s.spark.createDataFrame([(i, float(r)) for i, r in enumerate(radii)], "k int, r double")
    return both.join(F.broadcast(rs), "k").select("k", "r", F.sqrt(F.greatest("v2", F.lit(0.0))).alias("v_circ"))


def midplane_potential(s: Snapshot, radii: Sequence[float], eps: float | None = None) -> DataFrame:
    """Mean potential at four points of each ring."""
    got = direct(s, _ring(radii), eps)
    rs = s.spark.createDataFrame([(i, float(r)) for i, r in enumerate(radii)], "k int, r double")
    return got.groupBy(F.floor(F.col("point") / 4).cast("int").alias("k")).agg(F.avg("phi").alias("pot")).join(F.broadcast(rs), "k").select("k", "r", "pot")


#: Rows of a block at most, whatever their number, and blocks that few rows are cut into at most; a pair of blocks is a unit of work.
MOST_ROWS = 1 << 18
FEW_BLOCKS = 16
#: Rows of a block whose sums are added up as one piece.
PIECE = 4096
#: Targets and sources of a tile, whose pairs stay in a core's cache.
TILE = (16, 2048)
#: Rows of a square tile, and the relative error of a squared distance that is borne from a product of matrices.
SQUARE = 256
BORNE = 1e-12


def all_direct(s: Snapshot, eps: float | None = None, block: int = 4096, force: bool = True) -> DataFrame:
    """Potential and acceleration of every row from every row: pidx, phi, ax, ay, az; without
    `force` only the potential is summed.

    What is asked for has all pairs.  Rows are packed into blocks of at most about MOST_ROWS (of
    `block` at least, if there are many), which are stored once; a pair of blocks is a unit of
    work that reads the two, so that no task holds more than two blocks and no row is copied
    for each block.  Rows without coordinates have nulls."""
    from ..snapshot import ROW

    x, y, z = s.vector("pos")
    e = F.lit(float(eps)) if eps is not None else s.col("eps") if s.has_key("eps") else F.lit(float(s.properties.get("eps", 0.0)))
    n = s.df.count()
    blocks = max(1, min(FEW_BLOCKS, math.ceil(n / block)), math.ceil(n / MOST_ROWS))
    rows = s.df.select(F.col(ROW).cast("long").alias(ROW), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), s.col("mass").cast("double").alias("m"), (e * e).cast("double").alias("e2"), F.pmod(F.xxhash64(ROW), F.lit(blocks)).cast("int").alias("b"))
    placed = rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    # rows that are no sources weigh nothing
    source = F.col("m").isNotNull() & F.col("e2").isNotNull()
    placed = placed.select(ROW, "x", "y", "z", F.when(source, F.col("m")).otherwise(0.0).alias("m"), F.coalesce("e2", F.lit(0.0)).alias("e2"), "b")
    packed = checkpointed(placed.repartitionById(blocks, F.col("b")).mapInArrow(_packed, "b int, rows binary"))
    pairs = packed.toDF("i", "a").hint("shuffle_replicate_nl").join(packed.toDF("j", "c"), F.col("i") <= F.col("j"))
    out = ["phi", "ax", "ay", "az"] if force else ["phi"]

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, a, c in zip(*(batch.column(k) for k in "ijac"), strict=True):
                one, two = (np.frombuffer(v.as_buffer()).reshape(6, -1) for v in (a, c))
                to, back = _both(one, two, force)
                yield from _pieces(i.as_py(), j.as_py(), to, one[0].view(np.int64) if i == j else None)
                if i != j:
                    yield from _pieces(j.as_py(), i.as_py(), back)

    def total(t: pa.Table) -> pa.Table:
        t = t.sort_by("other")
        ids = next(v.as_buffer() for v in t["ids"] if v.is_valid)
        sums = sum(np.frombuffer(v.as_buffer()) for v in t["sums"])
        return pa.table({ROW: np.frombuffer(ids, np.int64), **dict(zip(out, sums.reshape(len(out), -1), strict=True))})

    g = gravity_constant(s)
    parts = pairs.mapInArrow(pull, "b int, piece int, other int, ids binary, sums binary")
    sums = parts.groupBy("b", "piece").applyInArrow(total, f"{ROW} long, " + ", ".join(f"{c} double" for c in out))
    none = rows.where("x IS NULL OR y IS NULL OR z IS NULL").select(ROW, *[F.lit(None).cast("double").alias(c) for c in out])
    return sums.select(ROW, *[(-g * F.col(c)).alias(c) for c in out]).unionByName(none)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, which is a block, as one value: ids and five columns of
    numbers, near ones together."""
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        cols = np.stack([t.column(0).to_numpy().view(float), *(t.column(k).to_numpy() for k in range(1, 6))])
        cols = cols[:, tree(cols[1:4].T, SQUARE).order]
        yield pa.RecordBatch.from_arrays([t.column("b")[:1].combine_chunks(), pa.array([cols.tobytes()], pa.binary())], ["b", "rows"])


def _pieces(b: int, other: int, sums: np.ndarray, ids: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for k in range(0, sums.shape[1], PIECE):
        part = slice(k, k + PIECE)
        row = {"b": b, "piece": k // PIECE, "other": other, "ids": None if ids is None else ids[part].tobytes(), "sums": sums[:, part].tobytes()}
        kinds = {"b": pa.int32(), "piece": pa.int32(), "other": pa.int32(), "ids": pa.binary(), "sums": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array([row[c]], kind) for c, kind in kinds.items()], list(kinds))


def _both(a: np.ndarray, b: np.ndarray, force: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums at the rows of a from b, and at those of b from a."""
    e2 = b[5, 0]
    if not force and (a[5] == e2).all() and (b[5] == e2).all() and np.isfinite(a[1:4]).all() and np.isfinite(b[1:4]).all():
        return tuple(v[None] for v in _potentials(a[1:4], b[1:4], a[4], b[4], e2))
    return _pull(a[1:4], b[1:4], b[4], b[5], force), _pull(b[1:4], a[1:4], a[4], a[5], force)


def _tiles(n: int) -> np.ndarray:
    """Where the leaves of a `tree` of n rows begin and end."""
    depth = max(0, math.ceil(math.log2(n / SQUARE)))
    return np.arange((1 << depth) + 1) * n >> depth


def _potentials(a: np.ndarray, b: np.ndarray, ma: np.ndarray, mb: np.ndarray, e2: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of m / r at points a from b and at b from a, each pair's r found once; nothing
    from a source at distance 0.

    Squared distances come from a product of matrices.  Those so small that its rounding could
    be more than BORNE of them are made from differences; far tiles have none."""
    lo, hi = (f([f(p, axis=1) for p in (a, b)], axis=0) for f in (np.min, np.max))
    mid = ((lo + hi) / 2)[:, None]
    u, v = a - mid, b - mid
    u2, v2 = (u * u).sum(axis=0), (v * v).sum(axis=0)
    small = 2.0**-50 * (math.sqrt(u2.max()) + math.sqrt(v2.max())) ** 2 / BORNE
    left = np.stack([*u, u2, np.ones(len(u2))], axis=1)
    right = np.stack([*(-2 * v), np.ones(len(v2)), v2 + e2])
    ea, eb = _tiles(len(u2)), _tiles(len(v2))
    low, high = ([f.reduceat(p, e[:-1], axis=1) for p, e in ((a, ea), (b, eb))] for f in (np.minimum, np.maximum))
    out, back, held = np.zeros(len(u2)), np.zeros(len(v2)), np.empty(SQUARE * SQUARE)
    for k, (k0, k1) in enumerate(zip(ea[:-1].tolist(), ea[1:].tolist(), strict=True)):
        gap = np.maximum(np.maximum(low[1] - high[0][:, k : k + 1], low[0][:, k : k + 1] - high[1]), 0)
        close = ((gap * gap).sum(axis=0) * (1 - 1e-9) + e2 <= small * (1 + 1e-9)).tolist()
        p, m = left[k0:k1], ma[k0:k1]
        for n0, n1, near in zip(eb[:-1].tolist(), eb[1:].tolist(), close, strict=True):
            r = held[: (k1 - k0) * (n1 - n0)].reshape(k1 - k0, n1 - n0)
            np.matmul(p, right[:, n0:n1], out=r)
            if near:
                flat = r.reshape(-1)
                at = np.flatnonzero(flat <= small)
                i, j = np.divmod(at, n1 - n0)
                d = [a[c, k0 + i] - b[c, n0 + j] for c in range(3)]
                exact = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + e2
                exact[exact == 0] = np.inf
                flat[at] = exact
            np.sqrt(r, out=r)
            np.divide(1.0, r, out=r)
            out[k0:k1] += r @ mb[n0:n1]
            back[n0:n1] += m @ r
    return out, back


def _pull(to: np.ndarray, src: np.ndarray, m: np.ndarray, e2: np.ndarray, force: bool) -> np.ndarray:
    """Sums of m / r and of m d / r^3 at points; nothing from a source at distance 0."""
    out = np.zeros((4 if force else 1, to.shape[1]))
    rows, width = TILE
    d, r2, sq = np.empty((3, rows, width)), np.empty((rows, width)), np.empty((rows, width))
    hard = not len(e2) or e2.min() <= 0
    for k in range(0, to.shape[1], rows):
        p = to[:, k : k + rows]
        for n in range(0, src.shape[1], width):
            q, w = src[:, n : n + width], m[n : n + width]
            at = np.s_[: p.shape[1], : q.shape[1]]
            r, t = r2[at], sq[at]
            for c in range(3):
                v = np.subtract(p[c][:, None], q[c], out=d[c][at])
                np.multiply(v, v, out=r if c == 0 else t)
                if c:
                    r += t
            r += e2[n : n + width]
            np.sqrt(r, out=r)
            with np.errstate(divide="ignore"):
                np.divide(1.0, r, out=r)
            if hard:
                r[np.isinf(r)] = 0.0
            out[0, k : k + rows] += r @ w
            if force:
                np.multiply(r, r, out=t)
                t *= r
                t *= w
                for c in range(3):
                    out[c + 1, k : k + rows] += np.einsum("ij,ij->i", t, d[c][at])
    return out
