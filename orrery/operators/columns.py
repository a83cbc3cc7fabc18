"""Balls counted by columns: points that share two coordinates are one sorted list.

A ball cuts a column in one run, so that a query costs two look-ups for each column that its
ball touches, however many points they hold.  A look-up finds the end of a run in a table of
bins; in a bin that holds points it goes on by bisection.  Ends that rounding could move are
found with the very comparison that all pairs would be tried with."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of the table for each point, entries of a matrix of queries and columns, and ends that are bisected at once.
BINS = 20
MATRIX = 1 << 15
AT_ONCE = 1 << 16
#: A column is cut by look-up if half its run is longer than this part of the radius, else by bisection.
GRAZED = 1e-3


@dataclass(frozen=True)
class Columns:
    """Points p, each moved by so many lengths of a box, in columns along `axis`: column k
    holds points begin[k] up to end[k], ascending.  Columns are ordered by place."""

    axis: int
    others: tuple[int, int]
    p: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def count(self) -> int:
        return len(self.begin)


def columns(p: np.ndarray, move: np.ndarray, full: float = 0.0) -> Columns | None:
    """Columns along the axis with the most values; points of different images share none.
    None if a column has fewer than `full` points on average."""
    values = [np.unique(p[:, c]) for c in range(3)]
    c, b, axis = np.argsort([len(v) for v in values], kind="stable").tolist()
    key = np.searchsorted(values[c], p[:, c]) * len(values[b]) + np.searchsorted(values[b], p[:, b])
    if move.any():
        key = key * 27 + (np.sign(move) + 1).astype(np.int64) @ (9, 3, 1)
    if len(p) < full * len(np.unique(key)):
        return None
    order = np.lexsort((p[:, axis], key))
    p, move, key = p[order], move[order], key[order]
    edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(p)]])
    first = edges[:-1]
    by_place = np.lexsort((p[first, b] + move[first, b], p[first, c] + move[first, c]))
    return Columns(axis, (b, c), p, move, first[by_place], edges[1:][by_place])


@dataclass(frozen=True)
class Bins:
    """For each column and bin twice the number of the column's points below the bin, and 1
    more if the bin holds points; `place` is a point's by bins, `end` where its bin ends, and
    places that differ by less than `slack` may be the same."""

    table: np.ndarray
    each: int
    least: float
    scale: float
    place: np.ndarray
    end: np.ndarray
    slack: float


def bins(at: Columns, least: float, most: float) -> Bins | None:
    """Bins from `least` to `most`, so laid that no point lies where rounding could move
    it to another bin; None if there is no such way."""
    v, n = at.p[:, at.axis] + at.move[:, at.axis], at.count
    each = max(4, BINS * len(v) // n)
    scale = each / ((most - least) or 1.0)
    each += 3
    slack = 1e-7 + 2.0**-50 * (n * each + scale * max(abs(least), abs(most)))
    place = (v - least) * scale
    for k in range(1, 65):
        shift = 1 + k * 0.6180339887498949 % 1
        part = (place + shift) % 1
        if slack < 0.01 and part.min() > slack and part.max() < 1 - slack:
            break
    else:
        return None
    place += shift
    # points are ordered by columns as they come, the table by place
    of = np.empty(n, np.int64)
    of[np.argsort(at.begin)] = np.arange(n)
    begin, size = np.sort(at.begin), (at.end - at.begin)[np.argsort(at.begin)]
    column = np.repeat(np.arange(n), size)
    flat = column * each + place.astype(np.int64)
    kind = np.int16 if size.max() < 1 << 14 else np.int32 if len(v) < 1 << 30 else np.int64
    table = np.empty((n, each), kind)
    step = max(1, (1 << 21) // each)
    begin = np.append(begin, len(v))
    for k in range(0, n, step):
        rows = slice(begin[k], begin[min(k + step, n)])
        held = np.bincount(flat[rows] - k * each, minlength=min(step, n - k) * each).reshape(-1, each)
        table[k : k + step] = 2 * (held.cumsum(axis=1) - held) + (held > 0)
    last = np.flatnonzero(np.append(flat[1:] != flat[:-1], True))
    return Bins(table.ravel(), each, least - shift / scale, scale, place, np.repeat(last + 1, np.diff(last, prepend=-1)), slack)


def column_counts(q: np.ndarray, p: np.ndarray, move: np.ndarray, r: float, full: float = 0.0) -> np.ndarray | None:
    """How many points p, moved, lie at most r from each query q, as all pairs would tell:
    differences first, then the move, squares of x, y and z in this order.  None if a column
    has fewer than `full` points on average, or no bins can be laid."""
    near = np.ones(len(p), bool)
    for c in range(3) if len(q) else ():
        v = p[:, c] + move[:, c]
        near &= (v >= q[:, c].min() - r * (1 + 1e-6)) & (v <= q[:, c].max() + r * (1 + 1e-6))
    if not near.any() or not len(q):
        return np.zeros(len(q), np.int64)
    at = columns(p[near], move[near], full)
    if at is None:
        return None
    axis, (b, c) = at.axis, at.others
    order = np.lexsort((q[:, axis], q[:, b], q[:, c]))
    x = q[order]
    new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
    found = bins(at, x[:, axis].min() - r * (1 + 1e-5), x[:, axis].max() + r * (1 + 1e-5))
    if found is None:
        return None
    out = np.empty(len(q), np.int64)
    out[order] = _counted(at, found, x[new], r)[np.cumsum(new) - 1]
    return out


def _counted(at: Columns, found: Bins, x: np.ndarray, r: float) -> np.ndarray:
    """Counts of queries x, ordered by the columns' other axes and along them."""
    axis, (b, c), r2, wide = at.axis, at.others, r * r, r * (1 + 1e-6)
    pb, pc, tb, tc = (v[at.begin, k] for v in (at.p, at.move) for k in (b, c))
    mb, mc = pb + tb, pc + tc
    pa, ta = at.p[:, axis].copy(), at.move[:, axis].copy()
    # the table's rows are in the order of points
    row = np.empty(at.count, np.int64)
    row[np.argsort(at.begin)] = np.arange(at.count)
    row = row * float(found.each)
    out = np.zeros(len(x), np.int64)

    def exact(i, k, above, s, e):
        """Where from s to e the points of column k end that are not above the run of query
        i's ball (or are below it)."""
        s, e = s.copy(), e.copy()
        db, dc = pb[k] - x[i, b] + tb[k], pc[k] - x[i, c] + tc[k]
        qa, square = x[i, axis], [np.zeros(0)] * 3
        db, dc = db * db, dc * dc
        todo = np.flatnonzero(s < e)
        while len(todo):
            m = (s[todo] + e[todo]) >> 1
            d = pa[m] - qa[todo] + ta[m]
            square[axis], square[b], square[c] = d * d, db[todo], dc[todo]
            within = square[0] + square[1] + square[2] <= r2
            below = pa[m] + ta[m] < qa[todo]
            yes = np.where(above[todo], below | within, below & ~within)
            s[todo[yes]] = m[yes] + 1
            e[todo[~yes]] = m[~yes]
            todo = todo[s[todo] < e[todo]]
        return s

    def within_bins(i, k, above, s, t):
        """As `exact`, from the points' places: s is where the bin begins, t the end's place."""
        e = found.end[s]
        lo, hi = s.copy(), e.copy()
        todo = np.arange(len(s))
        while len(todo):
            m = (lo[todo] + hi[todo]) >> 1
            yes = found.place[m] <= t[todo]
            lo[todo[yes]] = m[yes] + 1
            hi[todo[~yes]] = m[~yes]
            todo = todo[lo[todo] < hi[todo]]
        close = (lo < e) & (found.place[np.minimum(lo, e - 1)] - t <= found.slack) | (lo > s) & (t - found.place[np.maximum(lo - 1, s)] <= found.slack)
        close = np.flatnonzero(close)
        if len(close):
            lo[close] = exact(i[close], k[close], above[close], s[close], e[close])
        return lo - s

    def add(waiting, ends):
        i, k, above, *more = (np.concatenate(v) for v in zip(*waiting, strict=True))
        n = ends(i, k, above, *more)
        np.add.at(out, i, np.where(above, n, -n))
        waiting.clear()

    grazed, held = [], []
    starts = np.concatenate([[0], np.flatnonzero((x[1:, [b, c]] != x[:-1, [b, c]]).any(axis=1)) + 1, [len(x)]])
    reach = np.searchsorted(mc, x[starts[:-1], c] - wide), np.searchsorted(mc, x[starts[:-1], c] + wide, "right")
    waits = [0, 0]
    for i0, i1, k0, k1 in zip(starts[:-1].tolist(), starts[1:].tolist(), *(v.tolist() for v in reach), strict=True):
        qb, qc = x[i0, b], x[i0, c]
        db, dc = mb[k0:k1] - qb, mc[k0:k1] - qc
        k = k0 + np.flatnonzero(db * db + dc * dc <= wide * wide)
        db, dc = pb[k] - qb + tb[k], pc[k] - qc + tc[k]
        w2 = r2 - db * db - dc * dc
        cut = w2 > (GRAZED * r) ** 2
        if not cut.all():
            j = np.tile(k[~cut], i1 - i0)
            i = np.repeat(np.arange(i0, i1), len(j) // (i1 - i0))
            grazed += [(i, j, np.full(len(j), above), at.begin[j], at.end[j]) for above in (True, False)]
            waits[0] += 2 * len(j)
            if waits[0] > AT_ONCE:
                add(grazed, lambda i, k, above, s, e: exact(i, k, above, s, e) - s)
                waits[0] = 0
            k, w2 = k[cut], w2[cut]
        if not len(k):
            continue
        half = np.sqrt(w2) * found.scale
        both = np.concatenate([row[k] + half, row[k] - half])
        step = max(1, MATRIX // len(both))
        for m0 in range(i0, i1, step):
            u = (x[m0 : min(m0 + step, i1), axis] - found.least) * found.scale
            t = u[:, None] + both
            got = found.table[t.astype(np.int64)]
            odd = np.flatnonzero((got & 1) != 0)
            i, j = np.divmod(odd, len(both))
            above = j < len(k)
            n = got[:, : len(k)].sum(axis=1, dtype=np.int64) - got[:, len(k) :].sum(axis=1, dtype=np.int64)
            n -= np.bincount(i, np.where(above, 1.0, -1.0), len(u)).astype(np.int64)
            out[m0 : m0 + len(u)] += n >> 1
            kk = k[np.where(above, j, j - len(k))]
            held.append((i + m0, kk, above, at.begin[kk] + (got.ravel()[odd] >> 1), t.ravel()[odd] - row[kk]))
            waits[1] += len(odd)
            if waits[1] > AT_ONCE:
                add(held, within_bins)
                waits[1] = 0
    if grazed:
        add(grazed, lambda i, k, above, s, e: exact(i, k, above, s, e) - s)
    if held:
        add(held, within_bins)
    return out
