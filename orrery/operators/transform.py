"""Affine transformations: each is a projection, recorded so that it can be undone."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import functions as F

from ..snapshot import Snapshot, components, vector_of


@dataclass(frozen=True)
class Step:
    """A transformation of snapshots: vector `on` (all vectors if None) by a matrix or a
    shift."""

    on: str | None
    matrix: tuple[tuple[float, ...], ...] | None = None
    shift: tuple[float, float, float] | None = None

    def inverse(self) -> Step:
        if self.matrix is not None:
            return Step(self.on, matrix=tuple(zip(*self.matrix, strict=True)))
        return Step(self.on, shift=tuple(-v for v in self.shift))

    def apply(self, s: Snapshot) -> Snapshot:
        df = s.df
        for v in [self.on] if self.on else vectors(s):
            parts = components(v)
            if not all(p in df.columns for p in parts):
                continue
            old = [F.col(f"`{p}`") for p in parts]
            if self.matrix is not None:
                new = [sum(F.lit(float(m)) * c for m, c in zip(row, old, strict=True)) for row in self.matrix]
            else:
                new = [c + F.lit(float(d)) for c, d in zip(old, self.shift, strict=True)]
            df = df.withColumns(dict(zip(parts, new, strict=True)))
        return replace(s, df=df, done=(*s.done, self))


def vectors(s: Snapshot) -> list[str]:
    """Stored vectors of which all components are there."""
    names = {vector_of(c) for c in s.df.columns} - {None}
    return sorted(v for v in names if all(c in s.df.columns for c in components(v)))


def translate(s: Snapshot, offset: Sequence[float]) -> Snapshot:
    return Step("pos", shift=tuple(map(float, offset))).apply(s)


def offset_velocity(s: Snapshot, offset: Sequence[float]) -> Snapshot:
    return Step("vel", shift=tuple(map(float, offset))).apply(s)


def rotate(s: Snapshot, matrix) -> Snapshot:
    """All vectors turned by an orthogonal matrix."""
    m = np.asarray(matrix, float)
    if m.shape != (3, 3) or np.abs(m @ m.T - np.eye(3)).max() > 1e-8:
        raise ValueError("the matrix isn't orthogonal")
    return Step(None, matrix=tuple(map(tuple, m.tolist()))).apply(s)


def _about(axis: int, degrees: float) -> np.ndarray:
    c, d = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    m = np.eye(3)
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m[i, i], m[i, j], m[j, i], m[j, j] = c, -d, d, c
    return m


def rotate_x(s: Snapshot, degrees: float) -> Snapshot:
    return rotate(s, _about(0, degrees))


def rotate_y(s: Snapshot, degrees: float) -> Snapshot:
    return rotate(s, _about(1, degrees))


def rotate_z(s: Snapshot, degrees: float) -> Snapshot:
    return rotate(s, _about(2, degrees))


def random_rotation(seed: int | None = None) -> np.ndarray:
    """A rotation drawn evenly from all."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    q[:, 0] *= np.sign(np.linalg.det(q))
    return q


def revert(s: Snapshot) -> Snapshot:
    """Without the last transformation."""
    if not s.done:
        raise ValueError("nothing to revert")
    back = s.done[-1].inverse().apply(s)
    return replace(back, done=s.done[:-1])


def apply_chain(chain: Sequence[Step], s: Snapshot, inverse: bool = False) -> Snapshot:
    """A recorded chain on another snapshot, or its inverse."""
    for step in [t.inverse() for t in reversed(chain)] if inverse else chain:
        s = step.apply(s)
    return s


def add_hubble(s: Snapshot, rate: float) -> Snapshot:
    """vel + pos * H."""
    df = s.df.withColumns({v: F.col(v) + F.col(x) * F.lit(float(rate)) for v, x in zip(components("vel"), components("pos"), strict=True)})
    return replace(s, df=df)
