"""Filters: predicates over snapshots as boolean columns.

Inequalities are open, except that the inside of an annulus is closed.  A periodic box
is seen through one minimum-image step.  Everything is a plain comparison of scalar
columns, which Spark pushes to the scan; `box` gives the bounding comparisons of a
region, by which Parquet row groups and cells can be left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..snapshot import Snapshot, family_name
from ..units import Unit

Quantity = float | str | Unit
Corner = tuple[Column, Column, Column]


class Filter:
    """Matches all rows; the base of the others."""

    def column(self, s: Snapshot) -> Column:
        return F.lit(True)

    def __and__(self, other: Filter) -> Filter:
        return And(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Or(self, other)

    def __invert__(self) -> Filter:
        return Not(self)

    def touches(self, s: Snapshot | None, lo: Corner, hi: Corner) -> Column:
        """Whether rows between two corners (closed) may be in the region; true where that
        isn't known.  Without a snapshot numbers are plain and space has no period."""
        return F.lit(True)

    def covers(self, s: Snapshot | None, lo: Corner, hi: Corner) -> Column:
        """Whether all rows between two corners are in the region; false where that isn't known."""
        return F.lit(False)

    def touches_cells(self, centres: Corner, size: Column | float, s: Snapshot | None = None) -> Column:
        """Whether the region may touch cubic cells."""
        return self.touches(s, tuple(c - size / 2 for c in centres), tuple(c + size / 2 for c in centres))


def wrapped(d: Column, box: float | None) -> Column:
    """A coordinate difference through one minimum-image step."""
    if not box:
        return d
    return F.when(d > box / 2, d - box).when(d < -box / 2, d + box).otherwise(d)


def _box(s: Snapshot | None) -> float | None:
    return None if s is None else s.properties.get("boxsize")


def _number(s: Snapshot | None, q: Quantity) -> float:
    return float(q) if s is None else s.value_in(q, "pos")


def _near(lo: Corner, hi: Corner, at, box: float | None) -> list[Column]:
    """How far, along each axis, a point is from the nearest image of an interval."""
    gap = lambda a, b, v: F.greatest(a - v, F.lit(v) - b, F.lit(0.0))
    return [F.least(*[gap(a, b, float(v) + k * (box or 0.0)) for k in ((0, -1, 1) if box else (0,))]) if box else gap(a, b, float(v)) for a, b, v in zip(lo, hi, at, strict=True)]


def _far(lo: Corner, hi: Corner, at) -> list[Column]:
    return [F.greatest(b - float(v), F.lit(float(v)) - a) for a, b, v in zip(lo, hi, at, strict=True)]


#: What is covered is so by more than rounding.
_SURE = 1 - 1e-12


@dataclass(frozen=True)
class FamilyFilter(Filter):
    name: str

    def column(self, s):
        return F.col("family") == family_name(self.name)


@dataclass(frozen=True)
class And(Filter):
    a: Filter
    b: Filter

    def column(self, s):
        return self.a.column(s) & self.b.column(s)

    def touches(self, s, lo, hi):
        return self.a.touches(s, lo, hi) & self.b.touches(s, lo, hi)

    def covers(self, s, lo, hi):
        return self.a.covers(s, lo, hi) & self.b.covers(s, lo, hi)


@dataclass(frozen=True)
class Or(Filter):
    a: Filter
    b: Filter

    def column(self, s):
        return self.a.column(s) | self.b.column(s)

    def touches(self, s, lo, hi):
        return self.a.touches(s, lo, hi) | self.b.touches(s, lo, hi)

    def covers(self, s, lo, hi):
        return self.a.covers(s, lo, hi) | self.b.covers(s, lo, hi)


@dataclass(frozen=True)
class Not(Filter):
    """Negation.  Where the filter is unknown (a null column) so is its negation, except
    that callers see unknown as false."""

    a: Filter

    def column(self, s):
        return ~F.coalesce(self.a.column(s), F.lit(False))

    def touches(self, s, lo, hi):
        return ~self.a.covers(s, lo, hi)

    def covers(self, s, lo, hi):
        return ~self.a.touches(s, lo, hi)


@dataclass(frozen=True)
class Sphere(Filter):
    radius: Quantity
    cen: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def _radius(self, s):
        return s.value_in(self.radius, "pos")

    def column(self, s):
        box, r = _box(s), self._radius(s)
        d = [wrapped(c - F.lit(float(x)), box) for c, x in zip(s.vector("pos"), self.cen, strict=True)]
        inside = sum(v * v for v in d) < r * r
        if box:
            return inside
        # bounds that a scan can be pruned by
        bounds = [(c > x - r) & (c < x + r) for c, x in zip(s.vector("pos"), self.cen, strict=True)]
        return reduce(Column.__and__, bounds) & inside

    def touches(self, s, lo, hi):
        r = _number(s, self.radius)
        return sum(v * v for v in _near(lo, hi, self.cen, _box(s))) <= r * r

    def covers(self, s, lo, hi):
        r = _number(s, self.radius)
        return F.lit(False) if _box(s) else sum(v * v for v in _far(lo, hi, self.cen)) < r * r * _SURE


@dataclass(frozen=True)
class Cuboid(Filter):
    """Between two corners, open on all sides.  Missing lower bounds are those of x,
    missing upper bounds the negatives of the lower."""

    x1: Quantity
    y1: Quantity | None = None
    z1: Quantity | None = None
    x2: Quantity | None = None
    y2: Quantity | None = None
    z2: Quantity | None = None

    def bounds(self, s) -> list[tuple[float, float]]:
        num = lambda q: _number(s, q)
        x1 = num(self.x1)
        y1 = x1 if self.y1 is None else num(self.y1)
        z1 = x1 if self.z1 is None else num(self.z1)
        lo = (x1, y1, z1)
        hi = [-v if q is None else num(q) for v, q in zip(lo, (self.x2, self.y2, self.z2), strict=True)]
        return list(zip(lo, hi, strict=True))

    def column(self, s):
        box = _box(s)
        parts = []
        for c, (lo, hi) in zip(s.vector("pos"), self.bounds(s), strict=True):
            if box:
                d = wrapped(c - F.lit((lo + hi) / 2), box)
                parts.append(F.abs(d) < (hi - lo) / 2)
            else:
                parts.append((c > lo) & (c < hi))
        return reduce(Column.__and__, parts)

    def touches(self, s, lo, hi):
        sides = self.bounds(s)
        if not _box(s):
            return reduce(Column.__and__, [(b >= x1) & (a <= x2) for a, b, (x1, x2) in zip(lo, hi, sides, strict=True)])
        near = _near(lo, hi, [(x1 + x2) / 2 for x1, x2 in sides], _box(s))
        return reduce(Column.__and__, [d <= (x2 - x1) / 2 for d, (x1, x2) in zip(near, sides, strict=True)])

    def covers(self, s, lo, hi):
        if _box(s):
            return F.lit(False)
        return reduce(Column.__and__, [(a > x1) & (b < x2) for a, b, (x1, x2) in zip(lo, hi, self.bounds(s), strict=True)])


@dataclass(frozen=True)
class Disc(Filter):
    radius: Quantity
    height: Quantity
    cen: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def column(self, s):
        box = _box(s)
        x, y, z = (wrapped(c - F.lit(float(v)), box) for c, v in zip(s.vector("pos"), self.cen, strict=True))
        r, h = s.value_in(self.radius, "pos"), s.value_in(self.height, "pos")
        return (x * x + y * y < r * r) & (F.abs(z) < h)

    def touches(self, s, lo, hi):
        r, h = _number(s, self.radius), _number(s, self.height)
        x, y, z = _near(lo, hi, self.cen, _box(s))
        return (x * x + y * y <= r * r) & (z <= h)

    def covers(self, s, lo, hi):
        r, h = _number(s, self.radius), _number(s, self.height)
        x, y, z = _far(lo, hi, self.cen)
        return F.lit(False) if _box(s) else (x * x + y * y < r * r * _SURE) & (z < h * _SURE)


@dataclass(frozen=True)
class BandPass(Filter):
    name: str
    least: Quantity
    most: Quantity

    def column(self, s):
        return (s.col(self.name) > s.value_in(self.least, self.name)) & (s.col(self.name) < s.value_in(self.most, self.name))


@dataclass(frozen=True)
class HighPass(Filter):
    name: str
    least: Quantity

    def column(self, s):
        return s.col(self.name) > s.value_in(self.least, self.name)


@dataclass(frozen=True)
class LowPass(Filter):
    name: str
    most: Quantity

    def column(self, s):
        return s.col(self.name) < s.value_in(self.most, self.name)


def Annulus(r1: Quantity, r2: Quantity, cen=(0.0, 0.0, 0.0)) -> Filter:
    """r1 <= r < r2."""
    return ~Sphere(r1, cen) & Sphere(r2, cen)


def SolarNeighborhood(r1: Quantity = "5 kpc", r2: Quantity = "10 kpc", height: Quantity = "2 kpc", cen=(0.0, 0.0, 0.0)) -> Filter:
    return ~Disc(r1, height, cen) & Disc(r2, height, cen)


__all__ = ["And", "Annulus", "BandPass", "Cuboid", "Disc", "FamilyFilter", "Filter", "HighPass", "LowPass", "Not", "Or", "SolarNeighborhood", "Sphere", "wrapped"]
