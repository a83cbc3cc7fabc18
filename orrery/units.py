"""Exact unit algebra.

A unit is a scale times a product of base units with rational exponents.  Parsing,
products, powers and ratios are evaluated when a plan is built; a conversion reaches the
plan as one literal factor.  `a` and `h` are base units that a context replaces by
numbers.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import lru_cache

BASES = ("m", "s", "kg", "K", "a", "h", "aform", "rad")

# Definitions of named units.
NAMED = """
yr = 31.5576e6 s
kyr = 1000 yr
Myr = 1000 kyr
Gyr = 1000 Myr
Hz = s^-1
kHz = 1e3 Hz
MHz = 1e6 Hz
GHz = 1e9 Hz
THz = 1e12 Hz
angst = 1e-10 m
cm = 0.01 m
mm = 1e-3 m
nm = 1e-9 m
km = 1000 m
au = 1.495978707e11 m
pc = 3.0856775814913673e16 m
kpc = 1000 pc
Mpc = 1000 kpc
Gpc = 1000 Mpc
sr = rad^2
deg = 0.01745329251 rad
arcmin = 0.01666666666 deg
arcsec = 0.01666666666 arcmin
Msol = 1.98842e30 kg
g = 1.0e-3 kg
m_p = 1.67262192369e-27 kg
m_e = 9.1093837015e-31 kg
N = kg m s^-2
dyn = g cm s^-2
J = N m
erg = 1.0e-7 J
eV = 1.602176634e-19 J
keV = 1000 eV
MeV = 1000 keV
W = J s^-1
Jy = 1e-26 W m^-2 Hz^-1
Pa = J m^-3
(1+z) = a^-1
k = 1.380649e-23 J K^-1
c = 299792458 m s^-1
G = 6.67430e-11 m^3 kg^-1 s^-2
hP = 6.62607015e-34 m^2 kg s^-1
"""


def _decimal(v) -> Fraction | None:
    """The decimal number that a float is written as, exactly."""
    if isinstance(v, Fraction):
        return v
    v = float(v)
    return Fraction(repr(v)) if math.isfinite(v) else None


def _rounded(v) -> float:
    try:
        return float(v)
    except OverflowError:
        return math.copysign(math.inf, v)


class UnitsError(ValueError):
    """Units that don't convert into each other, or text that is no unit."""


class Unit:
    """scale * product of base units; immutable and hashable.

    The scale is kept as a fraction of the decimal number that was written (None if it isn't
    finite), so that 0.2 Mpc is 200 kpc and not the next number; `scale` is it rounded once."""

    __slots__ = ("dims", "exact", "scale")

    def __init__(self, scale: float | Fraction = 1.0, dims: dict[str, Fraction] | None = None):
        self.exact = _decimal(scale)
        self.scale = _rounded(scale)
        self.dims = {b: Fraction(e) for b, e in (dims or {}).items() if e}

    def __mul__(self, other) -> Unit:
        other = as_unit(other)
        dims = dict(self.dims)
        for b, e in other.dims.items():
            dims[b] = dims.get(b, Fraction(0)) + e
        both = self.exact is not None and other.exact is not None
        return Unit(self.exact * other.exact if both else self.scale * other.scale, dims)

    __rmul__ = __mul__

    def __truediv__(self, other) -> Unit:
        return self * as_unit(other) ** -1

    def __rtruediv__(self, other) -> Unit:
        return as_unit(other) * self**-1

    def __pow__(self, p) -> Unit:
        p = Fraction(*p) if isinstance(p, tuple) else Fraction(p).limit_denominator(1000)
        whole = self.exact is not None and p.denominator == 1
        return Unit(self.exact**p.numerator if whole else self.scale ** float(p), {b: e * p for b, e in self.dims.items()})

    def __eq__(self, other) -> bool:
        try:
            other = as_unit(other)
        except (UnitsError, TypeError):
            return NotImplemented
        return self.dims == other.dims and math.isclose(self.scale, other.scale, rel_tol=1e-12)

    def __hash__(self) -> int:
        return hash(frozenset(self.dims.items()))

    def __repr__(self) -> str:
        parts = [f"{self.scale:.6e}"] if self.scale != 1 or not self.dims else []
        return " ".join(parts + [b if e == 1 else f"{b}**{e}" for b, e in sorted(self.dims.items())])

    @property
    def dimensionless(self) -> bool:
        return not self.dims

    def substituted(self, **values: float) -> Unit:
        """With base units replaced by numbers."""
        out = Unit(self.scale if self.exact is None else self.exact, {b: e for b, e in self.dims.items() if values.get(b) is None})
        for b, v in values.items():
            if b in self.dims and v is not None:
                out = out * Unit(float(v)) ** self.dims[b]
        return out

    def ratio(self, other, **values: float) -> float:
        """How many of the other unit this one is; a and h may be given as values."""
        r = (self / as_unit(other)).substituted(**values)
        if r.dims:
            raise UnitsError(f"{self!r} and {as_unit(other)!r} differ by {Unit(1, r.dims)!r}")
        return r.scale

    def in_units(self, other, **values: float) -> float:
        return self.ratio(other, **values)

    def is_compatible(self, other, **values: float) -> bool:
        try:
            self.ratio(other, **values)
        except UnitsError:
            return False
        return True

    def dimensionless_constant(self, **values: float) -> float:
        """The number that this unit is; an error if a dimension is left."""
        return self.ratio(Unit(), **values)

    def dimensionality(self) -> str:
        """The dimensions in words, such as `length**2 time**-1`; h and a stay."""
        words = {"m": "length", "s": "time", "kg": "mass", "K": "temperature", "rad": "angle"}
        return " ".join(words.get(b, b) + ("" if e == 1 else f"**{e}") for b, e in sorted(self.dims.items()))

    def latex(self) -> str:
        """As TeX: a decimal factor and base units in roman."""
        out = []
        if self.scale != 1 or not self.dims:
            mantissa, power = f"{self.scale:.6e}".split("e")
            mantissa = mantissa.rstrip("0").rstrip(".")
            ten = rf"10^{{{int(power)}}}"
            out.append(mantissa if int(power) == 0 else ten if mantissa == "1" else rf"{mantissa}\times {ten}")
        for b, e in sorted(self.dims.items()):
            out.append(rf"\mathrm{{{b}}}" + ("" if e == 1 else f"^{{{e}}}"))
        return r"\,".join(out)

    def dimensional_project(self, basis) -> list[Fraction]:
        """Exponents of the basis units that give this unit's dimensions, exactly."""
        basis = [as_unit(b) for b in basis]
        rows = sorted({*self.dims, *(d for b in basis for d in b.dims)})
        m = [[b.dims.get(r, Fraction(0)) for b in basis] + [self.dims.get(r, Fraction(0))] for r in rows]
        return _solve(m, len(basis))


def _solve(m: list[list[Fraction]], n: int) -> list[Fraction]:
    """Solution of an exact linear system given as rows with the right side last."""
    at = 0
    for col in range(n):
        pivot = next((i for i in range(at, len(m)) if m[i][col]), None)
        if pivot is None:
            raise UnitsError("the basis units depend on each other")
        m[at], m[pivot] = m[pivot], m[at]
        lead = m[at][col]
        m[at] = [v / lead for v in m[at]]
        for i in range(len(m)):
            if i != at and m[i][col]:
                f = m[i][col]
                m[i] = [v - f * w for v, w in zip(m[i], m[at], strict=True)]
        at += 1
    if any(row[n] for row in m[at:]):
        raise UnitsError("the basis units don't span the unit")
    return [m[i][n] for i in range(n)]


_names: dict[str, Unit] = {b: Unit(1, {b: Fraction(1)}) for b in BASES}
_TERM = re.compile(r"(\(1\+z\)|[A-Za-z_][A-Za-z_0-9]*)(?:(?:\*\*|\^)([-+]?[0-9.]+(?:/[0-9]+)?))?$")


@lru_cache(maxsize=4096)
def parse(text: str) -> Unit:
    """A unit from text such as `1e10 Msol kpc**-3 h^1/2`; `1` and the empty text are
    dimensionless."""
    out = Unit()
    for i, part in enumerate(text.split()):
        if i == 0:
            try:
                out = Unit(float(part))
                continue
            except ValueError:
                pass
        m = _TERM.match(part)
        if not m or m[1] not in _names:
            raise UnitsError(f"no unit: {part!r}")
        out = out * _names[m[1]] ** Fraction(m[2] or 1)
    return out


def as_unit(x) -> Unit:
    if isinstance(x, Unit):
        return x
    return parse(x) if isinstance(x, str) else Unit(float(x))


def is_unit_like(x) -> bool:
    """Whether something is a unit, has one, or is text that names one."""
    if isinstance(x, str):
        try:
            parse(x)
        except (UnitsError, ValueError):
            return False
        return True
    return isinstance(x, Unit) or isinstance(getattr(x, "unit", None), Unit)


def define(name: str, value) -> Unit:
    """A new named unit."""
    _names[name] = as_unit(value)
    parse.cache_clear()
    return _names[name]


for _line in NAMED.split("\n"):
    if _line.strip():
        _n, _, _v = _line.partition(" = ")
        define(_n, _v)


def unit(name: str) -> Unit:
    return parse(name)


G = unit("G")
K_B = unit("k")
M_P = unit("m_p")
NO_UNIT = Unit()
