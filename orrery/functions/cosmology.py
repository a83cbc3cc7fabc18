"""Cosmology of a flat or curved universe with matter and a constant: ages, growth,
densities.  Numbers on the driver; columns get them as interpolation tables of literals."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..units import Unit, as_unit

#: Critical density today over h^2.
RHO_CRIT_H2 = as_unit("2.7753662724570803e11 Msol Mpc^-3")
_HUBBLE = as_unit("km s^-1 Mpc^-1")


@dataclass(frozen=True)
class Cosmology:
    omega_m: float
    omega_l: float
    h: float
    a: float = 1.0

    @classmethod
    def of(cls, s) -> Cosmology:
        """That of a snapshot's properties."""
        return cls(s.prop("omegaM0"), s.prop("omegaL0"), s.prop("h"), s.prop("a"))

    @property
    def omega_k(self) -> float:
        return 1 - self.omega_m - self.omega_l

    def expansion(self, a):
        """H(a) / H0."""
        return np.sqrt(self.omega_m / a**3 + self.omega_k / a**2 + self.omega_l)

    def hubble(self, z: float | None = None, unit="km s^-1 Mpc^-1") -> float:
        a = self._a(z)
        return float(100 * self.h * self.expansion(a)) * _HUBBLE.ratio(unit)

    def _a(self, z: float | None) -> float:
        return self.a if z is None else 1 / (1 + z)

    def _hubble_time(self, unit) -> float:
        return (Unit() / (_HUBBLE * (100 * self.h))).ratio(unit)

    def age(self, z=None, unit="Gyr"):
        """Time since a = 0; numbers or arrays of redshift."""
        z = 1 / self.a - 1 if z is None else z
        t, a = self._ages()
        got = np.interp(np.log(1 / (1 + np.asarray(z, float))), np.log(a), np.log(t))
        out = np.exp(got) * self._hubble_time(unit)
        return float(out) if np.ndim(z) == 0 else out

    def conformal_time(self, z: float | None = None, unit="Gyr") -> float:
        a = self._a(z)
        x, w = _nodes()
        s = math.sqrt(a) * (x + 1) / 2  # a = s^2 takes the root out of the integrand
        v = 2 * s / (s**4 * self.expansion(s**2))
        return float((v * w).sum() * math.sqrt(a) / 2) * self._hubble_time(unit)

    def _ages(self):
        return _age_table(self.omega_m, self.omega_l)

    def redshift(self, time, unit="Gyr"):
        """Redshift at an age; NaN before the first age that is tabulated."""
        t, a = self._ages()
        x = np.asarray(time, float) / self._hubble_time(unit)
        with np.errstate(divide="ignore", invalid="ignore"):
            got = np.exp(np.interp(np.log(x), np.log(t), np.log(a), left=np.nan, right=np.nan))
        out = 1 / got - 1
        return float(out) if np.ndim(time) == 0 else out

    def growth(self, z: float | None = None) -> float:
        """Linear growth factor of a flat universe, 1 today."""
        return self._growth(self._a(z)) / self._growth(1.0)

    def _growth(self, a: float) -> float:
        x, w = _nodes()
        b = a * (x + 1) / 2
        return float(self.expansion(a) * 2.5 * self.omega_m * (w / (b * self.expansion(b)) ** 3).sum() * a / 2)

    def growth_rate(self, z: float | None = None, unit="km s^-1 Mpc^-1") -> float:
        """da-derivative of the growth factor times the expansion: dD/dt."""
        a = self._a(z)
        e = 1e-4
        slope = (self._growth(a * (1 + e)) - self._growth(a * (1 - e))) / (2 * a * e) / self._growth(1.0)
        return slope * a * self.hubble(1 / a - 1, unit)

    def rho_crit(self, z: float | None = None, unit="Msol kpc^-3") -> float:
        return float(self.h**2 * self.expansion(self._a(z)) ** 2) * RHO_CRIT_H2.ratio(unit)

    def rho_matter(self, z: float | None = None, unit="Msol kpc^-3") -> float:
        return self.omega_m * self.h**2 / self._a(z) ** 3 * RHO_CRIT_H2.ratio(unit)


@lru_cache(maxsize=8)
def _nodes(n: int = 256):
    return np.polynomial.legendre.leggauss(n)


@lru_cache(maxsize=64)
def _age_table(omega_m: float, omega_l: float):
    """Ages in Hubble times at scale factors."""
    c = Cosmology(omega_m, omega_l, 1.0)
    a = np.geomspace(1e-4, 20.0, 2000)
    x, w = _nodes(64)
    t = np.empty_like(a)
    # with a = s^(2/3) the integrand is smooth from 0 on
    for i, top in enumerate(a):
        s = top**1.5 * (x + 1) / 2
        b = s ** (2 / 3)
        t[i] = (w * (2 / 3) * s ** (-1 / 3) / (b * c.expansion(b))).sum() * top**1.5 / 2
    return t, a


def age_column(s, z: Column, unit="Gyr") -> Column:
    """Ages at a column of redshifts, by a table of literals in log(1 + z)."""
    from ..operators.profile import interpolated

    c = Cosmology.of(s)
    zs = np.geomspace(1, 1001, 256) - 1
    return F.exp(interpolated(F.log(1 + z), np.log(1 + zs).tolist(), np.log(c.age(zs, unit)).tolist()))


def scale_factor_column(s, time: Column, unit="Gyr") -> Column:
    """Scale factors at a column of ages; null outside the table."""
    from ..operators.profile import interpolated

    c = Cosmology.of(s)
    a = np.geomspace(1e-3, 1.5, 256)
    t = c.age(1 / a - 1, unit)
    return F.when((time >= float(t[0])) & (time <= float(t[-1])), F.exp(interpolated(F.log(time), np.log(t).tolist(), np.log(a).tolist())))


def comoving_to_physical(unit) -> Unit:
    """A unit without its powers of the scale factor."""
    u = as_unit(unit)
    return Unit(u.scale, {b: e for b, e in u.dims.items() if b not in ("a", "aform")})
