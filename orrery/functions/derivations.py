"""Built-in derived columns: expressions over a snapshot's columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..snapshot import Snapshot, derived
from ..units import K_B, M_P

#: Adiabatic index, and the helium mass fraction behind the mean molecular mass.
GAMMA = 5.0 / 3.0
HELIUM = 0.245


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _over(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


_length = lambda s: s.unit("pos")
_speed = lambda s: s.unit("vel")
_energy = lambda s: s.unit("vel") ** 2
_spin = lambda s: s.unit("pos") * s.unit("vel")


@derived(unit=_length)
def r(s: Snapshot) -> Column:
    return F.sqrt(_dot(s.vector("pos"), s.vector("pos")))


@derived(unit=_length)
def rxy(s: Snapshot) -> Column:
    x, y, _ = s.vector("pos")
    return F.sqrt(x * x + y * y)


@derived(unit=_energy)
def v2(s: Snapshot) -> Column:
    return _dot(s.vector("vel"), s.vector("vel"))


@derived(unit=_speed)
def vr(s: Snapshot) -> Column:
    return _over(_dot(s.vector("pos"), s.vector("vel")), s.col("r"))


@derived(unit=_speed)
def vt(s: Snapshot) -> Column:
    return F.sqrt(F.greatest(s.col("v2") - s.col("vr") * s.col("vr"), F.lit(0.0)))


@derived(unit=_energy)
def ke(s: Snapshot) -> Column:
    return s.col("v2") * 0.5


@derived(unit=_energy)
def te(s: Snapshot) -> Column:
    return s.col("ke") + s.col("phi")


def _cross(k: int):
    def fn(s: Snapshot) -> Column:
        p, v = s.vector("pos"), s.vector("vel")
        i, j = (k + 1) % 3, (k + 2) % 3
        return p[i] * v[j] - p[j] * v[i]

    return fn


for _k, _name in enumerate(("j_x", "j_y", "j_z")):
    derived(_name, unit=_spin)(_cross(_k))
derived("jz", unit=_spin)(_cross(2))


@derived(unit=lambda s: _spin(s) ** 2)
def j2(s: Snapshot) -> Column:
    return _dot(s.vector("j"), s.vector("j"))


@derived(unit=_speed)
def vrxy(s: Snapshot) -> Column:
    (x, y, _), (vx, vy, _) = s.vector("pos"), s.vector("vel")
    return _over(x * vx + y * vy, s.col("rxy"))


@derived(unit=_speed)
def vcxy(s: Snapshot) -> Column:
    (x, y, _), (vx, vy, _) = s.vector("pos"), s.vector("vel")
    return F.coalesce(_over(x * vy - y * vx, s.col("rxy")), F.lit(0.0))


@derived(unit=_speed)
def vphi(s: Snapshot) -> Column:
    return s.col("vcxy")


@derived()
def theta(s: Snapshot) -> Column:
    ratio = _over(s.vector("pos")[2], s.col("r"))
    return F.acos(F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0)))


@derived()
def alt(s: Snapshot) -> Column:
    return F.lit(math.pi / 2) - s.col("theta")


@derived()
def az(s: Snapshot) -> Column:
    x, y, _ = s.vector("pos")
    return F.atan2(y, x)


@derived(unit=_speed)
def vtheta(s: Snapshot) -> Column:
    vx, vy, vz = s.vector("vel")
    a, t = s.col("az"), s.col("theta")
    return F.cos(a) * F.cos(t) * vx + F.sin(a) * F.cos(t) * vy - F.sin(t) * vz


@derived(unit=lambda s: s.unit("tform"))
def age(s: Snapshot) -> Column:
    return F.lit(float(s.prop("time"))) - s.col("tform")


#: Particles for each nucleus of an ion: itself and its electrons.
IONS = {"HI": 1.0, "HII": 2.0, "HeI": 1.0, "HeII": 2.0, "HeIII": 3.0}


@derived()
def mu(s: Snapshot) -> Column:
    """Mean molecular mass: from electrons, else from ions, else from temperature."""
    if s.has_key("ElectronAbundance"):
        x = 1 - HELIUM
        return F.lit(4.0) / (1 + 3 * x + 4 * x * s.col("ElectronAbundance"))
    if all(k in s.df.columns for k in IONS):
        return 1 / sum(n * s.col(k) for k, n in IONS.items())
    neutral, ionised = 4 / (4 - 3 * HELIUM), 4 / (8 - 5 * HELIUM)
    return F.when(s.col("temp") < 1e4, neutral).otherwise(ionised)


def _gas(s: Snapshot) -> float:
    """k / m_p in the unit of u per K."""
    return (K_B / M_P).ratio(s.unit("u") / "K", **s.context()) if not s.unit("u").dimensionless else (K_B / M_P).ratio("km^2 s^-2 K^-1")


@derived()
def u(s: Snapshot) -> Column:
    return s.col("temp") * (K_B / M_P).ratio("km^2 s^-2 K^-1") / (s.col("mu") * (GAMMA - 1))


@derived()
def temp(s: Snapshot) -> Column:
    """From u: by electrons or ions if they are there, else with the mean molecular mass
    of five rounds from 1 on (between two states the fifth counts)."""
    scale = (GAMMA - 1) / _gas(s)
    if s.has_key("ElectronAbundance") or all(k in s.df.columns for k in IONS):
        return s.col("u") * s.col("mu") * scale
    neutral, ionised = 4 / (4 - 3 * HELIUM), 4 / (8 - 5 * HELIUM)
    t = s.col("u") * scale
    for _ in range(4):
        t = s.col("u") * scale * F.when(t < 1e4, neutral).otherwise(ionised)
    return t


@derived()
def p(s: Snapshot) -> Column:
    return s.col("u") * s.col("rho") * (2.0 / 3.0)


@derived()
def cs(s: Snapshot) -> Column:
    return F.sqrt(s.col("temp") * (GAMMA * (K_B / M_P).ratio("km^2 s^-2 K^-1")) / s.col("mu"))


@derived()
def aform(s: Snapshot) -> Column:
    from .cosmology import scale_factor_column

    return scale_factor_column(s, s.col("tform"))


@derived()
def tform(s: Snapshot) -> Column:
    """The age at the scale factor of formation; null where that isn't positive."""
    from .cosmology import age_column

    a = s.col("aform")
    return F.when(a > 0, age_column(s, 1 / a - 1))


@derived()
def zeldovich_offset_x(s: Snapshot) -> Column:
    return _zeldovich(s, 0)


@derived()
def zeldovich_offset_y(s: Snapshot) -> Column:
    return _zeldovich(s, 1)


@derived()
def zeldovich_offset_z(s: Snapshot) -> Column:
    return _zeldovich(s, 2)


def _zeldovich(s: Snapshot, k: int) -> Column:
    from .cosmology import Cosmology

    c = Cosmology.of(s)
    rate = c.growth_rate(s.prop("z")) / c.growth(s.prop("z"))
    return s.vector("vel")[k] / (s.prop("a") * rate)


@derived()
def hetot(s: Snapshot) -> Column:
    return 0.236 + 2.1 * s.col("metals")


@derived()
def hydrogen(s: Snapshot) -> Column:
    return 1 - s.col("metals") - s.col("hetot")


def _helium(s: Snapshot) -> Column:
    """Helium nuclei for each unit of mass, from the metals."""
    z = s.col("metals")
    return F.when(z <= 0.1, 0.236 + 2.1 * z).otherwise(0.446 - 0.446 * (z - 0.1) / 0.9) / 4


@derived()
def HII(s: Snapshot) -> Column:
    left = 1 - 4 * _helium(s) - s.col("metals") - s.col("HI")
    return left - 2 * s.col("H2") if s.has_key("H2") else left


@derived()
def HeIII(s: Snapshot) -> Column:
    return _helium(s) - s.col("HeII") - s.col("HeI")


@derived()
def ne(s: Snapshot) -> Column:
    return s.col("HII") + s.col("HeII") + 2 * s.col("HeIII")


# Solar mass fractions behind the abundance ratios.
X_FE, X_O, X_H = 0.125e-2, 0.84e-2, 0.706


def _ratio(a: str, b: str, sun: float):
    def fn(s: Snapshot) -> Column:
        top, bottom = s.col(a), s.col(b)
        return F.when((top > 0) & (bottom > 0), F.log10(top / bottom) - math.log10(sun))

    return fn


derived("feh")(_ratio("FeMassFrac", "hydrogen", X_FE / X_H))
derived("oxh")(_ratio("OxMassFrac", "hydrogen", X_O / X_H))
derived("ofe")(_ratio("OxMassFrac", "FeMassFrac", X_O / X_FE))
