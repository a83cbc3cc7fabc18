"""Discs: stability, rotation by family, and surface brightness."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..snapshot import Snapshot
from . import gravity
from .profile import PC2_PER_ARCSEC2, Profile, gravity_constant, kappa

def stability(p: Profile, eps: float | None = None) -> DataFrame:
    """bin, rbins, v_circ, omega, kappa, Toomre's Q and X of the second arm mode.

    The circular speed is that of the disc's own pull in its plane; a flat profile has
    its density by area."""
    mids = [(a + b) / 2 for a, b in zip(p.edges[:-1], p.edges[1:], strict=True)]
    curve = gravity.rotation_curve(p.s, mids, eps).select(F.col("k").alias("bin"), F.col("v_circ"))
    t = p.table("n", "mass", "density", "vr_disp").join(F.broadcast(curve), "bin").join(F.broadcast(p.bins().select("bin", "dr")), "bin")
    t = kappa(t.withColumn("omega", F.col("v_circ") / F.col("rbins")), p.n_bins)
    g = gravity_constant(p.s)
    q = F.try_divide(F.col("vr_disp") * F.col("kappa"), 3.36 * g * F.col("density"))
    x = F.try_divide(F.col("kappa") * F.col("kappa") * F.col("rbins"), 2 * math.pi * g * F.col("density") * 2)
    return t.select("bin", "rbins", "v_circ", "omega", "kappa", q.alias("q"), x.alias("x"))


def rotation_by_family(s: Snapshot, radii: Sequence[float], eps: float | None = None) -> DataFrame:
    """Circular speed from each family alone and from all: family, k, r, v_circ."""
    out = gravity.rotation_curve(s, radii, eps).withColumn("family", F.lit("all"))
    for r in s.families().orderBy("first").collect():
        out = out.unionByName(gravity.rotation_curve(s.family(r["family"]), radii, eps).withColumn("family", F.lit(r["family"])))
    return out


def density_profile(s: Snapshot, least: float, most: float, bins: int = 50) -> DataFrame:
    """bin, rbins, density of spherical shells, and its Poisson error."""
    t = Profile(s, type="log", nbins=bins, ndim=3, least=least, most=most).table("n", "density")
    return t.withColumn("err", F.try_divide("density", F.sqrt("n")))


def surface_brightness(s: Snapshot, band: str, edges: Sequence[float]) -> DataFrame:
    """Magnitudes for each square arcsecond of rings around the axis: bin, rbins, magnitude
    of the ring, sb.  Radii are in kpc."""
    p = Profile(s, edges=edges, ndim=2)
    light = p._rows.where(F.col("__x") < F.lit(p.edges[-1])).groupBy("bin").agg(F.sum(F.pow(F.lit(10.0), s.col(f"{band}_mag") * -0.4)).alias("l"))
    mag = -2.5 * F.log10("l")
    return p.bins().join(F.broadcast(light), "bin").select("bin", "rbins", mag.alias("mag"), (mag + 2.5 * F.log10(F.col("binsize") * 1e6 / PC2_PER_ARCSEC2)).alias("sb"))


def fit_exponential(table: DataFrame, least: float | None = None, most: float | None = None) -> tuple[float, float]:
    """Central brightness and scale length of an exponential disc, by least squares on the
    magnitudes of bins."""
    rows = [(r, m) for r, m in table.select("rbins", "sb").collect() if m is not None and (least is None or r >= least) and (most is None or r <= most)]
    slope, start = np.polyfit([r for r, _ in rows], [m for _, m in rows], 1)
    return float(start), float(2.5 / math.log(10) / slope)


def fit_sersic(table: DataFrame) -> tuple[float, float, float]:
    """Effective brightness, radius and index of Sersic's law, by a search over the index
    with a linear fit for each."""
    rows = np.array([(r, m) for r, m in table.select("rbins", "sb").collect() if m is not None])
    best = (np.inf, 0.0, 0.0, 0.0)
    for n in np.geomspace(0.3, 10, 400):
        b = 2 * n - 1 / 3
        x = rows[:, 0] ** (1 / n)
        slope, start = np.polyfit(x, rows[:, 1], 1)
        if slope <= 0:
            continue
        err = float(((start + slope * x - rows[:, 1]) ** 2).sum())
        if err < best[0]:
            scale = 2.5 * b / math.log(10)
            best = (err, float(start + scale), float((scale / slope) ** n), float(n))
    return best[1:]


def fourier_map(p: Profile, modes: Sequence[int] = (1, 2, 3, 4), nphi: int = 100, least: int = 1000) -> DataFrame:
    """Overdensity of the chosen modes over rings and azimuth: bin, k, value."""
    f = p.fourier(m_max=max(modes), least=least).where(F.col("m").isin(*modes))
    grid = p.s.spark.range(nphi).select(F.col("id").cast("int").alias("k"))
    phi = (F.col("k") + 0.5) * (2 * math.pi / nphi) - math.pi
    wave = 2 * (F.col("re") * F.cos(F.col("m") * phi) - F.col("im") * F.sin(F.col("m") * phi))
    return f.join(F.broadcast(grid)).groupBy("bin", "k").agg(F.sum(wave).alias("value"))


def dust_extinction(column_density: DataFrame, metal_column: str = "value") -> DataFrame:
    """Visual extinction from a map of metal column density (m_p per square cm)."""
    return column_density.withColumn("a_v", 2.5 / math.log(10) * 0.5 * F.col(metal_column) / 1e21 / 0.02 / 2)
