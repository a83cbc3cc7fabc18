"""Look-ups in tables over a grid: stellar magnitudes and ion fractions.

A table is a fixed set of numbers; it is broadcast and interpolated in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..snapshot import Snapshot, derived


def multilinear(axes: Sequence[np.ndarray], values: np.ndarray, points: Sequence[np.ndarray]) -> np.ndarray:
    """Linear interpolation on a grid; points outside are moved to its edge, NaN stays."""
    n = len(points[0])
    low, frac = [], []
    for a, p in zip(axes, points, strict=True):
        x = np.clip(p, a[0], a[-1])
        i = np.clip(np.searchsorted(a, np.nan_to_num(x), "right") - 1, 0, max(len(a) - 2, 0))
        low.append(i)
        frac.append((x - a[i]) / (a[i + 1] - a[i]) if len(a) > 1 else np.zeros(n))
    out = np.zeros(n)
    for corner in range(1 << len(axes)):
        w, at = np.ones(n), []
        for k in range(len(axes)):
            up = corner >> k & 1
            w = w * (frac[k] if up else 1 - frac[k])
            at.append(np.minimum(low[k] + up, len(axes[k]) - 1))
        out = out + np.where(w == 0, 0.0, w * values[tuple(at)])
    for p in points:
        out = np.where(np.isnan(p), np.nan, out)
    return out


@dataclass(frozen=True)
class GridTable:
    """Values over the product of increasing axes."""

    axes: tuple[np.ndarray, ...]
    values: np.ndarray

    def column(self, s: Snapshot, *points: Column) -> Column:
        shared = s.spark.sparkContext.broadcast((self.axes, self.values))

        @F.pandas_udf("double")
        def look_up(*cols: pd.Series) -> pd.Series:
            axes, values = shared.value
            return pd.Series(multilinear(axes, values, [c.to_numpy(float) for c in cols]))

        return look_up(*[p.cast("double") for p in points])


@dataclass(frozen=True)
class StellarTable:
    """Magnitudes of a solar mass of stars of one age and metallicity, by band."""

    log_ages: np.ndarray
    log_metals: np.ndarray
    bands: dict[str, np.ndarray]

    def magnitude(self, s: Snapshot, band: str) -> Column:
        """Magnitude of each star: the table at log age (1 yr at least) and log metals,
        brighter by its mass."""
        grid = GridTable((self.log_ages, self.log_metals), self.bands[band])
        age = F.greatest(s.col("age") * F.lit(s.unit("age").ratio("yr") if not s.unit("age").dimensionless else 1e9), F.lit(1.0))
        metals = F.greatest(s.col("metals"), F.lit(1e-30))
        mass = s.col("mass") * F.lit(s.factor("mass", "Msol") if not s.unit("mass").dimensionless else 1.0)
        return grid.column(s, F.log10(age), F.log10(metals)) - 2.5 * F.log10(mass)

    def register(self) -> None:
        """Makes <band>_mag and <band>_lum_den derived columns."""
        for band in self.bands:
            derived(f"{band}_mag")(lambda s, b=band: self.magnitude(s, b))
            derived(f"{band}_lum_den")(lambda s, b=band: F.pow(F.lit(10.0), s.col(f"{b}_mag") * -0.4) * s.col("rho") / s.col("mass"))


def read_stellar_table(text: str, bands: Sequence[str]) -> StellarTable:
    """A table from lines of metals, log age and a magnitude for each band; lines that
    start with # are notes."""
    rows = np.array([[float(v) for v in line.split()] for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")])
    z, ages = np.unique(rows[:, 0]), np.unique(rows[:, 1])
    grids = {b: np.full((len(ages), len(z)), np.nan) for b in bands}
    i, j = np.searchsorted(ages, rows[:, 1]), np.searchsorted(z, rows[:, 0])
    for k, b in enumerate(bands):
        grids[b][i, j] = rows[:, 2 + k]
    return StellarTable(ages, np.log10(z), grids)


@dataclass(frozen=True)
class IonTable:
    """log10 of ions' fractions over redshift, log temperature and log density (m_p per
    cubic cm)."""

    redshifts: np.ndarray
    log_temps: np.ndarray
    log_densities: np.ndarray
    ions: dict[str, np.ndarray]

    def fraction(self, s: Snapshot, ion: str) -> Column:
        grid = GridTable((self.redshifts, self.log_temps, self.log_densities), self.ions[ion])
        scale = s.factor("rho", "m_p cm^-3") if not s.unit("rho").dimensionless else 1.0
        return F.pow(F.lit(10.0), grid.column(s, F.lit(float(s.prop("z"))), F.log10(s.col("temp")), F.log10(s.col("rho") * F.lit(scale))))
