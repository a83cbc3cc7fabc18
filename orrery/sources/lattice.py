"""Particles on a regular lattice, numbered with x running fastest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cosmology import Cosmology
from ..snapshot import ROW, Snapshot, snapshot


def places(row: Column, nx: int, ny: int, nz: int) -> tuple[Column, Column, Column]:
    """Lattice coordinates (the middles of unit cells) of row numbers."""
    x = F.pmod(row, F.lit(nx))
    y = F.pmod(F.floor(row / nx), F.lit(ny))
    z = F.floor(row / (nx * ny))
    return tuple(c.cast("double") + 0.5 for c in (x, y, z))


def initial_conditions(spark: SparkSession, n: tuple[int, int, int], cell: float, cosmology: Cosmology, offsets: DataFrame | None = None) -> Snapshot:
    """Dark matter on a lattice of cells of a length in kpc, of mean density; `offsets`
    (pidx, dx, dy, dz, and vx, vy, vz) displaces it."""
    df = spark.range(n[0] * n[1] * n[2]).withColumnRenamed("id", ROW)
    for c, v in zip("xyz", places(F.col(ROW), *n), strict=True):
        df = df.withColumn(c, v * cell)
    df = df.withColumn("mass", F.lit(cosmology.rho_matter(0.0) * cell**3))
    if offsets is not None:
        df = df.join(offsets, ROW, "left")
        for c in "xyz":
            df = df.withColumn(c, F.col(c) + F.coalesce(F.col(f"d{c}"), F.lit(0.0))).drop(f"d{c}")
    else:
        df = df.withColumns({c: F.lit(0.0) for c in ("vx", "vy", "vz")})
    return snapshot(df, {"pos": "kpc a", "vel": "km s^-1", "mass": "Msol"}, {"a": cosmology.a, "h": cosmology.h, "omegaM0": cosmology.omega_m, "omegaL0": cosmology.omega_l})
